"""Catalog entries: tree training, CV, model choice, importances, bundles, reports.

Tree outputs are checked rows-only (no SQL oracle). Trained models and the stored
feature table are kept per (application, scale), so the ML keys of one run share a single fit.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from turfline import constants as K
from turfline.operators import features as FT
from turfline.operators import ml as ML
from turfline.operators import scoring as SC
from turfline.plans.catalog import register
from turfline.plans.queries.q_features import FEATURE_FX, FEATURE_SELECT, ORACLE_FEATURE_CTES, _inputs
from turfline.plans.guards import with_scalars
from turfline.session import ensure_checkpoint_dir, stored

_CACHE: dict = {}


def wide_frame(spark, sf):
    """All engineered columns, stored once for an application and folder."""
    key = (spark.sparkContext.applicationId, "wide", sf)
    if key not in _CACHE:
        _CACHE[key] = stored(FT.feature_frame(*_inputs(spark, sf)), "wide")
    return _CACHE[key]


def _features(spark, sf):
    return FT.features_of(wide_frame(spark, sf))


def trained_one(spark, sf, kind):
    key = (spark.sparkContext.applicationId, "model", sf, kind)
    if key not in _CACHE:
        models, metrics = ML.train_and_evaluate(_features(spark, sf), kinds=(kind,))
        _CACHE[key] = (models[kind], stored(metrics, "metrics"))
    return _CACHE[key]


def _trained(spark, sf):
    models, metrics = {}, None
    for kind in ("RandomForest", "GradientBoosted"):
        m, met = trained_one(spark, sf, kind)
        models[kind] = m
        metrics = met if metrics is None else metrics.unionByName(met)
    return models, metrics


@register("train_random_forest")
def q_train_random_forest(spark, sf):
    return trained_one(spark, sf, "RandomForest")[1]


@register("train_boosted_trees")
def q_train_boosted_trees(spark, sf):
    return trained_one(spark, sf, "GradientBoosted")[1]


@register("select_best_model")
def q_select_best_model(spark, sf):
    _, metrics = _trained(spark, sf)
    return ML.select_best_model(metrics)


def _cross_validated(spark, sf):
    """The forest's mean error over the folds, fitted once for an application and folder. (``ML.cross_validate`` takes
    either kind; 300 boosting rounds a fold are one job after another and too slow for a registered query.)"""
    key = (spark.sparkContext.applicationId, "cv", sf)
    if key not in _CACHE:
        _CACHE[key] = stored(ML.cross_validate(_features(spark, sf), "RandomForest", K.CV_FOLDS), "cv")
    return _CACHE[key]


@register("cross_validate")
def q_cross_validate(spark, sf):
    return _cross_validated(spark, sf)


def _best(spark, sf):
    models, metrics = _trained(spark, sf)
    name = ML.select_best_model(metrics).first()["best_model"]  # one bounded row
    return name, models[name], metrics


@register("feature_importance")
def q_feature_importance(spark, sf):
    _, model, _ = _best(spark, sf)
    return ML.feature_importance(model)


@register("model_bundle")
def q_model_bundle(spark, sf):
    name, model, metrics = _best(spark, sf)
    path = ML.save_bundle(model, metrics, name, bundle=f"{name}-{uuid.uuid4().hex}")
    loaded, meta = ML.load_bundle(spark, path)
    scored = ML.batch_predict(loaded, _features(spark, sf))
    return with_scalars(scored, meta, ["model_name"])  # one metadata row


@register("correlation_of_important")
def q_correlation_of_important(spark, sf):
    # Pearson matrix of the 12 features that the best model finds most important.
    _, model, _ = _best(spark, sf)
    cols = ML.most_important(ML.feature_importance(model), 12)
    return SC.correlation_matrix(SC.impute_median(_features(spark, sf), cols), cols)


@register("report_json")
def q_report_json(spark, sf):
    name, model, metrics = _best(spark, sf)
    report = ML.report_frame(metrics, ML.feature_importance(model), _features(spark, sf), _cross_validated(spark, sf))
    out = os.path.join(ensure_checkpoint_dir(spark), "reports", uuid.uuid4().hex)
    ML.write_report(report, out)
    return spark.read.json(out)


FEATURE_DOUBLES = list(K.FEATURE_COLS) + ["xP", "pts_per_gw"]


@register("csv_roundtrip", oracle=FEATURE_SELECT, fx=FEATURE_FX, ctes=ORACLE_FEATURE_CTES,
          rounded=FEATURE_DOUBLES)
def q_csv_roundtrip(spark, sf):
    path = os.path.join(ensure_checkpoint_dir(spark), "csv", uuid.uuid4().hex)
    return ML.csv_roundtrip(FT.feature_table(*_inputs(spark, sf)), path)
