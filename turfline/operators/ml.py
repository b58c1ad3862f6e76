"""Training, evaluation and persistence with ``pyspark.ml`` (trees train on executors).

Decisions (see README): the imputer takes exact medians of the training rows only; the
split is a hash bucket of the id (stable under repartitioning, unlike
``randomSplit``); boosted trees are Spark's ``GBTRegressor`` (no L1/L2 terms).
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline import constants as K
from turfline.functions.columns import clip_col, round_half_even
from turfline.operators.forest import Forest
from turfline.plans.guards import with_scalars
from turfline.session import ensure_checkpoint_dir, stored

_M = 2147483648  # 2^31


def enrich_join(base: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """Predictions next to base columns, joined on the entity id (row position has
    no meaning in a distributed frame)."""
    return base.join(preds, on=key, how="inner")


def split_flag(id_col: str = "id", seed: int = K.SPLIT_SEED,
               test_fraction: float = K.TEST_FRACTION) -> F.Column:
    """Deterministic hash bucket of the id: True for the test share."""
    h = ((F.col(id_col) % _M) * F.lit(1103515245) + F.lit(12345 + seed)) % _M
    return (h % 100) < int(round(test_fraction * 100))


def train_test_split(df: DataFrame, id_col: str = "id", seed: int = K.SPLIT_SEED,
                     test_fraction: float = K.TEST_FRACTION) -> DataFrame:
    return df.withColumn("is_test", split_flag(id_col, seed, test_fraction))


def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """z-score with the population std of ``fit_on``; a zero std scales by 1."""
    src = fit_on if fit_on is not None else df
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"_mu_{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"_sd_{c}")]
    out = with_scalars(df, src.agg(*aggs))
    for c in cols:
        sd = F.coalesce(F.when(F.col(f"_sd_{c}") != 0, F.col(f"_sd_{c}")), F.lit(1.0))
        out = out.withColumn(c, (F.col(c).cast("double") - F.col(f"_mu_{c}")) / sd)
    return out.drop(*[x for c in cols for x in (f"_mu_{c}", f"_sd_{c}")])


# ---------------------------------------------------------------- models

class MedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Null and NaN become the column's exact interpolated median (``scoring.exact_medians``; Spark's
    own imputer takes an approximate one). A column without values stays null."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        from turfline.operators.scoring import exact_medians
        cols = self.getInputCols()
        medians = exact_medians(dataset.select([F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols]), cols)
        values = [float("nan") if medians[c] is None else medians[c] for c in cols]
        return MedianImputerModel(inputCols=cols, outputCols=self.getOutputCols(), medians=values)


class MedianImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ``MedianImputer``; saved with its medians (NaN: the column had no values)."""

    medians = Param(Params._dummy(), "medians", "the median of each input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, medians: list[float] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = {}
        for c, out, median in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.medians)):
            value = F.nanvl(F.col(c).cast("double"), F.lit(None))
            filled[out] = value if median != median else F.coalesce(value, F.lit(median))
        return dataset.withColumns(filled)



def _regressor(kind: str, label: str, **overrides):
    if kind == "RandomForest":
        params = {**K.RF_PARAMS, **overrides}
        return Forest(featuresCol="features", labelCol=label, **params)
    if kind == "GradientBoosted":
        params = {**K.GBT_PARAMS, **overrides}
        return GBTRegressor(featuresCol="features", labelCol=label, **params)
    raise ValueError(kind)


def build_pipeline(kind: str, feature_cols: Sequence[str] = K.FEATURE_COLS,
                   label: str = K.TARGET, **overrides) -> Pipeline:
    """Median imputer -> assembler -> z-score -> tree ensemble."""
    imp_out = [f"_imp_{c}" for c in feature_cols]
    stages = [
        MedianImputer(inputCols=list(feature_cols), outputCols=imp_out),
        VectorAssembler(inputCols=imp_out, outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        _regressor(kind, label, **overrides),
    ]
    return Pipeline(stages=stages)


def prepare(features: DataFrame, feature_cols: Sequence[str] = K.FEATURE_COLS) -> DataFrame:
    return features.withColumns({c: F.col(c).cast("double") for c in feature_cols})


def fit_model(train: DataFrame, kind: str, **overrides) -> PipelineModel:
    """The fitted pipeline. What the trees are fitted on is stored first, and comes to them as one vector a row."""
    *steps, trees = build_pipeline(kind, **overrides).getStages()
    ready = Pipeline(stages=steps).fit(train)
    rows = stored(ready.transform(train).select(trees.getLabelCol(), "features"), "prepared")
    return PipelineModel(stages=[*ready.stages, trees.fit(dealt(rows) if kind == "GradientBoosted" else rows)])


#: Rows of a partition from which boosting has work for another: its rounds are many short jobs.
BOOSTED_ROWS = 30_000


def dealt(rows: DataFrame, each: int = BOOSTED_ROWS) -> DataFrame:
    """All ``rows`` in no more partitions than ``each`` rows fill."""
    return rows.coalesce(max(1, -(-rows.count() // each)))


def evaluate(model: PipelineModel, test: DataFrame, label: str = K.TARGET) -> DataFrame:
    pred = model.transform(test).select("id", F.col(label).alias("actual"), F.col("prediction").alias("pred"))
    from turfline.operators.scoring import regression_metrics
    return regression_metrics(pred, "actual", "pred")


def train_and_evaluate(features: DataFrame, kinds: Sequence[str] = ("RandomForest", "GradientBoosted"),
                       **overrides) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit each model on the train split, score the test split; metrics table per model."""
    df = train_test_split(prepare(features), "id")
    train = df.where(~F.col("is_test"))
    test = df.where(F.col("is_test"))
    models, metrics = {}, None
    for kind in kinds:
        m = fit_model(train, kind, **overrides.get(kind, {}) if isinstance(overrides.get(kind), dict) else {})
        models[kind] = m
        row = evaluate(m, test).withColumn("model", F.lit(kind))
        metrics = row if metrics is None else metrics.unionByName(row)
    return models, metrics.select("model", "mae", "rmse", "r2", "n")


def select_best_model(metrics: DataFrame) -> DataFrame:
    """The model with the lowest MAE (ties: name order)."""
    return metrics.agg(F.min_by("model", F.struct("mae", "model")).alias("best_model"),
                       F.min("mae").alias("best_mae"))


#: Folds that are fitted side by side: while one waits for the driver, the other has the cores.
FOLDS_AT_ONCE = 2


def cross_validate(features: DataFrame, kind: str, folds: int = K.CV_FOLDS,
                   parallelism: int | None = None, **overrides) -> DataFrame:
    """Mean MAE over unshuffled folds: fold = position in id order * folds / n. Each fold has one fit, on the rows of
    the other folds; nothing is fitted on all rows. ``parallelism`` folds are fitted at once."""
    from turfline.operators.scoring import rank_all
    spark = features.sparkSession
    df = prepare(features)
    ranked = rank_all(df, ["id"], rank_col="_pos")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = stored(ranked.withColumn(
        "fold", (F.floor((F.col("_pos") - 1) * folds / n.scalar())).cast("int")).drop("_pos"), "folds")
    if ranked.select("fold").distinct().count() < folds:
        raise ValueError(f"fewer rows than {folds} folds")
    ev = RegressionEvaluator(labelCol=K.TARGET, predictionCol="prediction", metricName="mae")

    def error(fold: int) -> float:
        model = build_pipeline(kind, **overrides).fit(ranked.where(F.col("fold") != fold))
        return ev.evaluate(model.transform(ranked.where(F.col("fold") == fold)))

    with ThreadPool(min(parallelism or FOLDS_AT_ONCE, folds)) as pool:
        errors = pool.map(inheritable_thread_target(spark)(error), range(folds))
    return spark.createDataFrame([(kind, math.fsum(errors) / folds)], "model string, cv_mae double")


def feature_importance(model: PipelineModel, feature_cols: Sequence[str] = K.FEATURE_COLS) -> DataFrame:
    """Importances by feature name, descending (a table of len(feature_cols) rows)."""
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(c, float(v)) for c, v in zip(feature_cols, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), F.col("feature"))


def batch_predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Impute, predict, clip 0..15, round 2 (whole table, on executors)."""
    out = model.transform(prepare(features))
    return out.select("id", round_half_even(clip_col("prediction", K.XP_MIN, K.XP_MAX), 2).alias("predicted_xP"))


# ---------------------------------------------------------------- persistence

def model_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "models", name)


def save_bundle(model: PipelineModel, metrics: DataFrame, name: str, bundle: str | None = None,
                feature_cols: Sequence[str] = K.FEATURE_COLS) -> str:
    """Fitted pipeline + a one-row metadata table (model name, feature order,
    metrics) under ``models/<bundle>`` in the shared checkpoint folder."""
    spark = metrics.sparkSession
    path = model_dir(spark, bundle or name)
    model.write().overwrite().save(os.path.join(path, "pipeline"))
    meta = (metrics.where(F.col("model") == name)
            .select(F.lit(name).alias("model_name"),
                    F.array(*[F.lit(c) for c in feature_cols]).alias("feature_cols"),
                    F.struct("mae", "rmse", "r2").alias("metrics")))
    meta.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))
    return path


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(os.path.join(path, "pipeline")), spark.read.parquet(os.path.join(path, "meta"))


def predictions_from(bundle: str, features: DataFrame) -> DataFrame:
    """id, raw_pred: what the stored model predicts for feature rows (not clipped or rounded)."""
    model, _ = load_bundle(features.sparkSession, bundle)
    return model.transform(prepare(features)).select("id", F.col("prediction").alias("raw_pred"))


def most_important(importances: DataFrame, n: int = 12) -> list[str]:
    """The n most important features, most important first (ties by name)."""
    return [r["feature"] for r in importances.orderBy(F.col("importance").desc(), "feature").limit(n).collect()]


def report_frame(metrics: DataFrame, importances: DataFrame, features: DataFrame,
                 cv: DataFrame | None = None) -> DataFrame:
    """One nested row: best model, metrics rounded to 4, top-10 features, row counts."""
    m = metrics if cv is None else metrics.join(cv, "model", "left")
    cols = [F.bround(F.col(c), 4).alias(c.upper()) for c in ["mae", "rmse", "r2"]]
    if cv is not None:
        cols.append(F.bround(F.col("cv_mae"), 4).alias("CV_MAE"))
    per_model = m.select(F.struct(F.col("model").alias("key"), F.struct(*cols).alias("value")).alias("kv"))
    metrics_map = per_model.agg(F.map_from_entries(F.collect_list("kv")).alias("metrics"))
    best = select_best_model(metrics).select("best_model")
    top = (importances.orderBy(F.col("importance").desc(), "feature").limit(10)
           .agg(F.collect_list(F.struct("feature", "importance")).alias("top_features")))
    split = train_test_split(features.select("id"), "id")
    counts = split.agg(F.count(F.lit(1)).alias("active_players"),
                       F.sum(F.when(~F.col("is_test"), 1).otherwise(0)).cast("long").alias("train_size"),
                       F.sum(F.when(F.col("is_test"), 1).otherwise(0)).cast("long").alias("test_size"))
    ds = counts.select(F.struct("active_players", F.lit(len(K.FEATURE_COLS)).alias("features"),
                                "train_size", "test_size").alias("dataset"))
    return with_scalars(with_scalars(with_scalars(best, metrics_map), top), ds)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def report_to_json(report: DataFrame) -> str:
    """Render the one-row report as a JSON string (one bounded row)."""
    return json.dumps(json.loads(report.toJSON().first()), indent=2)


FEATURE_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in K.FEATURE_COLS]
    + [T.StructField("xP", T.DoubleType()), T.StructField("web_name", T.StringType()),
       T.StructField("position_name", T.StringType()), T.StructField("short_name", T.StringType()),
       T.StructField("total_points", T.LongType()), T.StructField("pts_per_gw", T.DoubleType())])


def csv_roundtrip(df: DataFrame, path: str, schema: T.StructType = FEATURE_SCHEMA) -> DataFrame:
    """Write with a header, read back with a declared schema (no inference)."""
    df.select(*[f.name for f in schema.fields]).write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(schema).option("header", True).csv(path)


def require_columns(df: DataFrame, cols: Sequence[str], fill: bool = True) -> DataFrame:
    """Fail listing the missing feature columns, or add them as 0."""
    missing = [c for c in cols if c not in df.columns]
    if missing and not fill:
        raise ValueError(f"missing {len(missing)} feature column(s): {missing}")
    return df.withColumns({c: F.lit(0.0) for c in missing}) if missing else df
