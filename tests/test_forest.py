"""Forests over many rows: each step against a plain computation, the whole against Spark's own trainer."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from turfline.operators import forest as FO
from turfline.operators import ml as ML


def _rows(spark, n=4_000):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), rng.random(n), np.full(n, 3.0)])
    y = 2 * x[:, 0] + x[:, 1] + (x[:, 2] > 0.5) + rng.normal(size=n) / 4
    return spark.createDataFrame([(float(b), Vectors.dense(a.tolist())) for a, b in zip(x, y)], ["xP", "features"])


def _forest(**more):
    params = dict(numTrees=20, maxDepth=5, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=42)
    return FO.Forest(featuresCol="features", labelCol="xP", **{**params, **more})


def _error(model, rows):
    return model.transform(rows).agg(F.avg(F.abs(F.col("prediction") - F.col("xP")))).first()[0]


def test_best_splits_equal_trying_all():
    rng = np.random.default_rng(1)
    n, y = rng.integers(0, 5, (3, 2, 6)).astype(float), rng.normal(size=(3, 2, 6))
    n[:, 1] = n[:, 0][:, ::-1]  # both features have the node's rows
    y[:, 1] = y[:, 0][:, ::-1]
    sums = np.stack([n, n * y, n * y * y])
    feature, at, gain, left = FO.best_splits(sums, 3, 0.0)

    def variance(s):
        return s[2] / s[0] - (s[1] / s[0]) ** 2

    for node in range(3):
        best = -np.inf
        total = sums[:, node, 0].sum(axis=1)
        for f in range(2):
            for b in range(5):
                lo = sums[:, node, f, :b + 1].sum(axis=1)
                hi = total - lo
                if min(lo[0], hi[0]) >= 3:
                    best = max(best, variance(total) - lo[0] / total[0] * variance(lo) - hi[0] / total[0] * variance(hi))
        assert gain[node] == pytest.approx(best)
        assert left[node].tolist() == pytest.approx(sums[:, node, feature[node], :at[node] + 1].sum(axis=1).tolist())


def test_thresholds_lie_between_neighbours():
    assert FO.thresholds(np.array([1.0, 1.0, 2.0, 4.0]), 32).tolist() == [1.5, 3.0]
    assert FO.thresholds(np.array([7.0] * 5), 32).tolist() == []
    assert len(FO.thresholds(np.random.default_rng(0).normal(size=5_000), 32)) == 31


def test_bags_are_poisson_and_differ_by_tree():
    numbers = np.arange(200_000, dtype=np.uint64)
    a, b = FO.in_bag(numbers, 0, 42), FO.in_bag(numbers, 1, 42)
    assert abs(a.mean() - 1) < 0.01 and abs(a.var() - 1) < 0.02 and abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert np.array_equal(a[1_000:], FO.in_bag(numbers[1_000:], 0, 42))  # whatever block a row is in


def test_forest_of_blocks_is_a_spark_model_as_good_as_sparks_own(spark, monkeypatch):
    monkeypatch.setattr(FO, "BLOCK_ROWS", 700)
    monkeypatch.setattr(FO, "SLICE_ROWS", 256)
    rows = _rows(spark)
    own, spark_s = FO.fit_forest(_forest(), rows), _forest().by_spark(rows)
    assert own.getNumTrees == 20 and own.numFeatures == 4
    assert _error(own, rows) == pytest.approx(_error(spark_s, rows), rel=0.08)
    assert own.featureImportances.toArray() == pytest.approx(spark_s.featureImportances.toArray(), abs=0.06)
    assert max(t.depth for t in own.trees) == 5
    again = FO.fit_forest(_forest(), rows)
    assert _error(again, rows) == pytest.approx(_error(own, rows), rel=1e-9)


def test_one_tree_of_all_features_has_the_sums_of_its_bag(spark):
    rows = _rows(spark, 500).coalesce(1)
    model = FO.fit_forest(_forest(numTrees=1, featureSubsetStrategy="all", minInstancesPerNode=40), rows)
    bag = FO.in_bag(np.arange(500, dtype=np.uint64), 0, 42)
    y = np.array([r["xP"] for r in rows.collect()])
    path = FO.stored_path(spark, "forest-test")
    model.write().save(path)
    nodes = [r["nodeData"] for r in spark.read.parquet(f"{path}/data").collect()]
    root, leaves = next(n for n in nodes if n["id"] == 0), [n for n in nodes if n["leftChild"] == -1]
    assert root["rawCount"] == bag.sum() and root["prediction"] == pytest.approx((bag * y).sum() / bag.sum())
    assert sum(n["rawCount"] for n in leaves) == bag.sum() and min(n["rawCount"] for n in leaves) >= 40


def test_many_rows_go_by_blocks_and_few_by_sparks_trainer(spark, monkeypatch):
    rows, seen = _rows(spark, 200), []
    monkeypatch.setattr(FO, "fit_forest", lambda est, df, n: seen.append(n))
    _forest(numTrees=2).fit(rows)
    assert not seen
    monkeypatch.setattr(FO, "MANY_ROWS", 200)
    with pytest.raises(Exception):
        _forest(numTrees=2).fit(rows).transform(rows)  # the stand-in gives no model
    assert seen == [200]


def test_cross_validation_fits_each_fold_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, *rng.random(len(ML.K.FEATURE_COLS)).tolist(), float(i % 7)) for i in range(100)]
    df, fitted = spark.createDataFrame(rows, ["id", *ML.K.FEATURE_COLS, ML.K.TARGET]), []
    fit = FO.Forest._fit
    monkeypatch.setattr(FO.Forest, "_fit", lambda self, d: fitted.append(d.count()) or fit(self, d))
    error = ML.cross_validate(df, "RandomForest", 5, numTrees=3).first()["cv_mae"]
    assert fitted == [80] * 5 and 0 < error < 7


def test_training_and_answers_read_one_stored_wide_frame(spark, monkeypatch):
    from turfline.plans.queries import q_ml, q_serve
    built, frame = [], q_ml.FT.feature_frame
    monkeypatch.setattr(q_ml.FT, "feature_frame", lambda *a: built.append(1) or frame(*a))
    monkeypatch.setattr(q_ml, "_CACHE", {})
    monkeypatch.setattr(q_serve, "_STORED", {})
    monkeypatch.setattr(q_ml.ML.K, "RF_PARAMS", {**q_ml.K.RF_PARAMS, "numTrees": 2})
    assert q_serve._predicted_players(spark, "/root/testdata/sf0.001").count() > 0
    assert len(built) == 1
