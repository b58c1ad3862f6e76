"""The exact median imputer: saved with a pipeline, reloaded, and equal to ``impute_median``."""
import os

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

from turfline.operators import ml as ML
from turfline.operators import scoring as SC
from turfline.streaming.jobs import run_dir

ROWS = [(1, 1.0, None, None), (2, 4.0, float("nan"), None), (3, None, 10.0, None), (4, 2.0, 30.0, None), (5, 9.0, 20.0, None)]


def test_reloaded_imputer_equals_impute_median(spark):
    df = spark.createDataFrame(ROWS, "id long, a double, b double, c double")
    cols, out = ["a", "b", "c"], ["x", "y", "z"]
    stages = [ML.MedianImputer(inputCols=cols, outputCols=out), VectorAssembler(inputCols=out, outputCol="v", handleInvalid="keep")]
    path = os.path.join(run_dir(spark, "imputer-test"), "model")
    Pipeline(stages=stages).fit(df).write().overwrite().save(path)
    model = PipelineModel.load(path)
    assert isinstance(model.stages[0], ML.MedianImputerModel)
    clean = df.replace(float("nan"), None)
    want = SC.impute_median(clean, cols).orderBy("id").select(*cols).collect()
    got = model.transform(df).orderBy("id").select(*out).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert [tuple(r)[:2] for r in got][0] == (1.0, 20.0) and got[2]["x"] == 3.0 and got[0]["z"] is None
    assert ML.MedianImputer(inputCols=cols, outputCols=out).fit(df.limit(0)).transform(df).where("x is null").count() == 1


def test_stored_bundle_predicts_as_the_fitted_model(spark):
    rows = [(i, *[float((i * k) % 17) if (i + k) % 11 else None for k in range(1, len(ML.K.FEATURE_COLS) + 1)], float(i % 7)) for i in range(80)]
    df = spark.createDataFrame(rows, ["id", *ML.K.FEATURE_COLS, ML.K.TARGET])
    models, metrics = ML.train_and_evaluate(df, kinds=("RandomForest",), RandomForest={"numTrees": 5})
    path = ML.save_bundle(models["RandomForest"], metrics, "RandomForest", bundle="imputer-test")
    fitted = models["RandomForest"].transform(ML.prepare(df)).select("id", "prediction")
    assert sorted(map(tuple, fitted.collect())) == sorted(map(tuple, ML.predictions_from(path, df).collect()))
    assert len(ML.most_important(ML.feature_importance(models["RandomForest"]), 12)) == 12
