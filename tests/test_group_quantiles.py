"""Grouped order statistics: numpy's interpolated quantiles for groups of every size, by narrowing where they are large."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turfline.operators import scoring as SC

r = random.Random(3)
ROWS = [("big", r.gauss(0, 1)) for _ in range(3000)] + [("ties", float(r.choice([1, 1, 1, 2, 5]))) for _ in range(2000)]
ROWS += [("same", 4.0)] * 1500 + [("two", 1.0), ("two", 2.0), ("one", 7.5), ("none", None), (None, 1.0), (None, 3.0), ("inf", float("inf")), ("inf", 1.0)]
ROWS += [("skew", 10.0 ** r.uniform(-300, 300)) for _ in range(1200)]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.7, 1.0])
@pytest.mark.parametrize("small", [65_536, 20])
def test_equals_numpy(spark, q, small):
    df = spark.createDataFrame(ROWS, "g string, v double").withColumn("w", -F.col("v"))
    got = {(x["g"], x["column"]): x["value"] for x in SC.group_quantiles(df, ["g"], ["v", "w"], q, small).collect()}
    want = {}
    for g in {g for g, _ in ROWS}:
        vs = np.array([v for k, v in ROWS if k == g and v is not None])
        if len(vs) and g != "inf":
            want[g, "v"], want[g, "w"] = np.quantile(vs, q), np.quantile(-vs, q)
    assert {k for k in got if k[0] != "inf"} == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12), k


def test_no_buffer_holds_a_large_group(spark):
    """Groups above the bound take no percentile: what is left of a range is collected once it is small."""
    df = spark.createDataFrame(ROWS, "g string, v double")
    got = SC.group_quantiles(df, [], ["v"], 0.5, small=50).collect()
    vs = [v for _, v in ROWS if v is not None]
    assert len(got) == 1 and got[0]["value"] == pytest.approx(float(np.median(vs)))
    assert SC.exact_medians(df.withColumn("x", F.lit(None).cast("double")), ["v", "x"])["x"] is None


def test_flag_keeps_null_groups_and_empty_frames(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0), ("a", None)], "g string, v double")
    got = {(x["g"], x["v"]): x["highlight"] for x in SC.group_quantile_flag(df, "v", ["g"], 0.7).collect()}
    assert got == {(None, 1.0): False, (None, 2.0): True, ("a", 5.0): True, ("a", None): None}
    assert SC.group_quantile_flag(df.limit(0), "v", ["g"]).count() == 0
