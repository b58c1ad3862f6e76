"""Unit tests on hand-made frames: quirks, bin edges, NULL rules, ties."""
import math

import pytest
from pyspark.sql import functions as F

from turfline import constants as K
from turfline.functions.columns import (clip_col, keyword_flag, one_hot, right_closed_tier,
                                        round_half_even, safe_div)
from turfline.operators import scoring as SC
from turfline.operators import text as TX


def _vals(df, col):
    return [r[col] for r in df.collect()]


def test_round_half_even_numpy_style(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (2.5,), (-0.125,)], "x double")
    out = _vals(df.select(round_half_even("x", 2).alias("r")), "r")
    assert out[0] == 0.12 and out[2] == 2.5 and out[3] == -0.12


def test_form_tier_right_closed_edges(spark):
    df = spark.createDataFrame([(-0.01,), (0.0,), (2.0,), (2.01,), (7.0,), (100.0,), (100.5,), (None,)], "f double")
    out = _vals(df.select(right_closed_tier("f", K.FORM_EDGES, K.FORM_LABELS).alias("t")), "t")
    assert out == [None, "cold", "cold", "average", "hot", "elite", None, None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (20.0,), (3.0,)], "x double")
    assert _vals(df.select(clip_col("x", 0.0, 15.0).alias("c")), "c") == [None, 0.0, 15.0, 3.0]


def test_keyword_substring_quirk_and_whole_word(spark):
    df = spark.createDataFrame([("Will return soon",), (None,), ("Knock",)], "news string")
    sub = _vals(df.select(keyword_flag("news", K.INJURY_KEYWORDS).alias("f")), "f")
    whole = _vals(df.select(keyword_flag("news", K.INJURY_KEYWORDS, whole_word=True).alias("f")), "f")
    assert sub == [1, 0, 1]      # 'ill' inside 'will' (kept as default)
    assert whole == [0, 0, 1]


def test_safe_div_is_null_on_zero(spark):
    df = spark.createDataFrame([(3, 0), (3, 2)], "a int, b int")
    assert _vals(df.select(safe_div("a", "b").alias("q")), "q") == [None, 1.5]


def test_one_hot_unknown_is_all_zero(spark):
    df = spark.createDataFrame([("DEF",), (None,), ("XXX",)], "p string")
    rows = df.select(*one_hot("p", ["DEF", "FWD"], "pos")).collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 0), (0, 0)]


def test_intent_routing(spark):
    df = spark.createDataFrame([("Is he injured?",), ("What is his price",), ("injury and price",),
                                ("captain pick for gw",), ("hello",)], "q string")
    out = _vals(df.select(TX.classify_intent("q").alias("i")), "i")
    # 'pick' is a stats word; 'captain' alone would be 'both'
    assert out == ["rag", "ml", "both", "ml", "both"]


def test_proper_noun_first_capitalised_not_stopword(spark):
    df = spark.createDataFrame([("Should I start Salah?",), ("Any update on Saka",), ("no names",),
                                ("B.Fernandes fit?",)], "q string")
    out = _vals(df.select(TX.detect_proper_noun("q").alias("n")), "n")
    assert out == ["Salah", "Any", None, "Fernandes"]


def test_advice_thresholds_and_unknown_position(spark):
    rows = [(5.0, "GKP", 0, True), (4.99, "GKP", 0, True), (3.5, "DEF", 0, True), (6.0, None, 0, True),
            (9.0, "FWD", 1, True), (9.0, "FWD", 0, False), (1.0, "MID", 0, True)]
    df = spark.createDataFrame(rows, "xp double, position_name string, has_injury_news int, is_available boolean")
    out = _vals(df.select(SC.classify_advice().alias("a")), "a")
    assert out == [K.ADVICE_STRONG, K.ADVICE_GOOD, K.ADVICE_GOOD, K.ADVICE_STRONG, K.ADVICE_AVOID_STATUS,
                   K.ADVICE_AVOID_STATUS, K.ADVICE_AVOID_LOW]


def test_regression_metrics_r2_is_one_minus_sse_over_sst(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "actual double, pred double")
    r = SC.regression_metrics(df).first()
    sse = 0.25 + 0 + 1.0
    sst = 1.0 + 0 + 1.0
    assert math.isclose(r["r2"], 1 - sse / sst)
    assert math.isclose(r["mae"], 1.5 / 3)


def test_median_imputation_interpolates(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, None)], "id int, x double")
    out = SC.impute_median(df, ["x"]).orderBy("id").collect()
    assert out[2]["x"] == 2.5


def test_histogram_constant_group(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 1.0)], "g string, v double")
    rows = SC.histogram_by_group(df, "v", ["g"], bins=20).collect()
    assert len(rows) == 1 and rows[0]["bin"] == 10 and rows[0]["count"] == 2


def test_top_n_per_group_ties_broken_by_id(spark):
    df = spark.createDataFrame([("A", 1, 5.0), ("A", 2, 5.0), ("A", 3, 4.0)], "g string, id int, s double")
    out = SC.top_n_per_group(df, ["g"], [F.col("s").desc(), F.col("id")], 1).collect()
    assert [r["id"] for r in out] == [1]


def test_rank_all_matches_sorted_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    out = SC.rank_all(df, ["k"]).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 1001))
    assert [r["k"] for r in out] == sorted(r["k"] for r in out)
