"""Hot keys: one key holds about a third of all rows. The skew-safe operators
must spread it over several tasks and still return the exact result."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from turfline.operators.scoring import top_n_per_group
from turfline.operators.serve import search_entities
from turfline.operators.upsert import assign_row_ids, latest_by_key
from turfline.operators.windows import preceding_rows


def _hot_frame(spark, n_hot=3000, n_cold=600, per_cold=10):
    hot = spark.range(n_hot).select(F.lit(0).cast("long").alias("conv"), F.col("id").alias("turn"))
    cold = spark.range(n_cold * per_cold).select((F.col("id") % n_cold + 1).alias("conv"),
                                                 (F.col("id") / n_cold).cast("long").alias("turn"))
    return hot.unionByName(cold).withColumn("v", (F.col("turn") * 7 + F.col("conv")) % 13)


def test_hot_conversation_spreads_over_range_partitions(spark):
    df = _hot_frame(spark)
    idx = assign_row_ids(df, ["conv", "turn"], start=0, id_col="g", num_partitions=8)
    tagged = idx.select("conv", F.spark_partition_id().alias("p"))
    parts = tagged.where(F.col("conv") == 0).select("p").distinct().count()
    assert parts >= 2  # the hot key is not confined to one task
    ids = [r["g"] for r in idx.orderBy("conv", "turn").select("g").collect()]
    assert ids == list(range(len(ids)))


def test_preceding_rows_exact_under_skew(spark):
    df = _hot_frame(spark)
    got = preceding_rows(df, ["conv"], ["turn"], 3, {"v": F.col("v")}, out="prev")
    got = {(r["conv"], r["turn"]): [x["v"] for x in r["prev"]] for r in got.collect()}
    w = Window.partitionBy("conv").orderBy("turn").rowsBetween(-3, -1)
    ref = df.select("conv", "turn", F.collect_list("v").over(w).alias("prev")).collect()
    assert {(r["conv"], r["turn"]): list(r["prev"]) for r in ref} == got


def test_latest_by_key_exact_under_skew(spark):
    df = _hot_frame(spark)
    got = sorted(map(tuple, latest_by_key(df, ["conv"], ["turn"]).collect()))
    ref = sorted(map(tuple, df.groupBy("conv").agg(F.max("turn").alias("turn"))
                     .join(df, ["conv", "turn"]).select("conv", "turn", "v").collect()))
    assert got == ref


def test_top_n_hot_group(spark):
    df = _hot_frame(spark)
    got = top_n_per_group(df, ["conv"], [F.col("turn").desc()], 2).where(F.col("conv") == 0)
    assert sorted(r["turn"] for r in got.collect()) == [2998, 2999]


def test_search_regex_option(spark):
    players = spark.createDataFrame(
        [(1, "Saka", "Arsenal", 1, 2, 3, 5.0), (2, "Salah", "Liverpool", 0, 0, 1, None),
         (3, "Kane", "Bayern", 2, 1, 4, 8.0)],
        "id int, web_name string, team_name string, goals_scored int, assists int, total_points int, form double")
    pats = spark.createDataFrame([("sa",), ("^ka",)], "pattern string")
    lit = {(r["pattern"], r["id"]) for r in search_entities(players, pats).collect()}
    rx = {(r["pattern"], r["id"]) for r in search_entities(players, pats, regex=True).collect()}
    assert lit == {("sa", 1), ("sa", 2)}
    assert rx == {("sa", 1), ("sa", 2), ("^ka", 3)}
