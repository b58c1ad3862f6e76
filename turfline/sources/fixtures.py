"""Typed sports tables derived from the driver tables (the ``fx_*`` views).

The derivations are written with the DataFrame API; ``turfline.plans.oracle``
holds the equivalent SQL used by the DuckDB oracle. Both follow FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.sources.tables import read_table


def _round_no(ts_col: str) -> F.Column:
    return ((F.year(ts_col) - 1995) * 12 + F.month(ts_col)).cast("bigint")


def fx_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("short_name"),
        (F.lit(1) + (F.col("n_nationkey") * 7) % 5).cast("bigint").alias("strength"),
    )


def fx_history_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("player_id"),
        _round_no("o_orderdate").alias("round"),
        k.alias("seq"),
        (F.floor("o_totalprice").cast("bigint") % 16).alias("total_points"),
        (k % 3).alias("goals_scored"),
        (k % 4).alias("assists"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("bigint").alias("clean_sheets"),
        (k % 91).alias("minutes"),
        (k % 4).alias("bonus"),
        ((k * 13) % 60).alias("bps"),
    )


def fx_player_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History after the composite-key upsert: the latest ``seq`` per (player, round)."""
    from turfline.operators.upsert import latest_by_key

    return latest_by_key(fx_history_raw(spark, sf_dir), ["player_id", "round"], ["seq"])


HISTORY_SUMS = ["total_points", "goals_scored", "assists", "clean_sheets", "minutes", "bonus", "bps"]


def fx_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    h = (fx_player_history(spark, sf_dir)
         .groupBy("player_id")
         .agg(*[F.sum(x).cast("bigint").alias(f"h_{x}") for x in HISTORY_SUMS]))
    ck = F.col("c_custkey")
    j = c.join(h, ck == h.player_id, "left")
    chance = (F.when(ck % 7 == 0, F.lit(None).cast("int"))
              .when(ck % 7 == 1, 0).when(ck % 7 == 2, 50).when(ck % 7 == 3, 75).otherwise(100))
    news = (F.when(ck % 11 == 0, F.lit("Hamstring injury - 50% chance of playing"))
            .when(ck % 11 == 1, F.lit("Joined on loan"))
            .when(ck % 11 == 2, F.lit("Will return soon"))
            .when(ck % 11 == 3, F.lit(None).cast("string"))
            .otherwise(F.lit("")))
    return j.select(
        ck.alias("id"),
        F.col("c_name").alias("web_name"),
        F.when(ck % 101 == 100, F.lit(99)).otherwise(F.col("c_nationkey")).cast("bigint").alias("team_id"),
        F.when(ck % 97 == 0, F.lit(5).cast("bigint")).otherwise(1 + ck % 4).alias("position"),
        F.when(ck % 53 == 0, F.lit(0).cast("bigint"))
         .otherwise(F.coalesce("h_total_points", F.lit(0).cast("bigint"))).alias("total_points"),
        (40 + ck % 90).alias("now_cost"),
        (((ck * 37) % 1000).cast("double") / 10.0).alias("selected_by_pct"),
        F.when((ck % 53 == 0) | (ck % 59 == 0), F.lit(0).cast("bigint"))
         .otherwise(F.coalesce("h_minutes", F.lit(0).cast("bigint"))).alias("minutes"),
        *[F.coalesce(f"h_{x}", F.lit(0).cast("bigint")).alias(x)
          for x in ["goals_scored", "assists", "clean_sheets", "bonus"]],
        F.when(ck % 89 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("c_acctbal") / 1000.0).alias("form"),
        (F.coalesce("h_bps", F.lit(0).cast("bigint")).cast("double") / 10.0).alias("ict_index"),
        chance.alias("chance_of_playing_next_round"),
        news.alias("news"),
    )


def fx_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    f = o.select(
        F.col("o_orderkey").alias("id"),
        _round_no("o_orderdate").alias("gameweek"),
        F.col("o_orderdate").alias("kickoff_time"),
        (F.col("o_custkey") % 23).alias("team_h"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("finished"),
    )
    fin = F.col("finished") == 1
    return f.select(
        "id", "gameweek", "kickoff_time", "team_h",
        ((F.col("team_h") + 1 + F.col("id") % 22) % 23).alias("team_a"),
        F.when(fin, F.col("id") % 5).alias("team_h_score"),
        F.when(fin, (F.col("id") * 3) % 4).alias("team_a_score"),
        "finished",
    )


def fx_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), "source",
        F.substring("text", 1, 60).alias("title"),
        F.md5("text").alias("url"),
        F.col("text").alias("body"),
    )


def fx_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark")
    words = b.select("item_id", F.posexplode(F.split("text", " ")).alias("p", "web_name")).where(F.length("web_name") >= 3)
    names = words.groupBy("web_name").agg(F.min(F.col("item_id") * 100000 + F.col("p")).alias("id"))
    return names.withColumn("minutes", F.when(F.col("id") % 5 == 0, F.lit(0).cast("bigint")).otherwise(F.col("id") % 91))


def fx_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"),
                    "conv_id", "turn", "role", F.col("text").alias("query"))


def fx_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx_players(spark, sf_dir)
    i = F.col("id")
    return p.select(
        "id", "position",
        F.when(i % 71 == 0, F.lit(18.0))
         .otherwise(((i * 7) % 81).cast("double") / 10.0 - 0.5).alias("raw_pred"),
        (((i * 11) % 80).cast("double") / 10.0).alias("actual"),
    )
