"""Serving tables: search, comparisons and per-player dashboards for all
entities at once (one job per table, not one request per entity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.functions.columns import round_half_even
from turfline.operators.scoring import top_n_per_group
from turfline.operators.windows import rolling_mean
from turfline.plans.guards import small_side


#: Letters of the grams by which texts are found; shorter patterns have lists of their own length.
GRAM = 3
#: Parts into which the texts of one gram are dealt.
GRAM_PARTS = 16


def _grams(c: Column, q: int) -> Column:
    """The distinct runs of q letters of a text (the text itself for q = 0)."""
    if q == 0:
        return F.array(F.lit(""))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (q - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(q)))
    return F.when(F.length(c) >= q, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def search_texts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, text) for all distinct texts that contain a pattern: texts(text), patterns(pattern), literal.

    A gram index: texts are listed under their runs of three letters (of two, one or no
    letters, as far as there are patterns that short). A pattern looks only at the list of its rarest
    gram, an equi-join dealt to parts, and the texts found there are then verified. A pattern with a
    gram that no text has meets nothing."""
    patterns = patterns.select("pattern").where(F.col("pattern").isNotNull()).distinct()
    size = F.least(F.length("pattern"), F.lit(GRAM))
    own = F.when(size == 0, _grams(F.col("pattern"), 0))
    for q in range(1, GRAM + 1):
        own = own.when(size == q, _grams(F.col("pattern"), q))
    wanted = patterns.select("pattern", size.alias("q"), F.explode(own).alias("gram"))
    # lists of the grams that some pattern has; a text's grams of other sizes are never made
    sizes = [r["q"] for r in wanted.select("q").distinct().collect()]  # at most GRAM + 1
    lists = texts.select("text").where(F.col("text").isNotNull()).distinct().select(
        "text", F.explode(F.concat(*[_grams(F.col("text"), q) for q in sizes] or [F.array().cast("array<string>")])).alias("gram"))
    counts = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    known = wanted.join(counts, "gram", "left").groupBy("pattern").agg(
        F.min(F.col("n").isNotNull()).alias("all"), F.min(F.struct("n", "gram")).alias("rarest"))
    look = known.where("all").select("pattern", F.col("rarest.gram").alias("gram"),
                                     F.explode(F.sequence(F.lit(0), F.lit(GRAM_PARTS - 1))).alias("part"))
    dealt = lists.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(GRAM_PARTS)).cast("int"))
    return look.join(dealt, ["gram", "part"]).where(F.contains("text", "pattern")).select("pattern", "text")


def search_entities(players: DataFrame, patterns: DataFrame, limit: int = 10,
                    regex: bool = False) -> DataFrame:
    """Per pattern: the first ``limit`` players (by id) whose lower-cased name or
    team name contains the lower-cased pattern (literal by default).

    Matching is done on distinct names and team names, of which only the first ``limit`` players
    count, so a team with a third of all players is no larger than any other."""
    pats = patterns.select(F.lower("pattern").alias("pattern")).where(F.col("pattern").isNotNull()).distinct()
    named = players.select("id", F.explode(F.array_distinct(F.array(F.lower("web_name"), F.lower("team_name")))).alias("text"))
    firsts = top_n_per_group(named.where(F.col("text").isNotNull()), ["text"], [F.col("id")], limit, rank_col="_at").drop("_at")
    if regex:  # no gram is sure to occur: every distinct text is tried with every pattern
        texts = firsts.select("text").distinct()
        hits = texts.join(small_side(pats), F.regexp_like("text", F.col("pattern")))
    else:
        hits = search_texts(firsts, pats)
    found = hits.join(firsts, "text").select("pattern", "id").distinct()
    ranked = top_n_per_group(found, ["pattern"], [F.col("id")], limit, rank_col="rank")
    return ranked.join(players, "id").select(
        "pattern", "rank", "id", "web_name", "team_name", "goals_scored", "assists",
        "total_points", (F.coalesce(F.col("form"), F.lit(0.0)) / 10.0).alias("progress"))


COMPARE_METRICS = [("Goals", "goals_scored"), ("Assists", "assists"), ("Points", "total_points"),
                   ("Form", "form")]


def compare_players(players: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (pair_id, p1, p2): a metric x player table (long form)."""
    wide = players.select("id", "web_name", *[c for _, c in COMPARE_METRICS])
    a = wide.select(F.col("id").alias("p1"), F.col("web_name").alias("player1"), F.struct(*[c for _, c in COMPARE_METRICS]).alias("a"))
    b = wide.select(F.col("id").alias("p2"), F.col("web_name").alias("player2"), F.struct(*[c for _, c in COMPARE_METRICS]).alias("b"))
    both = pairs.join(a, "p1").join(b, "p2")
    rows = F.array(*[F.struct(F.lit(label).alias("metric"), F.col("a")[c].cast("double").alias("player1_value"),
                              F.col("b")[c].cast("double").alias("player2_value")) for label, c in COMPARE_METRICS])
    return both.select("pair_id", "player1", "player2", F.inline(rows)).select(
        "pair_id", "metric", "player1", "player1_value", "player2", "player2_value")


def player_history_series(history: DataFrame) -> DataFrame:
    return history.select("player_id", "round", "total_points", "goals_scored", "assists", "minutes")


def rolling_form(history: DataFrame, window: int = 3) -> DataFrame:
    """3-row trailing mean of points by round; NULL until 3 rows exist."""
    return rolling_mean(history.select("player_id", "round", "total_points"), ["player_id"], ["round"],
                        "total_points", window, "form3")


def best_gameweek(history: DataFrame) -> DataFrame:
    """Round and points of each player's best score; the earliest round on ties."""
    best = F.max_by(F.struct("round", "total_points"), F.struct(F.col("total_points"), -F.col("round")))
    return history.groupBy("player_id").agg(best.alias("b")).select(
        "player_id", F.col("b.round").alias("best_round"), F.col("b.total_points").alias("best_points"))


def player_summary(history: DataFrame) -> DataFrame:
    """Mean points (2 dp), total goals, total assists per player."""
    return history.groupBy("player_id").agg(
        round_half_even(F.avg("total_points"), 2).alias("avg_points"),
        F.sum("goals_scored").cast("long").alias("total_goals"),
        F.sum("assists").cast("long").alias("total_assists"))


def player_dashboard(history: DataFrame) -> DataFrame:
    """Per player with history: rounds, latest rolling form, best week, summary."""
    form = rolling_form(history)
    last_form = form.groupBy("player_id").agg(
        F.max_by("form3", "round").alias("last_form3"), F.count(F.lit(1)).alias("n_rounds"))
    return (last_form.join(best_gameweek(history), "player_id")
            .join(player_summary(history), "player_id"))
