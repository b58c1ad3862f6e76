"""Raw-format inputs derived from the driver tables (JSON payloads, XML feeds).

These stand in for what the HTTP endpoints and feeds deliver, so the ingest
operators can be checked against the tables they were built from. Files go to
the shared folder named by ``spark.checkpoint.dir``. Every payload document is
bounded: rows are grouped by id ranges, never by an entity that could hold an
unbounded share of the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.session import ensure_checkpoint_dir
from turfline.sources import fixtures as FX
from turfline.sources.tables import read_table

HISTORY_DOC_ROWS = 1024   # history rows per payload document (seq range)
SNAPSHOT_DOC_ROWS = 256   # players per snapshot document (id range)
FIXTURE_DOC_ROWS = 1024   # fixtures per payload document
FEED_DOC_ITEMS = 64       # pages per feed document


def raw_dir(spark: SparkSession, sf_dir: str, kind: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "raw", os.path.basename(sf_dir.rstrip("/")), kind)


def _write_text(df: DataFrame, path: str) -> str:
    df.select(F.col("value")).write.mode("overwrite").text(path)
    return path


def write_history_payloads(spark: SparkSession, sf_dir: str, corrupt_every: int | None = None) -> str:
    """One JSON document per (player, seq range): {"player_id": p, "history": [...]}.
    With ``corrupt_every`` the documents of players with id % n == 0 are truncated."""
    h = FX.fx_history_raw(spark, sf_dir)
    item = F.struct("round", "seq", "total_points", "goals_scored", "assists", "clean_sheets",
                    "minutes", "bonus", "bps")
    docs = (h.groupBy("player_id", F.floor(F.col("seq") / HISTORY_DOC_ROWS).alias("_b"))
             .agg(F.to_json(F.struct(F.col("player_id"), F.collect_list(item).alias("history"))).alias("value")))
    if corrupt_every:
        bad = F.col("player_id") % corrupt_every == 0
        docs = docs.withColumn("value", F.when(bad, F.expr("substring(value, 1, length(value) - 7)"))
                               .otherwise(F.col("value")))
    kind = "history_bad" if corrupt_every else "history"
    return _write_text(docs.select("value"), raw_dir(spark, sf_dir, kind))


def _str(c: str, junk_every: int | None = None, key: str = "id") -> F.Column:
    s = F.col(c).cast("string")
    if junk_every:
        s = F.when(F.col(key) % junk_every == 0, F.lit("n/a")).otherwise(s)
    return s


def write_snapshot(spark: SparkSession, sf_dir: str) -> str:
    """Snapshot documents {"teams": [...], "elements": [...]} with numbers written
    as strings (some non-numeric); even documents use ``selected_by_percent``,
    odd ones the alternate key ``selected_by_pct``."""
    p = FX.fx_players(spark, sf_dir).withColumn("_b", F.floor(F.col("id") / SNAPSHOT_DOC_ROWS))
    t = FX.fx_teams(spark, sf_dir).withColumn("_b", F.floor(F.col("id") / SNAPSHOT_DOC_ROWS))
    common = [F.col("id"), F.col("web_name"), F.col("team_id").alias("team"),
              F.col("position").alias("element_type"), _str("total_points", 13).alias("total_points"),
              _str("now_cost").alias("now_cost"), _str("minutes").alias("minutes"),
              _str("goals_scored").alias("goals_scored"), _str("assists").alias("assists"),
              _str("clean_sheets").alias("clean_sheets"), _str("bonus").alias("bonus"),
              _str("form").alias("form"), _str("ict_index").alias("ict_index"),
              _str("chance_of_playing_next_round").alias("chance_of_playing_next_round"), F.col("news")]
    even = F.col("_b") % 2 == 0
    el = F.when(even, F.to_json(F.struct(*common, _str("selected_by_pct").alias("selected_by_percent")))) \
          .otherwise(F.to_json(F.struct(*common, _str("selected_by_pct").alias("selected_by_pct"))))
    pe = p.groupBy("_b").agg(F.collect_list(el).alias("els"))
    te = t.groupBy("_b").agg(F.collect_list(F.to_json(F.struct(
        "id", "name", "short_name", _str("strength", 7).alias("strength")))).alias("tms"))
    docs = pe.join(te, "_b", "full_outer").select(F.concat(
        F.lit('{"teams": ['), F.coalesce(F.array_join("tms", ","), F.lit("")),
        F.lit('], "elements": ['), F.coalesce(F.array_join("els", ","), F.lit("")), F.lit("]}")).alias("value"))
    return _write_text(docs, raw_dir(spark, sf_dir, "snapshot"))


def write_fixture_payloads(spark: SparkSession, sf_dir: str) -> str:
    """JSON arrays of fixture objects; ``finished`` is true/false, or null for some."""
    f = FX.fx_fixtures(spark, sf_dir)
    fin = F.when(F.col("id") % 13 == 0, F.lit(None).cast("boolean")).otherwise(F.col("finished") == 1)
    obj = F.to_json(F.struct("id", F.col("gameweek").alias("event"),
                             F.date_format("kickoff_time", "yyyy-MM-dd'T'HH:mm:ss").alias("kickoff_time"),
                             "team_h", "team_a", "team_h_score", "team_a_score", fin.alias("finished")),
                    {"ignoreNullFields": "false"})
    docs = (f.groupBy(F.floor(F.col("id") / FIXTURE_DOC_ROWS).alias("_b"))
             .agg(F.concat(F.lit("["), F.array_join(F.collect_list(obj), ","), F.lit("]")).alias("value")))
    return _write_text(docs.select("value"), raw_dir(spark, sf_dir, "fixtures"))


def _xml_escape(c: F.Column) -> F.Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


PAGE_TITLE_RE = r"<title>(.*?)</title>"


def write_feeds(spark: SparkSession, sf_dir: str) -> str:
    """Feed documents from ``pages``: even feeds are RSS (item/title/link/description),
    odd feeds Atom (entry/title/link@href/id/summary). One file per feed."""
    pages = read_table(spark, sf_dir, "pages").withColumn("_b", F.floor(F.col("page_id") / FEED_DOC_ITEMS))
    title = _xml_escape(F.regexp_extract("html", PAGE_TITLE_RE, 1))
    url = _xml_escape(F.col("url"))
    body = _xml_escape(F.col("html"))
    rss_item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), url,
                        F.lit("</link><description>"), body, F.lit("</description></item>"))
    atom_item = F.concat(F.lit("<entry><title>"), title, F.lit('</title><link href="'), url,
                         F.lit('"/><id>'), url, F.lit("</id><summary>"), body, F.lit("</summary></entry>"))
    items = pages.select("_b", "page_id", F.when(F.col("_b") % 2 == 0, rss_item).otherwise(atom_item).alias("x"))
    docs = items.groupBy("_b").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "x"))),
                                                            lambda s: s["x"]), "").alias("xs"))
    docs = docs.select("_b", F.when(F.col("_b") % 2 == 0,
                                    F.concat(F.lit("<rss><channel><title>feed</title>"), F.col("xs"),
                                             F.lit("</channel></rss>")))
                       .otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>'),
                                           F.col("xs"), F.lit("</feed>"))).alias("value"))
    path = raw_dir(spark, sf_dir, "feeds")
    # One file per feed, named by the feed number (the feed's identity).
    docs.repartition("_b").write.mode("overwrite").partitionBy("_b").text(path)
    return path
