"""Catalog entries: raw-format ingest (JSON payloads, XML feeds) and scalar JSON.

The raw inputs are written from the driver tables (``turfline.sources.raw``),
so each oracle is the source table expressed in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.plans.catalog import register
from turfline.plans.queries.q_text import STRIP_SQL
from turfline.sources import ingest as IN
from turfline.sources import raw as RAW
from turfline.sources.tables import read_table

HIST_COLS = ["player_id", "round", "seq", "total_points", "goals_scored", "assists", "clean_sheets",
             "minutes", "bonus", "bps"]


@register("ingest_history_explode", oracle="SELECT " + ", ".join(HIST_COLS) + " FROM fx_history_raw",
          fx=["fx_history_raw"])
def q_ingest_history_explode(spark, sf):
    path = RAW.write_history_payloads(spark, sf)
    rows, _bad = IN.ingest_history(IN.read_documents(spark, path))
    return rows.select(*HIST_COLS)


@register("ingest_skip_bad", oracle="SELECT " + ", ".join(HIST_COLS) + " FROM fx_history_raw WHERE player_id % 17 <> 0",
          fx=["fx_history_raw"])
def q_ingest_skip_bad(spark, sf):
    path = RAW.write_history_payloads(spark, sf, corrupt_every=17)
    rows, _bad = IN.ingest_history(IN.read_documents(spark, path))
    return rows.select(*HIST_COLS)


@register("ingest_reject_count", oracle="""
SELECT COUNT(*) AS rejected FROM (SELECT DISTINCT player_id, FLOOR(seq / 1024) FROM fx_history_raw WHERE player_id % 17 = 0) t""",
          fx=["fx_history_raw"])
def q_ingest_reject_count(spark, sf):
    path = RAW.write_history_payloads(spark, sf, corrupt_every=17)
    _rows, bad = IN.ingest_history(IN.read_documents(spark, path))
    return bad.agg(F.count(F.lit(1)).alias("rejected"))


@register("ingest_json_snapshot", oracle="""
SELECT id, web_name, team_id, position, CASE WHEN id % 13 = 0 THEN NULL ELSE total_points END AS total_points,
       now_cost, selected_by_pct, minutes, goals_scored, assists, clean_sheets, bonus, form, ict_index,
       chance_of_playing_next_round, COALESCE(news, '') AS news
FROM fx_players""", fx=["fx_players"], rounded=["selected_by_pct", "form", "ict_index"])
def q_ingest_json_snapshot(spark, sf):
    path = RAW.write_snapshot(spark, sf)
    _teams, players, _bad = IN.ingest_snapshot(IN.read_documents(spark, path))
    return players.select("id", "web_name", "team_id", "position", "total_points", "now_cost", "selected_by_pct",
                          "minutes", "goals_scored", "assists", "clean_sheets", "bonus", "form", "ict_index",
                          "chance_of_playing_next_round", "news")


@register("ingest_json_snapshot_teams", oracle="""
SELECT id, name, short_name, CASE WHEN id % 7 = 0 THEN NULL ELSE strength END AS strength FROM fx_teams""",
          fx=["fx_teams"])
def q_ingest_json_snapshot_teams(spark, sf):
    path = RAW.write_snapshot(spark, sf)
    teams, _players, _bad = IN.ingest_snapshot(IN.read_documents(spark, path))
    return teams


@register("ingest_fixtures", oracle="""
SELECT id, gameweek, strftime(kickoff_time, '%Y-%m-%d %H:%M:%S') AS kickoff_time, team_h, team_a,
       team_h_score, team_a_score, CASE WHEN id % 13 = 0 THEN 0 ELSE finished END AS finished
FROM fx_fixtures""", fx=["fx_fixtures"])
def q_ingest_fixtures(spark, sf):
    path = RAW.write_fixture_payloads(spark, sf)
    f, _bad = IN.ingest_fixtures(IN.read_documents(spark, path))
    return f.select("id", "gameweek", F.date_format("kickoff_time", "yyyy-MM-dd HH:mm:ss").alias("kickoff_time"),
                    "team_h", "team_a", "team_h_score", "team_a_score", "finished")


FEED_SQL = f"""
SELECT title, url, body FROM (
  SELECT regexp_replace(regexp_extract(p.html, '<title>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g') AS title,
         regexp_replace(p.url, '^\\s+|\\s+$', '', 'g') AS url, s.text AS body
  FROM pages p JOIN ({STRIP_SQL}) s ON p.page_id = s.page_id) t
WHERE title <> '' AND url <> ''"""


@register("ingest_rss_items", oracle=FEED_SQL)
def q_ingest_rss_items(spark, sf):
    path = RAW.write_feeds(spark, sf)
    docs = spark.read.text(path, wholetext=True).select("value", F.lit("feed").alias("source"))
    return IN.parse_feed_items(docs).select("title", "url", "body")


@register("feed_union", oracle=f"""
SELECT 'Feed ' || CAST(CAST(FLOOR(page_id / 64) AS BIGINT) AS VARCHAR) AS source, title, url FROM (
  SELECT p.page_id, regexp_replace(regexp_extract(p.html, '<title>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g') AS title,
         p.url FROM pages p) t
WHERE title <> '' AND url <> ''""")
def q_feed_union(spark, sf):
    path = RAW.write_feeds(spark, sf)
    pages = read_table(spark, sf, "pages")
    # The feeds dimension: one row per configured feed (number -> display name).
    feeds = (pages.select(F.floor(F.col("page_id") / RAW.FEED_DOC_ITEMS).cast("long").alias("feed_no")).distinct()
             .select("feed_no", F.concat(F.lit("Feed "), F.col("feed_no").cast("string")).alias("source")))
    return IN.feed_union(spark, path, feeds).select("source", "title", "url")


@register("json_scalar", oracle="""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q_json_scalar(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
