"""Catalog entries: upsert, insert-if-absent, ids, schema evolution, watermarks, refresh."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.operators import text as TX
from turfline.operators import upsert as UP
from turfline.operators.stores import KeyedTable
from turfline.plans.catalog import register
from turfline.plans.queries.q_text import CARD_SQL
from turfline.sources import fixtures as FX
from turfline.sources.tables import read_table
from turfline.streaming.jobs import run_dir

BATCH_TS = "2024-06-01 00:00:00"


@register("upsert_composite_key", oracle="SELECT * FROM fx_player_history", fx=["fx_player_history"])
def q_upsert_composite_key(spark, sf):
    return UP.latest_by_key(FX.fx_history_raw(spark, sf), ["player_id", "round"], ["seq"])


TEAM_UPDATES_SQL = """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'T' || CAST(n_nationkey AS VARCHAR) AS short_name,
       CAST(1 + (n_nationkey * 3) % 5 AS BIGINT) AS strength, 1 AS seq FROM nation WHERE n_regionkey = 1
UNION ALL
SELECT CAST(n_nationkey AS BIGINT), n_name, 'T' || CAST(n_nationkey AS VARCHAR),
       CAST(1 + (n_nationkey * 2) % 5 AS BIGINT), 2 FROM nation WHERE n_regionkey = 1
UNION ALL
SELECT CAST(100 + r_regionkey AS BIGINT), r_name, 'R' || CAST(r_regionkey AS VARCHAR), CAST(3 AS BIGINT), 1 FROM region"""


def team_updates(spark, sf):
    n = read_table(spark, sf, "nation").where(F.col("n_regionkey") == 1)
    r = read_table(spark, sf, "region")
    key = F.col("n_nationkey")
    base = [key.cast("bigint").alias("id"), F.col("n_name").alias("name"),
            F.concat(F.lit("T"), key.cast("string")).alias("short_name")]
    v1 = n.select(*base, (1 + (key * 3) % 5).cast("bigint").alias("strength"), F.lit(1).alias("seq"))
    v2 = n.select(*base, (1 + (key * 2) % 5).cast("bigint").alias("strength"), F.lit(2).alias("seq"))
    new = r.select((100 + F.col("r_regionkey")).cast("bigint").alias("id"), F.col("r_name").alias("name"),
                   F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("short_name"),
                   F.lit(3).cast("bigint").alias("strength"), F.lit(1).alias("seq"))
    return v1.unionByName(v2).unionByName(new)


@register("upsert_by_key", oracle="""
SELECT id, name, short_name, strength FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY v DESC, seq DESC) AS rn FROM (
    SELECT id, name, short_name, strength, 0 AS v, 0 AS seq FROM fx_teams
    UNION ALL SELECT id, name, short_name, strength, 1, seq FROM upd) a) b
WHERE rn = 1""", fx=["fx_teams"], ctes=[("upd", TEAM_UPDATES_SQL)])
def q_upsert_by_key(spark, sf):
    return UP.upsert_by_key(FX.fx_teams(spark, sf), team_updates(spark, sf), ["id"], ["seq"])


STORED_NEWS_SQL = """
SELECT id, source, title, url, body FROM (
  SELECT n.*, ROW_NUMBER() OVER (PARTITION BY n.url ORDER BY n.id) AS rn
  FROM fx_news n JOIN documents d ON n.id = d.doc_id WHERE d.lang = 'en') t WHERE rn = 1"""

NEW_NEWS_SQL = """
SELECT id, source, title, url, body FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY url ORDER BY id) AS rn FROM fx_news) t
WHERE rn = 1 AND url NOT IN (SELECT url FROM stored)"""


def stored_news(spark, sf):
    """The article table as stored before this batch: English documents, unique url."""
    docs = read_table(spark, sf, "documents").where(F.col("lang") == "en").select(F.col("doc_id").alias("id"))
    return UP.first_by_key(FX.fx_news(spark, sf).join(docs, "id", "left_semi"), ["url"], ["id"])


@register("insert_if_absent", oracle="SELECT id, url FROM new_rows", fx=["fx_news"],
          ctes=[("stored", STORED_NEWS_SQL), ("new_rows", NEW_NEWS_SQL)])
def q_insert_if_absent(spark, sf):
    # The table stored before the batch, in buckets with Bloom filters; the batch is all news.
    news = FX.fx_news(spark, sf)
    table = KeyedTable(spark, os.path.join(run_dir(spark, "articles"), "table"), news.schema, "url", "id")
    table.insert(stored_news(spark, sf))
    return table.insert(news)[0].select("id", "url")


@register("insert_if_absent_count", oracle="""
SELECT COUNT(*) AS inserted, COUNT(*) + (SELECT COUNT(*) FROM stored) AS total FROM new_rows""",
          fx=["fx_news"], ctes=[("stored", STORED_NEWS_SQL), ("new_rows", NEW_NEWS_SQL)])
def q_insert_if_absent_count(spark, sf):
    news = FX.fx_news(spark, sf)
    table = KeyedTable(spark, os.path.join(run_dir(spark, "articles"), "table"), news.schema, "url", "id")
    table.insert(stored_news(spark, sf))
    inserted = table.insert(news)[0].agg(F.count(F.lit(1)).alias("inserted"))
    return inserted.select("inserted", table.read().agg(F.count(F.lit(1))).scalar().alias("total"))


@register("anti_join_new", oracle="SELECT id, url FROM fx_news WHERE url NOT IN (SELECT url FROM stored)",
          fx=["fx_news"], ctes=[("stored", STORED_NEWS_SQL)])
def q_anti_join_new(spark, sf):
    stored = stored_news(spark, sf)
    return FX.fx_news(spark, sf).join(stored.select("url"), "url", "left_anti").select("id", "url")


@register("assign_row_ids", oracle="""
SELECT url, (SELECT MAX(id) FROM stored) + ROW_NUMBER() OVER (ORDER BY id) AS row_id FROM new_rows""",
          fx=["fx_news"], ctes=[("stored", STORED_NEWS_SQL), ("new_rows", NEW_NEWS_SQL)])
def q_assign_row_ids(spark, sf):
    stored = stored_news(spark, sf)
    new = UP.insert_if_absent(stored, FX.fx_news(spark, sf))
    start = stored.agg((F.max("id") + 1).alias("start"))
    return UP.assign_row_ids(new.select("id", "url"), ["id"], start=start).select("url", "row_id")


@register("stamp_ingest_time", oracle=f"""
SELECT id, strftime(CAST('{BATCH_TS}' AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS fetched_at FROM fx_players""",
          fx=["fx_players"])
def q_stamp_ingest_time(spark, sf):
    p = UP.stamp_ingest_time(FX.fx_players(spark, sf).select("id"), BATCH_TS)
    return p.select("id", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))


@register("schema_add_columns", oracle="""
SELECT id, web_name, CAST(NULL AS DOUBLE) AS form, CAST(NULL AS VARCHAR) AS news, CAST(NULL AS DOUBLE) AS ict_index,
       CAST(NULL AS DOUBLE) AS xg_scored, CAST(NULL AS DOUBLE) AS xa FROM fx_players""", fx=["fx_players"])
def q_schema_add_columns(spark, sf):
    full = FX.fx_players(spark, sf)
    target = T.StructType(list(full.schema.fields) + [T.StructField("xg_scored", T.DoubleType()),
                                                      T.StructField("xa", T.DoubleType())])
    old = full.drop("form", "news", "ict_index")
    once = UP.schema_add_columns(old, target)
    twice = UP.schema_add_columns(once, target)  # idempotent
    return twice.select("id", "web_name", "form", "news", "ict_index", "xg_scored", "xa")


def news_state(spark, sf):
    """State table as left by the previous run: the mark is the newest article of
    the first source, and player cards are not embedded yet."""
    docs = read_table(spark, sf, "documents")
    mark = docs.where(F.col("source") == "src0").agg(F.max("doc_id").cast("string").alias("value"))
    state = mark.select(F.lit("last_news_id").alias("key"), "value")
    flag = docs.agg(F.lit("players_embedded").alias("key"), F.lit("0").alias("value"))
    return state.unionByName(flag)


MARK_SQL = "SELECT CAST(MAX(doc_id) AS BIGINT) AS mark FROM documents WHERE source = 'src0'"


@register("incremental_since_watermark", oracle="SELECT id, url FROM fx_news WHERE id > (SELECT mark FROM m)",
          fx=["fx_news"], ctes=[("m", MARK_SQL)])
def q_incremental_since_watermark(spark, sf):
    mark = UP.watermark_value(news_state(spark, sf), "last_news_id")
    return UP.incremental_since_watermark(FX.fx_news(spark, sf), mark).select("id", "url")


@register("advance_watermark", oracle="""
SELECT COALESCE((SELECT MAX(id) FROM fx_news WHERE id > (SELECT mark FROM m)), (SELECT mark FROM m)) AS mark""",
          fx=["fx_news"], ctes=[("m", MARK_SQL)])
def q_advance_watermark(spark, sf):
    state = news_state(spark, sf)
    mark = UP.watermark_value(state, "last_news_id")
    batch = UP.incremental_since_watermark(FX.fx_news(spark, sf), mark)
    return UP.advance_watermark(batch, mark)


@register("state_kv_upsert", oracle="""
SELECT 'last_news_id' AS key, CAST((SELECT MAX(id) FROM fx_news) AS VARCHAR) AS value
UNION ALL SELECT 'players_embedded', '1'""", fx=["fx_news"])
def q_state_kv_upsert(spark, sf):
    state = news_state(spark, sf)
    mark = FX.fx_news(spark, sf).agg(F.max("id").cast("string").alias("value"))
    state = UP.state_set(state, "last_news_id", mark)
    return UP.state_set(state, "players_embedded", "1")


def refreshed_players(spark, sf):
    """A new stats batch: players who played, with updated totals."""
    p = FX.fx_players(spark, sf).where(F.col("minutes") > 0)
    return p.withColumn("total_points", F.col("total_points") + F.col("goals_scored"))


REFRESHED_CARD_SQL = CARD_SQL.replace("FROM fx_players", "FROM (SELECT * REPLACE (total_points + goals_scored AS total_points) FROM fx_players WHERE minutes > 0) r")


@register("refresh_by_key", oracle=f"""
SELECT type, name, md5(page_content) AS content_md5 FROM ({CARD_SQL}) s
WHERE name NOT IN (SELECT name FROM ({REFRESHED_CARD_SQL}) n)
UNION ALL SELECT type, name, md5(page_content) FROM ({REFRESHED_CARD_SQL}) n2""", fx=["fx_players"])
def q_refresh_by_key(spark, sf):
    stored = TX.player_documents(FX.fx_players(spark, sf))
    batch = TX.player_documents(refreshed_players(spark, sf))
    out = UP.refresh_by_key(stored, batch, "name")
    return out.select("type", "name", F.md5("page_content").alias("content_md5"))
