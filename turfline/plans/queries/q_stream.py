"""Catalog entries: streaming jobs, checked against the batch result over the full table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from turfline.plans.catalog import register
from turfline.plans.queries.q_index import NEWS_DOCS_SQL, index_sql, vector_digest
from turfline.sources import fixtures as FX
from turfline.sources.tables import read_table
from turfline.streaming import jobs as SJ


@register("stream_upsert", oracle="""
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t
WHERE rn = 1""", rounded=["value"])
def q_stream_upsert(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    base = SJ.run_dir(spark, "events")
    src = os.path.join(base, "source")
    # Files by day, several for a day that lies in several ranges; a micro-batch takes seven files.
    events.withColumn("day", F.to_date("ts")).repartitionByRange("day", "event_id").write.partitionBy("day").parquet(src)
    table = SJ.stream_upsert(spark, src, events.schema, ["user_id"], ["ts", "event_id"], max_files=7,
                             base=os.path.join(base, "out"))
    return table.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                        "event_type", "value")


FIRST_NEWS_SQL = """
SELECT id, url FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY url ORDER BY id) AS rn FROM fx_news) t WHERE rn = 1"""


def _news_stream(spark, sf, index: bool):
    news = FX.fx_news(spark, sf)
    base = SJ.run_dir(spark, "news")
    src = SJ.write_ordered_files(news, "id", os.path.join(base, "source"), parts=4)
    return SJ.stream_insert_if_absent(spark, src, news.schema, "url", "id", max_files=1,
                                      base=os.path.join(base, "out"), index=index, chunker="fixed")


@register("stream_insert_if_absent", oracle=FIRST_NEWS_SQL, fx=["fx_news"])
def q_stream_insert_if_absent(spark, sf):
    table, _ = _news_stream(spark, sf, index=False)
    return table.select("id", "url")


@register("stream_refresh_index", oracle=f"""
SELECT article_id, chunk_no, content_hash, vector FROM ({index_sql(f"SELECT * FROM ({NEWS_DOCS_SQL}) n0 WHERE article_id IN (SELECT id FROM ({FIRST_NEWS_SQL}) f)")}) i""",
          fx=["fx_news"])
def q_stream_refresh_index(spark, sf):
    _, idx = _news_stream(spark, sf, index=True)
    return idx.select("article_id", "chunk_no", "content_hash", vector_digest().alias("vector"))
