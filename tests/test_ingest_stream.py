"""Ingest and streaming behaviour on hand-made inputs."""
import os

from pyspark.sql import functions as F

from turfline.session import ensure_checkpoint_dir
from turfline.sources import ingest as IN
from turfline.streaming import jobs as SJ


def test_corrupt_payload_is_rejected_and_others_continue(spark):
    docs = spark.createDataFrame([('{"player_id": 1, "history": [{"round": 1, "total_points": "3"}]}',),
                                  ('{"player_id": 2, "history": [{"round": 1',),
                                  ('{"player_id": 3, "history": [{"round": "x", "total_points": 4.5}]}',)],
                                 "value string")
    rows, bad = IN.ingest_history(docs)
    got = sorted((r["player_id"], r["round"], r["total_points"]) for r in rows.collect())
    assert got == [(1, 1, 3), (3, None, None)]   # lenient casts: failures become NULL
    assert bad.count() == 1


def test_snapshot_field_fallback_and_news_default(spark):
    docs = spark.createDataFrame([
        ('{"teams": [{"id": "1", "name": "A", "short_name": "AA", "strength": "n/a"}], '
         '"elements": [{"id": "7", "web_name": "X", "team": "1", "element_type": "2", "selected_by_pct": "4.5"},'
         ' {"id": "8", "web_name": "Y", "team": "1", "element_type": "9", "selected_by_percent": "1.0",'
         '  "selected_by_pct": "9.9", "news": "Knock"}]}',)], "value string")
    teams, players, bad = IN.ingest_snapshot(docs)
    assert bad.count() == 0
    assert [tuple(r) for r in teams.collect()] == [(1, "A", "AA", None)]
    p = {r["id"]: r for r in players.collect()}
    assert p[7]["selected_by_pct"] == 4.5 and p[8]["selected_by_pct"] == 1.0
    assert p[7]["news"] == "" and p[8]["news"] == "Knock"


def test_rss_and_atom_items(spark):
    rss = ('<rss><channel><item><title> T1 </title><link>http://a/1</link>'
           '<description>&lt;p&gt;Hello&lt;/p&gt; &amp;amp; more</description></item>'
           '<item><title>no link</title></item></channel></rss>')
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T2</title><link href="http://b/2"/>'
            '<id>urn:2</id><summary>S</summary></entry></feed>')
    docs = spark.createDataFrame([(rss, "r"), (atom, "a")], "value string, source string")
    got = sorted(tuple(r) for r in IN.parse_feed_items(docs).collect())
    assert got == [("a", "T2", "http://b/2", "S"), ("r", "T1", "http://a/1", "Hello  & more")]  # text nodes joined by a space


def test_stream_upsert_equals_batch(spark):
    base = SJ.run_dir(spark, "t-upsert")
    src = os.path.join(base, "src")
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 1, "x"), (1, 2, "b"), (2, 5, "y")],
                               "k int, v int, p string")
    for i in range(3):  # three files, three micro-batches
        df.where(F.col("v") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    out = SJ.stream_upsert(spark, src, df.schema, ["k"], ["v"], base=os.path.join(base, "out"))
    assert sorted(map(tuple, out.collect())) == [(1, 3, "c"), (2, 5, "y")]


def test_stream_insert_if_absent_first_arrival_wins(spark):
    base = SJ.run_dir(spark, "t-insert")
    src = os.path.join(base, "src")
    schema = "id long, url string, body string"
    spark.createDataFrame([(1, "u1", "a"), (2, "u2", "b")], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame([(0, "u1", "changed"), (3, "u3", "c")], schema).coalesce(1).write.mode("append").parquet(src)
    table, _ = SJ.stream_insert_if_absent(spark, src, spark.createDataFrame([], schema).schema,
                                          base=os.path.join(base, "out"))
    assert sorted(map(tuple, table.collect())) == [(1, "u1", "a"), (2, "u2", "b"), (3, "u3", "c")]


def test_checkpoint_dir_read_from_session(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert spark.conf.get("spark.checkpoint.dir")
