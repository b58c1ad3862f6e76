"""The stored document index: an update equals a rebuild, and only what changed is embedded."""
import pytest
from pyspark.sql import functions as F

from turfline.operators import index as IX
from turfline.operators import text as TX
from turfline.plans.queries.q_index import _rows
from turfline.sources.segments import SegmentStore
from turfline.streaming.jobs import run_dir

NEWS = "id long, source string, title string, url string, body string"
PLAYERS = ("id long, web_name string, total_points long, now_cost long, goals_scored long, assists long, "
           "clean_sheets long, form double, news string")


def news(spark, ids):
    return spark.createDataFrame([(i, f"s{i % 3}", f"title {i}", f"u{i}", f"body of {i} " * 90) for i in ids], NEWS)


def players(spark, points):
    return spark.createDataFrame([(i, name, p, 50, 1, 2, 3, 1.5, "") for i, (name, p) in enumerate(points)], PLAYERS)


@pytest.fixture
def store(spark):
    return SegmentStore(spark, run_dir(spark, "index-test"))


def rows(index):
    return sorted(map(tuple, _rows(index).collect()), key=str)


def test_update_equals_rebuild_and_embeds_changes_only(spark, store):
    before = [("Kane", 5), ("Saka", 7), (None, 1), ("Old", 9)]
    after = [("Kane", 6), ("Saka", 7), (None, 1), ("New", 0)]
    IX.rebuild(store, news(spark, range(1, 6)), players(spark, before), "fixed")
    done = IX.update(store, news(spark, range(1, 9)), players(spark, after), "fixed")
    chunks = TX.news_documents(news(spark, range(6, 9)), "fixed").count()
    assert (done.embedded, done.removed) == (chunks + 2, 1)  # Kane anew, New; Kane's old card goes
    fresh = SegmentStore(spark, run_dir(spark, "index-test"))
    IX.rebuild(fresh, news(spark, range(1, 9)), players(spark, [*after, ("Old", 9)]), "fixed")
    assert rows(IX.read_index(store)) == rows(IX.read_index(fresh))
    assert store.manifest().state == fresh.manifest().state == {"last_news_id": "8", "players_embedded": "1"}
    again = IX.update(store, news(spark, range(1, 9)), players(spark, after), "fixed")
    assert (again.embedded, again.removed) == (0, 0)
    assert rows(IX.read_index(store)) == rows(IX.read_index(fresh))


def test_the_old_version_stays_readable(spark, store):
    IX.rebuild(store, news(spark, [1]), players(spark, [("A", 1), ("B", 2)]), "fixed")
    old = rows(IX.read_index(store))
    IX.update(store, news(spark, [1, 2]), players(spark, [("A", 3)]), "fixed")
    assert rows(IX.read_index(store, 1)) == old
    names = {(r["name"], r["added"]) for r in IX.read_index(store).where("type = 'player'").collect()}
    assert names == {("A", 2), ("B", 1)}


def test_a_card_that_comes_back_counts_again(spark, store):
    IX.rebuild(store, news(spark, []), players(spark, [("A", 1), ("B", 1), ("C", 1), ("D", 1), ("E", 1), ("F", 1)]), "fixed")
    for points in (2, 1, 2, 1):
        done = IX.update(store, news(spark, []), players(spark, [("A", points)]), "fixed")
        assert (done.embedded, done.removed) == (1, 1)
    cards = IX.read_index(store).where("name = 'A'").collect()
    assert len(cards) == 1 and "Total Points: 1" in cards[0]["page_content"]


def test_many_updates_keep_few_segments(spark, store, monkeypatch):
    monkeypatch.setattr(IX, "FANOUT", 3)
    n = 7
    IX.rebuild(store, news(spark, [1]), players(spark, [(f"p{i}", 0) for i in range(40)]), "fixed")
    for i in range(n):
        IX.update(store, news(spark, range(1, i + 3)), players(spark, [(f"p{i % 5}", i + 1)]), "fixed")
        assert all(len(store.manifest().of(IX.ROWS, level)) < IX.FANOUT for level in range(6))
    fresh = SegmentStore(spark, run_dir(spark, "index-test"))
    last = {f"p{i}": 0 for i in range(40)} | {f"p{i % 5}": i + 1 for i in range(n)}
    IX.rebuild(fresh, news(spark, range(1, n + 2)), players(spark, list(last.items())), "fixed")
    assert rows(IX.read_index(store)) == rows(IX.read_index(fresh))
    removed = sum(s.rows for s in store.manifest().of(IX.REMOVED))
    assert removed * 100 <= IX.REMOVED_PERCENT * sum(s.rows for s in store.manifest().of(IX.ROWS))


def test_empty_tables(spark, store):
    done = IX.rebuild(store, news(spark, []), players(spark, []), "fixed")
    assert done.embedded == 0 and IX.read_index(store).count() == 0
    assert store.manifest().state == {"players_embedded": "1"}
    assert IX.update(store, news(spark, []), players(spark, []), "fixed").embedded == 0


def test_an_update_reads_no_stored_vectors_and_no_news(spark, store):
    IX.rebuild(store, news(spark, [1, 2]), players(spark, [("A", 1)]), "fixed")
    stored = IX._live(store, store.manifest(), F.col("type") == "player").select("doc_key", "name")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<name:string,doc_key:binary>" in plan
    assert "PartitionFilters: [isnotnull(type" in plan
