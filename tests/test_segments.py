"""Segment stores: versions appear whole or not at all, and one writer wins."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.sources.segments import Manifest, SegmentStore, VersionConflict
from turfline.streaming.jobs import run_dir

SCHEMA = T.StructType([T.StructField("id", T.LongType())])


@pytest.fixture
def store(spark):
    return SegmentStore(spark, run_dir(spark, "segments-test"))


def test_an_empty_store_reads_as_empty(spark, store):
    assert store.manifest() == Manifest()
    assert store.read([], SCHEMA, "v").columns == ["id", "v"]
    assert store.read([], SCHEMA).count() == 0


def test_versions_and_time_travel(spark, store):
    one = store.write(spark.range(3), "rows", 1)
    first = store.commit(Manifest(), [one], {"mark": "3"})
    two = store.write(spark.range(3, 5), "rows", 2)
    assert store.read(store.manifest().of("rows"), SCHEMA).count() == 3  # written, not committed
    store.commit(first, [one, two], {"mark": "5"})
    assert store.read(store.manifest().of("rows"), SCHEMA).count() == 5
    assert store.read(store.manifest(1).of("rows"), SCHEMA).count() == 3
    assert store.manifest(1).state == {"mark": "3"}
    versions = {r["v"] for r in store.read(store.manifest().of("rows"), SCHEMA, "v").collect()}
    assert versions == {1, 2}


def test_one_of_two_writers_wins(spark, store):
    base = store.commit(Manifest(), [], {})
    store.commit(base, [], {"by": "a"})
    with pytest.raises(VersionConflict):
        store.commit(base, [], {"by": "b"})
    assert store.manifest().state == {"by": "a"}


def test_a_torn_manifest_is_no_version(spark, store):
    good = store.commit(Manifest(), [], {"n": "1"})
    fs, path = store._path(f"manifest/v{good.version + 1:010d}.json")
    stream = fs.create(path, False)
    stream.write(bytearray(b'{"version": 2, "segm'))
    stream.close()
    assert store.manifest() == good
    after = store.commit(good, [], {"n": "2"})
    assert after.version == good.version + 2 and store.manifest() == after


ROW = "url string, id long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_upsert_table_equals_one_batch_and_stays_small(spark, monkeypatch):
    from turfline.operators import stores
    from turfline.operators.stores import UpsertTable
    from turfline.operators.upsert import latest_by_key

    monkeypatch.setattr(stores, "FANOUT", 3)
    FANOUT = 3
    table = UpsertTable(spark, run_dir(spark, "upsert-test"), frame(spark, []).schema, ["url"], ["id"], buckets=4)
    batches = [[(f"u{(i * 7 + j) % 11}" if j else None, i * 100 + j, f"{i}.{j}") for j in range(9)] for i in range(2 * FANOUT + 5)]
    for epoch, batch in enumerate(batches):
        table.upsert(frame(spark, batch), epoch)
        table.upsert(frame(spark, [("u0", 10**9, "a batch tried again")]), epoch)
        live = table.store.manifest().of("rows")
        assert all(sum(s.level == level for s in live) < FANOUT for level in range(5))
    assert len(live) <= 2 * FANOUT
    want = latest_by_key(frame(spark, [r for b in batches for r in b]), ["url"], ["id"])
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    table.upsert(frame(spark, []), len(batches))
    assert table.read().count() == want.count()


def test_keyed_table_reads_only_the_buckets_it_must(spark):
    from turfline.operators.stores import KeyedTable

    table = KeyedTable(spark, run_dir(spark, "keys-test"), frame(spark, []).schema, "url", "id", buckets=32)
    first, read = table.insert(frame(spark, [(f"u{i}", i, "a") for i in range(400)] + [("u3", 900, "later"), (None, 1, "n")]), 0)
    assert first.count() == 401 and read == []
    new, read = table.insert(frame(spark, [(f"new{i}", i, "b") for i in range(40)]), 1)
    assert new.count() == 40 and read == []  # no filter knows any of them: no stored key is read
    new, read = table.insert(frame(spark, [("u17", 1, "c"), ("u17", 0, "c"), ("other", 2, "c"), (None, 5, "n")]), 2)
    assert sorted(r["url"] or "" for r in new.collect()) == ["", "other"] and len(read) == 1
    rows = table._rows(table.store.manifest(), buckets=read)
    assert {x["f"].split("bucket=")[1].split("/")[0] for x in rows.select(F.input_file_name().alias("f")).collect()} == {str(read[0])}
    assert "PartitionFilters: [isnotnull(bucket" in rows._jdf.queryExecution().executedPlan().toString()
    again, read = table.insert(frame(spark, [("x", 1, "a batch tried again")]), 2)
    assert sorted(r["url"] or "" for r in again.collect()) == ["", "other"] and read == []
    assert table.read().count() == 443
    assert table.read().where("url = 'u3'").first()["id"] == 3


def test_keyed_table_after_many_batches(spark, monkeypatch):
    from turfline.operators import stores
    from turfline.operators.stores import KeyedTable

    monkeypatch.setattr(stores, "FANOUT", 3)
    table = KeyedTable(spark, run_dir(spark, "keys-test"), frame(spark, []).schema, "url", "id", buckets=2)
    seen = {}
    for epoch in range(5):
        batch = [(f"k{(epoch * 5 + j) % 23}", epoch * 10 + j, str(epoch)) for j in range(8)]
        table.insert(frame(spark, batch), epoch)
        for k, i, _ in batch:
            seen.setdefault(k, i)
    assert {r["url"]: r["id"] for r in table.read().collect()} == seen and table.read().count() == len(seen)
    live = table.store.manifest()
    assert len(live.of("rows")) < 3 and len(live.of("filter")) < 3
