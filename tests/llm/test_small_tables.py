"""Small tables take tasks and files for their rows, not for each shuffle partition; pairs are verified many at a time."""

import numpy as np
import pytest

from turfline.llm import components, neardup, store


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_write_few_files(many_partitions, monkeypatch):
    spark, files = many_partitions, []

    def counted(df, *args, **more):
        files.append(len((out := store.stored(df, *args, **more)).inputFiles()))
        return out

    monkeypatch.setattr(components, "stored", counted)
    links = spark.createDataFrame([(i, i + 7) for i in range(3000) if i % 50], "a long, b long")
    group = list(range(3007))
    for a in range(3000):  # ascending: the smaller end has its group already
        if a % 50:
            group[a + 7] = min(group[a + 7], group[a])
    linked = {x for a in range(3000) if a % 50 for x in (a, a + 7)}
    assert {tuple(r) for r in components.components(links).collect()} == {(i, group[i]) for i in linked}
    assert files and max(files) <= store.FEW_PARTS


def test_few_keeps_all_rows(spark):
    rows = spark.range(0, 1000, 1, 80)
    assert store.few(rows, 1000).rdd.getNumPartitions() == store.FEW_PARTS
    assert store.few(rows, 1000, 20).rdd.getNumPartitions() == 50
    assert store.few(rows, 1000, 1).rdd.getNumPartitions() == 80
    assert store.few(rows, 0).selectExpr("sum(id)").first()[0] == 499_500


def test_linked_with_is_linked_with_each():
    r = np.random.default_rng(8)
    x = np.unique(r.integers(0, 1 << 63, 40, dtype=np.uint64))
    others = [x, x[:1], x[-1:] + np.uint64(1), x[:30], x[:29], np.unique(np.append(x, r.integers(0, 1 << 63, 13, dtype=np.uint64))),
              np.unique(np.append(x, r.integers(0, 1 << 63, 14, dtype=np.uint64)))]
    assert list(neardup.linked_with(x, others)) == [neardup.linked(x, y) for y in others]
    assert list(neardup.linked_with(x, others)) == [True, False, False, True, False, True, False]
