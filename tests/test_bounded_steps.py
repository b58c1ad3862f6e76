"""Steps that must stay bounded at size: chunks leave in parts, medians take no pair of column and value for each cell."""
import random

import numpy as np
import pytest

from turfline.operators import ml as ML
from turfline.operators import scoring as SC
from turfline.operators import text as TX


def test_chunks_of_a_batch_leave_in_parts(spark, monkeypatch):
    texts = [" ".join(f"w{i}_{j}" for j in range(400)) for i in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    monkeypatch.setattr(TX, "spread", lambda df: df)
    sizes = []

    class Held:
        def mapInArrow(self, step, schema):  # noqa: N802  the step of a single task, as Spark would call it
            sizes.extend(b.num_rows for b in step(iter(docs.toArrow().combine_chunks().to_batches())))
            return docs

    whole = TX.chunk_recursive(docs, ["id"], "text").collect()
    assert sorted((r.id, r.chunk_no, r.chunk) for r in whole) == sorted(
        (i, k, c) for i, t in enumerate(texts) if t for k, c in enumerate(TX.split_recursive(t)))
    monkeypatch.setattr(TX, "CHUNKED_CHARS", 5_000)
    monkeypatch.setattr(TX, "map_arrow", lambda df, step, schema: Held().mapInArrow(step, schema))
    TX.chunk_recursive(docs, ["id"], "text")
    assert sum(sizes) == len(whole) and len(sizes) >= 10


@pytest.mark.parametrize("small", [65_536, 200, 20])
def test_medians_of_wide_frames(spark, small, monkeypatch):
    r = random.Random(7)
    n = 3001
    cols = {"normal": [r.gauss(0, 1) for _ in range(n)], "ties": [float(r.choice([1, 2, 2, 3])) for _ in range(n)], "same": [4.0] * n,
            "two": [0.0] * (n // 2) + [1.0] * (n - n // 2 - 1) + [None], "few": [1.0, 4.0] + [None] * (n - 2), "none": [None] * n,
            "wide": [10.0 ** r.uniform(-300, 300) for _ in range(n)], "ints": [float(r.randrange(900)) for _ in range(n)]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"`{c}` double" for c in cols))
    if small != 20:  # the medians of these sizes never go by column and value
        monkeypatch.setattr(SC, "group_quantiles", None)
    got = SC.exact_medians(df, list(cols), small)
    for c, values in cols.items():
        values = [v for v in values if v is not None]
        assert got[c] == (pytest.approx(float(np.median(values)), rel=1e-12) if values else None), c
    assert SC.exact_medians(df.limit(0), list(cols)) == dict.fromkeys(cols) and SC.exact_medians(df, []) == {}


def test_boosting_has_few_partitions_for_few_rows(spark):
    rows = spark.range(100).repartition(8)
    assert ML.dealt(rows).rdd.getNumPartitions() == 1 and ML.dealt(rows, 30).rdd.getNumPartitions() == 4
    assert ML.dealt(rows, 30).count() == 100 and ML.dealt(rows.limit(0)).count() == 0


def test_trees_are_fitted_on_stored_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ML, "stored", lambda df, name: seen.append((name, df.columns)) or df)
    rows = [(i, *[float((i * k) % 13) for k in range(1, len(ML.K.FEATURE_COLS) + 1)], float(i % 5)) for i in range(60)]
    train = spark.createDataFrame(rows, ["id", *ML.K.FEATURE_COLS, ML.K.TARGET])
    model = ML.fit_model(train, "RandomForest", numTrees=3)
    assert seen == [("prepared", [ML.K.TARGET, "features"])] and model.transform(train).count() == 60
