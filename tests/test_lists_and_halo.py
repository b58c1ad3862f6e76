"""k-NN through cells and lists against brute force; trailing frames through the halo of sorted ranges."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turfline.operators import vectors as VX
from turfline.operators.windows import preceding_rows, rolling_mean


def vectors(n, dims, seed, clusters=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims)) * 3
    return (centres[r.integers(0, clusters, n)] + r.normal(size=(n, dims))).astype(np.float32)


def frame(spark, mat, name, labels=None):
    rows = [(i, v.tolist(), None if labels is None else labels[i]) for i, v in enumerate(mat)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>, label string")


def brute(mat, k, labels=None):
    s = mat.astype(np.float64) @ mat.astype(np.float64).T
    out = set()
    for q in range(len(mat)):
        if labels is not None and labels[q] is None:
            continue
        ok = [d for d in range(len(mat)) if d != q and (labels is None or labels[d] == labels[q])]
        out |= {(q, d, rank + 1) for rank, d in enumerate(sorted(ok, key=lambda d: (-s[q, d], d))[:k])}
    return out


def test_cells_are_exact_and_skip_far_ones(spark, monkeypatch):
    mat = vectors(1500, 12, 1)
    mat[100:140] = mat[7]  # equal vectors: ties by id
    corpus, queries = frame(spark, mat, "doc_id"), frame(spark, mat, "query_id")
    got = VX.knn_topk(corpus, queries, 4, exclude_self=True)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()} == brute(mat, 4)
    d = corpus.select(F.col("doc_id").alias("_doc"), F.col("embedding").alias("_vec"))
    cells, _ = VX._cells(d, None)
    s = np.sort(mat.astype(float) @ mat.astype(float).T, axis=1)[:, -5]
    visited = cells.visits(mat.astype(float), 4, s)
    assert len(cells.rows) > 20 and visited.mean() < 0.5  # the bound keeps most queries from most cells


def test_few_rows_nulls_and_empty_frames(spark):
    mat = vectors(5, 3, 2)
    corpus, queries = frame(spark, mat, "doc_id"), frame(spark, mat, "query_id")
    more = corpus.unionByName(corpus.limit(1).select(F.lit(99).cast("long").alias("doc_id"), F.lit(None).cast("array<float>").alias("embedding"), "label"))
    got = VX.knn_topk(more, queries, 10, exclude_self=True)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()} == brute(mat, 10)
    assert VX.knn_topk(corpus.limit(0), queries, 3).count() == 0
    assert VX.knn_topk(corpus, queries.limit(0), 3).count() == 0
    assert VX.knn_topk(corpus, queries.limit(0), 3, filter_col="label").count() == 0
    assert VX.knn_topk(corpus.limit(0), queries, 3, keep_vectors=True).columns[-1] == "embedding"


def test_hot_list_is_split_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(VX, "CHUNK_ROWS", 50)
    mat = vectors(900, 6, 3)
    labels = ["hot" if i % 3 else (None if i % 7 == 0 else f"l{i % 40}") for i in range(900)]
    corpus, queries = frame(spark, mat, "doc_id", labels), frame(spark, mat, "query_id", labels)
    got = VX.knn_topk(corpus, queries, 3, filter_col="label", exclude_self=True)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()} == brute(mat, 3, labels)
    d = corpus.where("label is not null").select(F.col("doc_id").alias("_doc"), F.col("embedding").alias("_vec"), F.col("label").alias("_list"))
    dealt, _ = VX._dealt_lists(d, d.withColumnRenamed("_doc", "_query"))
    sizes = {(r["_list"], r["_chunk"]): r["count"] for r in dealt.groupBy("_list", "_chunk").count().collect()}
    assert sum(1 for lst, _ in sizes if lst == "hot") == 12 and max(sizes.values()) < 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("n", [1, 4])
def test_frames_equal_a_window_for_any_ranges(spark, parts, n):
    """Also with ranges of fewer rows than the frame, null keys, and one key over all ranges."""
    hot = spark.range(60).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    cold = spark.range(30).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.col("id").alias("t"))
    df = hot.unionByName(cold).withColumn("v", F.concat(F.lit("text "), F.col("t")))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = preceding_rows(df, ["k"], ["t"], n, {"a": F.col("t"), "b": F.col("v")}, out="prev")
        got = {(r["k"], r["t"]): [tuple(x) for x in r["prev"]] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    w = Window.partitionBy("k").orderBy("t").rowsBetween(-n, -1)
    ref = df.select("k", "t", F.collect_list(F.struct("t", "v")).over(w).alias("prev")).collect()
    assert got == {(r["k"], r["t"]): [tuple(x) for x in r["prev"]] for r in ref}


def test_frames_of_an_empty_table_and_kept_columns(spark):
    df = spark.createDataFrame([], "k string, t int, v double")
    assert rolling_mean(df, ["k"], ["t"], "v", 3, "m").columns == ["k", "t", "v", "m"]
    assert rolling_mean(df, ["k"], ["t"], "v", 3, "m").count() == 0


def test_one_range_shuffle(spark, tmp_path):
    """The sorted pass is the only place where rows are shuffled; what is joined later are border rows."""
    df = spark.range(2000).select((F.col("id") % 5).alias("k"), F.col("id").alias("t"), F.lit("x" * 50).alias("v"))
    got = preceding_rows(df, ["k"], ["t"], 3, {"v": F.col("v")})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Sort [" not in plan.split("Union")[0]
    full = got._jdf.queryExecution().executedPlan().toString()
    complete = [line for line in full.splitlines() if "Scan parquet" in line]
    assert any("EqualTo(_kind,0)" in line for line in complete)
    assert got.count() == 2000
