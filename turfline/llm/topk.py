"""Exact top-k inner products: norm-sorted blocks with SVD-rotated partial sums.

Vectors become integers, are rotated to the axes of their second-moment matrix
(strongest first) and sorted by descending length into blocks. A block is
compared with a block of queries: lengths alone rule out queries, then the partial
sum over the first axes plus the product of the residual lengths (Cauchy-Schwarz)
rules out vectors, and what is left is scored exactly in integers. Queries begin
with the k-th best score among the longest vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.llm.store import global_rank, map_arrow, stored

SCALE = 256
#: Vectors in a block of candidates and in a block of queries, and the longest ones that give the first bounds.
BLOCK, QUERY_BLOCK, FIRST = 4_096, 4_096, 4_096
#: Share of the axes in each partial sum.
STEPS = (0.125, 0.25, 0.5)


def usable(vector: Column) -> Column:
    """Not null, nor holding a null or a non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as a matrix; shorter vectors end in zeros."""
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def _matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob).reshape(-1, dim)


def _axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the table of all vectors; dim**2 sums come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((dim, dim))
        for batch in batches:
            x = _rows(batch.column(0), dim)
            sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(sums.ravel())], names=["at", "value"])

    sums = np.zeros(dim * dim)
    for r in map_arrow(vectors.select("v"), add, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        sums[r["at"]] = r["value"]
    return np.linalg.eigh(sums.reshape(dim, dim))[1][:, ::-1].copy()


def best_of_block(queries: tuple, block: tuple, bound: np.ndarray, axes: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of at most k vectors for each query that reach its bound."""
    q_ids, q = queries
    ids, v = block
    dim = v.shape[1]
    q_rot, v_rot = q @ axes, v @ axes
    q_len, longest = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1).max(initial=0.0)
    slack = 1e-9 * (q_len * longest + 1.0)
    live = np.flatnonzero(q_len * longest + slack >= bound)
    alive = np.ones((len(live), len(v)), dtype=bool)
    partial, done = np.zeros((len(live), len(v))), 0
    for share in STEPS:
        to = max(1, int(dim * share))
        if to <= done or not len(live):
            continue
        partial += q_rot[live, done:to] @ v_rot[:, done:to].T
        done = to
        rest = np.linalg.norm(q_rot[live, to:], axis=1)[:, None] * np.linalg.norm(v_rot[:, to:], axis=1)
        alive &= partial + rest + slack[live, None] >= bound[live, None]
    out = []
    for i, keep in zip(live, alive):
        at = np.flatnonzero(keep)
        at = at[ids[at] != q_ids[i]]
        if not len(at):
            continue
        scores = v[at] @ q[i]  # whole numbers below 2**53: exact
        best = np.lexsort((ids[at], -scores))[:k]
        out += [(int(q_ids[i]), int(ids[at[j]]), int(scores[j])) for j in best if scores[j] >= bound[i]]
    return out


def _bounds(queries: tuple, block: tuple, k: int) -> np.ndarray:
    """k-th best exact score of each query in the block (minus infinity if it has fewer)."""
    q_ids, q = queries
    ids, v = block
    if len(v) <= k:
        return np.full(len(q), -np.inf)
    scores = q @ v.T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    return np.partition(scores, len(v) - k, axis=1)[:, len(v) - k]


def top_products(df: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best inner products of each query with all other rows.

    Components become floor(256 * x). Queries are the rows whose key is divisible by ``every``. Rows
    with a null key, and vectors null or holding null or non-finite components, take no part. A
    shorter vector counts as if it ended in zeros, an empty one as zeros. Ties go to the smaller
    key; rows with a key that occurs twice are candidates each, but never for their own key. An
    empty frame gives an empty frame.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), whole.alias("v"))
    rows = stored(rows.withColumn("n", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "vectors")
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return empty
    dim = max(dim, 1)
    axes = _axes(rows, dim)

    def blocks(source: DataFrame, size: int) -> DataFrame:
        """Rows of ``source``, longest first, in packed blocks: block, ids, data (doubles)."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def block(number, parts):
                ids, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids.tobytes()]), pa.array([data.tobytes()])],
                                                  names=["block", "ids", "data"])
            parts, number = [], None
            for batch in batches:
                ids, matrix, ranks = batch.column(0).to_numpy(), _rows(batch.column(1), dim), batch.column(2).to_numpy() // size
                for n in np.unique(ranks):
                    if number is not None and n != number:
                        yield block(number, parts)
                        parts = []
                    number = int(n)
                    parts.append((ids[ranks == n], matrix[ranks == n]))
            if parts:
                yield block(number, parts)

        ranked = global_rank(source, [-F.col("n"), F.col("id"), F.xxhash64("v")])
        ranked = ranked.repartitionByRange("_rank").sortWithinPartitions("_rank")
        return stored(map_arrow(ranked.select("id", "v", "_rank"), pack, "block long, ids binary, data binary"), "blocks")

    candidates = blocks(rows, BLOCK)
    asked = blocks(rows.where(F.col("id") % every == 0), QUERY_BLOCK).select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def unpack(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, dtype=np.int64), _matrix(data, dim)

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, q_ids, q_data, ids, data in zip(*[c.to_pylist() for c in batch.columns]):
                bound = _bounds(unpack(q_ids, q_data), unpack(ids, data), k)
                yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([q_ids]), pa.array([q_data]), pa.array([bound.tobytes()])],
                                                 names=["q", "q_ids", "q_data", "bound"])

    # the longest vectors: the part of block 0 that is largest
    longest = candidates.where("block = 0").orderBy(F.length("ids").desc(), "ids").limit(1).select(F.lit(1).alias("_one"), "ids", "data")
    asked = asked.withColumn("_one", F.lit(1)).join(longest, "_one").select("q", "q_ids", "q_data", "ids", "data")
    asked = stored(map_arrow(asked, first_bounds, "q long, q_ids binary, q_data binary, bound binary"), "queries")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_data, bound, ids, data in zip(*[c.to_pylist() for c in batch.columns]):
                found = best_of_block(unpack(q_ids, q_data), unpack(ids, data), np.frombuffer(bound), axes, k)
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    # a row of either side is a block of thousands of vectors
    numbers = candidates.agg(F.max("block")).first()[0]
    # each block of queries goes to each block of candidates, dealt by the latter: those are many
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(numbers).cast("long"))))
    work = sent.join(candidates.hint("merge"), "block").select("q_ids", "q_data", "bound", "ids", "data")
    found = stored(map_arrow(work, compare, "query_id long, vec_id long, score long"), "found")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
