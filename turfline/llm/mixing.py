"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source lie on lines, one line for each of its shards, documents
in seeded order. Lines are cut into blocks of equal size. Sainte-Lague's method
(highest quotients v/1, v/3, v/5, ...) gives each source a whole number of
blocks, and each shard of it its part of them. A quota above the blocks of the
shard is taken in whole passes; the rest are blocks chosen evenly along the
seeded line from a seeded offset, so a document's share needs only its own place.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline.llm.store import map_arrow, stored
from turfline.llm.words import find_words, ragged_range

#: A document may be repeated so often.
MOST_REPEATS = 3
#: Words in a block at most; less when the smallest target is under ``BLOCKS_PER_TARGET`` blocks.
BLOCK_WORDS = 256
BLOCKS_PER_TARGET = 200
#: Rows and words of a shard, about; a line is ordered by one task.
SHARD_ROWS = 2_000
SHARD_WORDS = 2_000_000


def sainte_lague(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes/(2 * seats so far + 1); no party above its cap.

    The same as handing out one seat after another (ties to the earlier party), but it starts
    from rounded-down shares of a divisor and hands out only the last few seats singly.
    """
    n = len(votes)
    caps = [seats] * n if caps is None else caps
    seats = min(seats, sum(c for v, c in zip(votes, caps) if v > 0))
    got = [0] * n
    if seats <= 0:
        return got
    low, high = 0.0, max(votes) * 2 + 1.0  # divisor: at high no party has a seat, at low all their caps

    def given(d: float) -> list[int]:
        return [min(c, int(v / d + 0.5)) if v > 0 else 0 for v, c in zip(votes, caps)]

    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(given(mid)) >= seats:
            low = mid
        else:
            high = mid
    got = given(high)
    left = seats - sum(got)
    queue = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, got, caps)) if v > 0 and g < c]
    heapq.heapify(queue)
    while left > 0 and queue:
        _, i = heapq.heappop(queue)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight; none above ``most`` times its size. What is cut off
    goes to the others by weight, until none is above."""
    total, fixed = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = total - sum(fixed.values())
        weight = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / weight > most * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else rest * weights[i] / weight for i in range(len(sizes))]
        for i in over:
            fixed[i] = float(most * sizes[i])


def cycled_weights(sources: list[str | None], cycle: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights in turn to the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def mix_documents(docs: DataFrame, weights=cycled_weights, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row.

    ``size`` is the number of words (null or empty text: 0, taken 0). ``weights`` maps the list of
    sources to their weights; one row for each source comes to the driver. Null is a source of its
    own. Equal rows have equal places in the order of a line; one may be cut at a block border and
    the other not. An empty frame gives an empty frame. Reruns agree: order, offsets and quotas
    depend on the rows and the seed alone.
    """
    sized = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text", F.lit(seed)).alias("_text")), "sizes")
    return mix_sized(sized, weights, seed).drop("_text")


#: What tells where a document lies on its line and which blocks of the line are chosen.
PLACE = ("_end", "_passes", "_rest", "_cells", "_off")


def mix_sized(sized: DataFrame, weights=cycled_weights, seed: int = 17) -> DataFrame:
    """As ``mix_documents`` for rows with doc_id, source and size; other columns are kept."""
    block, plan, lines = plan_mix(sized, weights, seed)
    return place_rows(sized, block, plan, lines, seed).drop(*PLACE)


def plan_mix(sized: DataFrame, weights=cycled_weights, seed: int = 17) -> tuple[int, DataFrame, DataFrame]:
    """Words in a block, a row for each source and a row for each line, from doc_id, source and size."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes = [r["source"] for r in totals], [int(r["size"]) for r in totals]
    by_name = weights(names)
    goal = targets(sizes, [by_name[s] for s in names]) if sum(sizes) else [0.0] * len(sizes)
    least = min([g for g in goal if g > 0], default=1.0)
    block = max(1, min(BLOCK_WORDS, int(least / BLOCKS_PER_TARGET)))
    quota = sainte_lague(goal, round(sum(sizes) / block), [-(-MOST_REPEATS * s // block) for s in sizes])
    parts = [max(1, -(-s // SHARD_WORDS), -(-r["rows"] // SHARD_ROWS)) for s, r in zip(sizes, totals)]
    plan = spark.createDataFrame(
        [(n, s, float(g), q, p) for n, s, g, q, p in zip(names, sizes, goal, quota, parts)],
        "_source string, source_size long, target double, _quota long, _parts int")
    placed = _sharded(sized, plan, seed)

    def shards_of_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_shard", ignore_index=True)
        cells = (-(-rows["_line"] // block)).astype("int64")
        q = sainte_lague([float(x) for x in rows["_line"]], int(rows["_quota"].iloc[0]), [int(MOST_REPEATS * c) for c in cells])
        return pd.DataFrame({"_of": rows["source"], "_at": rows["_shard"], "_blocks": cells, "_take": q})

    lines = placed.groupBy("source", "_shard").agg(F.sum("size").alias("_line"), F.first("_quota").alias("_quota"))
    lines = stored(lines.groupBy("source").applyInPandas(shards_of_source, "_of string, _at int, _blocks long, _take long"), "quotas")
    return block, plan, lines


def _sharded(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    placed = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["_source"]))  # one row for each source
    return placed.drop("_source").withColumn("_shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("_parts")).cast("int"))


def place_rows(sized: DataFrame, block: int, plan: DataFrame, lines: DataFrame, seed: int = 17) -> DataFrame:
    """Adds source_size, target, taken and the columns ``PLACE`` to the rows of the plan."""
    placed = _sharded(sized, plan, seed)
    ties = [c for c in ("_text", "_all") if c in sized.columns]
    line = Window.partitionBy("source", "_shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", *ties)
    placed = placed.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(lines, placed["source"].eqNullSafe(lines["_of"]) & (placed["_shard"] == lines["_at"]))
    cells = F.greatest("_blocks", F.lit(1))
    rest = F.col("_take") % cells
    offset = F.pmod(F.xxhash64(F.lit(seed + 2), "_of", "_at"), cells)
    placed = placed.withColumns({"_passes": F.expr("_take div greatest(_blocks, 1L)"), "_rest": rest, "_cells": cells, "_off": offset})

    def chosen_before(word: str) -> str:
        """Words of chosen blocks before this word of the line: block b is chosen where
        (b * rest + offset) / blocks steps over a whole number on the way to b + 1."""
        b = f"(({word}) div {block}L)"
        steps = f"(({b} * _rest + _off) div _cells)"
        return f"({steps} * {block}L + ((({b} + 1) * _rest + _off) div _cells - {steps}) * (({word}) % {block}L))"

    taken = F.expr(f"_passes * size + {chosen_before('_end')} - {chosen_before('_end - size')}").cast("long")
    return placed.withColumn("taken", taken).drop("_shard", "_parts", "_quota", "_of", "_at", "_blocks", "_take")


def chosen_words(text: str, begin: int, block: int, rest: int, cells: int, off: int) -> str | None:
    """The words of the text in the chosen blocks of its line, with the white space after each; none
    if no block is chosen there. ``begin`` is the place of its first word on the line."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, _, _ = find_words(data, np.array([0, len(data)]))
    b = (begin + np.arange(len(starts))) // block
    keep = ((b + 1) * rest + off) // cells > (b * rest + off) // cells
    if not keep.any():
        return None
    borders = np.append(starts, len(data))
    borders[0] = 0
    out = data[ragged_range(borders[:-1][keep], np.diff(borders)[keep])].tobytes().decode()
    return out if keep[-1] else out.rstrip(" \t\n\x0b\x0c\r")


def mixed_rows(docs: DataFrame, weights=cycled_weights, seed: int = 17) -> DataFrame:
    """``docs`` as the mix takes them: so many whole copies of each row, and one row that holds the
    words of the chosen blocks, spaced as in the text, when the mix takes a part. A row of which
    nothing is taken goes; equal rows have places of their own. ``n_chars`` follows the text."""
    sized = docs.select(
        *[F.col(c).alias(f"_doc_{c}") for c in docs.columns],
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text", F.lit(seed)).alias("_text"), F.xxhash64(*docs.columns).alias("_all"))
    block, plan, lines = plan_mix(stored(sized.select("doc_id", "source", "size"), "sizes"), weights, seed)
    placed = place_rows(sized, block, plan, lines, seed).where("taken > 0")
    at, n = docs.columns.index("text"), len(docs.columns)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(n)]
            passes, part = (batch.column(n + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for copy in range(int(passes.max(initial=0))):
                rows = pa.array(np.flatnonzero(passes > copy))
                yield pa.RecordBatch.from_arrays([c.take(rows) for c in columns], names=docs_columns)
            rows = pa.array(np.flatnonzero(part > 0))
            if len(rows):
                some = [c.take(rows) for c in columns]
                places = zip(*[batch.column(n + i).take(rows).to_pylist() for i in range(2, 6)])
                some[at] = pa.array([chosen_words(t, p[0], block, *p[1:]) for t, p in zip(some[at].to_pylist(), places)], type=some[at].type)
                yield pa.RecordBatch.from_arrays(some, names=docs_columns)

    docs_columns = docs.columns
    narrow = placed.select(
        *[F.col(f"_doc_{c}") for c in docs_columns], "_passes", F.expr("taken - _passes * size").alias("_part"),
        (F.col("_end") - F.col("size")).alias("_begin"), "_rest", "_cells", "_off")
    out = map_arrow(narrow, take, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
