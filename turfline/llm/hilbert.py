"""Hilbert-curve sharding: DataFrame functions only.

Several metadata dimensions are quantised to ``2**bits`` cells of about equal
row counts, the cells are put on a Hilbert curve, and rows sorted by their curve
index are cut into runs. Rows that are near in all dimensions lie in one run, so
min/max statistics of the written files prune on every one of the dimensions.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.llm.store import global_rank, stored

#: Bits for each dimension: 32 cells.
BITS = 5
#: Accuracy of the approximate quantiles that cut a dimension into cells.
ACCURACY = 10_000


def _text_code(col: Column, skip: int) -> Column:
    """Order-preserving number of the 7 bytes after the first ``skip`` characters."""
    tail = F.hex(F.encode(F.substring(col, skip + 1, 7), "UTF-8"))
    return F.conv(F.rpad(F.substring(tail, 1, 14), 14, "0"), 16, 10).cast("long")


def _below(points: Column, value: Column) -> Column:
    return F.size(F.filter(points, lambda p: p < value))


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> tuple[DataFrame, list[str]]:
    """Adds ``_q0``, ``_q1``, ...: the cell of each dimension, 0 for null.

    Numbers are cut at approximate quantiles. Texts are cut the same way over the bytes that
    follow the prefix which all values share; cells keep the order of the values. The cut points
    (``2**bits - 1`` for each dimension) are the only thing that comes to the driver.
    """
    kinds = dict(df.dtypes)
    texts = [d for d in dims if kinds[d] == "string"]
    skip = {}
    if texts:
        ends = df.agg(*[f(d).alias(f"{i}{n}") for d, n in zip(texts, range(len(texts))) for i, f in (("a", F.min), ("b", F.max))]).first()
        for n, d in enumerate(texts):
            skip[d] = len(os.path.commonprefix([ends[f"a{n}"] or "", ends[f"b{n}"] or ""]))
    codes = {f"_q{i}": _text_code(F.col(d), skip[d]) if d in skip else F.col(d).cast("double") for i, d in enumerate(dims)}
    names, shares = list(codes), [j / (1 << bits) for j in range(1, 1 << bits)]
    df = df.withColumns(codes)
    cuts = df.agg(*[F.percentile_approx(q, shares, ACCURACY).alias(q) for q in names]).first()
    cells = {}
    for q in names:
        points = F.array(*[F.lit(float(p)) for p in sorted(set(cuts[q] or []))]).cast("array<double>")
        cells[q] = F.when(F.col(q).isNull(), 0).otherwise(_below(points, F.col(q).cast("double")))
    return df.withColumns(cells), names


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the point with these coordinates (0 to ``2**bits - 1``).

    The coordinates are untwisted bit by bit from the highest, Gray-coded, and their bits
    interleaved. Each step is an ``aggregate`` that begins with the result of the step before,
    so every expression stands, and is evaluated, once.
    """
    n = len(cells)

    def bits_and_axes(low: int) -> Column:
        return F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, low, -1) for i in range(n)])

    def untwist(x: Column, step: Column) -> Column:
        low = step["q"] - F.lit(1)
        here = F.get(x, step["i"])
        swap = F.get(x, F.lit(0)).bitwiseXOR(here).bitwiseAND(low)
        return F.when(
            here.bitwiseAND(step["q"]) != 0, F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
        ).otherwise(F.transform(x, lambda v, k: F.when((k == 0) | (k == step["i"]), v.bitwiseXOR(swap)).otherwise(v)))

    def gray(x: Column, i: Column) -> Column:
        return F.transform(x, lambda v, k: F.when(k == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v))

    def turn(a: Column, q: Column) -> Column:
        odd = F.get(a["x"], F.lit(n - 1)).bitwiseAND(q) != 0
        return F.struct(a["x"].alias("x"), F.when(odd, a["t"].bitwiseXOR(q - F.lit(1))).otherwise(a["t"]).alias("t"))

    def interleave(a: Column, p: Column) -> Column:
        bit = F.when(F.get(a["x"], p["i"]).bitwiseAND(p["q"]) != 0, F.lit(1)).otherwise(F.lit(0))
        return F.struct(a["x"].alias("x"), (a["t"] * 2 + bit).alias("t"))

    point = F.array(*[c.cast("int") for c in cells])
    if bits > 1:
        point = F.aggregate(bits_and_axes(0), point, untwist)
    if n > 1:
        point = F.aggregate(F.array(*[F.lit(i) for i in range(1, n)]), point, gray)
    if bits > 1:
        point = F.aggregate(
            F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]), F.struct(point.alias("x"), F.lit(0).alias("t")),
            turn, lambda a: F.transform(a["x"], lambda v: v.bitwiseXOR(a["t"])))
    return F.aggregate(
        bits_and_axes(-1), F.struct(point.alias("x"), F.lit(0).cast("long").alias("t")), interleave, lambda a: a["t"])


def hilbert_shards(df: DataFrame, dims: list[str], ties: list[str], shards: int = 16, bits: int = BITS) -> DataFrame:
    """Adds ``curve`` (index on the curve), ``shard`` (0 to ``shards - 1``) and ``slot`` (from 0 in
    each shard, without gaps); shards differ by one row at most.

    Rows are ordered by curve index, then by ``ties``. A null dimension counts as cell 0. Rows
    equal in dimensions and ties may come in any order; an empty frame gives an empty frame.
    The input is read twice (quantiles, then ranks), so pass narrow rows.
    """
    cells, names = quantised(df, dims, bits)
    curved = cells.withColumn("curve", hilbert_index([F.col(q) for q in names], bits)).drop(*names)
    ranked = global_rank(curved, [F.col("curve"), *[F.col(t) for t in ties]])
    rows = ranked.count()
    s = F.expr(f"_rank * {shards}L div {max(rows, 1)}L")
    first = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", s.cast("int")).withColumn("slot", (F.col("_rank") - first).cast("long")).drop("_rank")


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shards of documents by language, source and size: doc_id, size (UTF-8 bytes + 1), text_crc32,
    lang, source, curve, shard, slot. A null text has no bytes: size 1, CRC 0. Equal texts with equal
    metadata are neighbours on the curve (ties go by a hash of the text, then by doc_id)."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    narrow = stored(docs.select(
        "doc_id", "lang", "source", (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"), F.xxhash64("text").alias("_text")), "meta")
    return hilbert_shards(narrow, ["lang", "source", "size"], ["_text", "doc_id"], shards).drop("_text")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Writes all rows of ``docs`` below ``path``, one folder for each shard, rows in curve order, so
    that a reader's min/max statistics prune on each dimension. Whole rows go through the ranking:
    null and repeated doc_ids are written as they come. Adds shard (the folder) and slot."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.withColumns({"_size": (F.octet_length(data) + 1).cast("long"), "_text": F.xxhash64("text")})
    placed = hilbert_shards(rows, ["lang", "source", "_size"], ["_text", "doc_id"], shards).drop("_size", "_text", "curve")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
