"""Context-triggered piecewise hashing of documents.

A rolling hash of the last 8 bytes ends a chunk wherever its low bits are all
ones, so borders move with the text. A fingerprint holds the chunk hashes at a
block size that follows the length, and at twice that size. Two fingerprints
are compared by edit distance where they share a block size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.llm.store import stored
from turfline.llm.words import BYTE_VALUES, mix, span_hashes

#: Chunks that a text of full length has on average at its block size; half as many at least.
CHUNKS = 64
LEAST_BLOCK = 4
#: Symbols in a signature; the last one covers the rest of the text.
MOST_SYMBOLS = 128
#: Base64 digits; a symbol is two of them, 12 bits of a chunk's hash.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SYMBOLS = np.array([a + b for a in DIGITS for b in DIGITS])
_M1, _M2, _M4 = (np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4))


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the bytes i - 7 to i for each i."""
    h = BYTE_VALUES[data]
    for step, factor in ((1, _M1), (2, _M2), (4, _M4)):
        older = h[:-step] * factor if len(h) > step else None
        h = h.copy()
        if older is not None:
            h[step:] += older
    return mix(h)


def _signature(data: np.ndarray, ends: np.ndarray) -> str:
    ends = ends[:MOST_SYMBOLS - 1]
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    starts = np.concatenate([[0], ends[:-1]])
    return "".join(_SYMBOLS[(span_hashes(data, starts, ends) >> np.uint64(52)).astype(np.int64)].tolist())


def fingerprint(text: bytes) -> str:
    """``block:signature:signature at twice the block``; equal bytes give equal fingerprints.
    An empty text has empty signatures."""
    block = LEAST_BLOCK
    while block * CHUNKS < len(text):
        block *= 2
    if not text:
        return f"{block}::"
    data = np.frombuffer(text, dtype=np.uint8)
    rolled = _rolling(data)
    ones = np.uint64(block - 1)
    ends = np.flatnonzero((rolled & ones) == ones)
    double = np.uint64(2 * block - 1)
    wider = ends[(rolled[ends] & double) == double]
    return f"{block}:{_signature(data, ends + 1)}:{_signature(data, wider + 1)}"


def _common(a: str, b: str) -> float:
    """1 - (insertions + deletions) / symbols, over symbols of two digits."""
    x = [a[i:i + 2] for i in range(0, len(a), 2)]
    y = [b[i:i + 2] for i in range(0, len(b), 2)]
    if not x or not y:
        return 0.0
    where: dict[str, int] = {}
    for i, s in enumerate(x):
        where[s] = where.get(s, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full  # zeros mark the longest common subsequence so far
    for s in y:
        if s in where:
            hit = row & where[s]
            row = ((row + hit) | (row - hit)) & full
    return 2.0 * (len(x) - row.bit_count()) / (len(x) + len(y))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1: 1 for equal ones; 0 if they share no block size or
    just one of the texts is empty; else by edit distance at a shared block size."""
    if a == b:
        return 1.0
    size_a, one_a, two_a = a.split(":")
    size_b, one_b, two_b = b.split(":")
    if size_a == size_b:
        return max(_common(one_a, one_b), _common(two_a, two_b))
    if int(size_a) * 2 == int(size_b):
        return _common(two_a, one_b)
    if int(size_b) * 2 == int(size_a):
        return _common(one_a, two_b)
    return 0.0


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in RESULT.split(", ")]


class _Row:
    """A document with its fingerprint, which is made once."""

    def __init__(self, key: int | None, text: str | None):
        self.key, self.text = key, text or ""
        self.print = fingerprint(self.text.encode())

    def against(self, following: _Row) -> tuple:
        half = len(self.text) // 2
        edited = (self.text[:len(self.text) - half] + following.text[:half]).encode()
        edited_print = fingerprint(edited)
        return (self.key, len(self.text), hashlib.sha256(edited).hexdigest(), self.print, edited_print,
                likeness(self.print, edited_print), likeness(self.print, following.print))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def fingerprints(docs: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text and how near these and the next text's are.

    Rows follow each other in descending doc_id (equal ids by a hash of the text, null ids last);
    after the last comes the first, which for a single row is itself. The edited text is the text
    with its last half (rounded down, in code points) replaced by as many of the next text. A null
    text counts as empty. Equal rows are rows of their own. An empty frame gives an empty frame.

    Texts are shuffled once, into ranges of the order. Each task pairs the rows of its range and
    passes on its first and last row; those two for each range are joined by the range's number.
    """
    order = order or [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None

        def with_ends(out: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
            n, m = len(out), len(ends)
            done = _table(out + [(None,) * len(_NAMES)] * m)
            return pa.RecordBatch.from_arrays(
                [*done.columns, pa.array([None] * n + [e[0] for e in ends], pa.string()),
                 pa.array([part] * (n + m), pa.int32()), pa.array([None] * n + [e[1].key for e in ends], pa.int64()),
                 pa.array([None] * n + [e[1].text for e in ends], pa.string())],
                names=[*_NAMES, "_end", "_part", "_key", "_text"])

        for batch in batches:
            out = []
            for key, text, at in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                row = _Row(key, text)
                if last is None:
                    first, part = row, at
                else:
                    out.append(last.against(row))
                last = row
            if out:
                yield with_ends(out, [])
        if first is not None:
            yield with_ends([], [("first", first), ("last", last)])

    done = stored(ranged.mapInArrow(pair, f"{RESULT}, _end string, _part int, _key long, _text string"), "fingerprints")
    ends = done.where(F.col("_end").isNotNull())
    parts = ends.where("_end = 'first'").select("_part")  # one row for each range
    around = Window.orderBy("_part")
    following = parts.select(
        F.col("_part").alias("_of"),
        F.coalesce(F.lead("_part").over(around), F.first("_part").over(around)).alias("_next"))
    heads = ends.where("_end = 'first'").select(F.col("_part").alias("_next"), F.col("_key").alias("_next_key"), F.col("_text").alias("_next_text"))
    tails = ends.where("_end = 'last'").select(F.col("_part").alias("_of"), "_key", "_text")
    border = tails.join(following, "_of").join(heads, "_next").select("_key", "_text", "_next_key", "_next_text")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([_Row(k, t).against(_Row(nk, nt)) for k, t, nk, nt in zip(*[c.to_pylist() for c in batch.columns])])

    return done.where(F.col("_end").isNull()).select(*_NAMES).unionByName(border.mapInArrow(across, RESULT))
