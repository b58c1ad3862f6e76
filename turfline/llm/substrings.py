"""Substring dedup: words that lie in a window of words found anywhere else are removed.

Every text is factored against all texts, itself included. The index holds one
anchor for each run of windows: the smallest hash of the 18-word blocks in a
window of 35 words, so equal windows have equal anchors at equal places. Where an
anchor occurs again and all its occurrences agree in all words around it, the run
is a factor. Where they do not agree (the borders of factors), each window is
looked up by its own hash. A removed span is a union of windows of at least 35 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm.store import map_arrow, stored
from turfline.llm.words import find_words, gram_hashes, gram_starts, mix, powers, ragged_range, span_hashes, text_slices

WINDOW = 35
#: Words of a block; a window has as many blocks as a block has words.
BLOCK = 18


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, digest) of each run of windows with one anchor;
    windows are numbered by their first word in the text."""
    at, counts = gram_starts(first, WINDOW)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    blocks = gram_hashes(words, BLOCK)
    where = at + np.lib.stride_tricks.sliding_window_view(blocks, WINDOW - BLOCK + 1)[at].argmin(axis=1)
    owner = np.repeat(np.arange(len(first) - 1), counts)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (where[1:] != where[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    lo, hi, place = at[begin], at[end], where[begin]
    up, down = powers(0xA0761D6478BD642F, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    digest = mix((sums[hi + WINDOW] - sums[lo]) * down[lo])
    digest = mix(digest + (((hi - lo) << 8) + (place - lo) + 1).astype(np.uint64))
    text = owner[begin]
    return text, lo - first[text], hi - first[text], blocks[place], digest


def kept_words(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    """Words removed from the text, and the rest joined by single spaces; a span holds the first
    and the last of a run of windows."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    starts, ends, _ = find_words(data, np.array([0, len(data)]))
    depth = np.zeros(len(starts) + 1, dtype=np.int64)
    if len(spans):
        s = np.asarray(spans, dtype=np.int64)
        np.add.at(depth, s[:, 0], 1)
        np.add.at(depth, s[:, 1] + WINDOW, -1)
    keep = np.cumsum(depth)[:-1] == 0
    starts, ends = starts[keep], ends[keep]
    out = np.append(data, np.uint8(32))[ragged_range(starts, ends - starts + 1)]
    out[np.cumsum(ends - starts + 1) - 1] = 32
    return int((~keep).sum()), out[:-1].tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    """Equal rows (doc_id and text) have an equal key of two hashes; they have equal spans too."""
    return docs.withColumns({"_row": F.xxhash64(F.col("doc_id").cast("long"), "text"), "_text": F.xxhash64(F.lit(5), "text")})


def duplicate_spans(rows: DataFrame) -> DataFrame:
    """_row, _text, spans (array of lo, hi: first and last window) of the rows that have any."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows_here, data, offsets in text_slices(batch.column(2)):
                starts, ends, first = find_words(data, offsets)
                text, lo, hi, anchor, digest = anchors(span_hashes(data, starts, ends), first)
                take = pa.array(text + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                     _longs(anchor), _longs(digest)], names=["_row", "_text", "lo", "hi", "anchor", "digest"])

    runs = map_arrow(rows.select("_row", "_text", "text"), index, "_row long, _text long, lo int, hi int, anchor long, digest long")
    runs = stored(runs, "anchors")
    again = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.min("digest").alias("_l"), F.max("digest").alias("_h"))
    again = again.where("_n > 1").select("anchor", (F.col("_l") == F.col("_h")).alias("whole"))
    found = stored(runs.join(again, "anchor").select("_row", "_text", "lo", "hi", "whole"), "factors")
    borders = found.where(~F.col("whole")).groupBy("_row", "_text").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    open_rows = rows.select("_row", "_text", "text").join(borders, ["_row", "_text"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                starts, ends, _ = find_words(data, np.array([0, len(data)]))
                hashes = gram_hashes(span_hashes(data, starts, ends), WINDOW, salt=1)
                lo = np.array([s["lo"] for s in spans], dtype=np.int64)
                at = ragged_range(lo, np.array([s["hi"] for s in spans], dtype=np.int64) - lo + 1)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row)), pa.array(np.full(n, key)), pa.array(at.astype(np.int32)), _longs(hashes[at])],
                    names=["_row", "_text", "lo", "hash"])

    single = stored(map_arrow(open_rows.select("_row", "_text", "text", "spans"), windows, "_row long, _text long, lo int, hash long"), "windows")
    more = single.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("hash")
    single = single.join(more, "hash").select("_row", "_text", "lo", F.col("lo").alias("hi"))
    spans = found.where("whole").select("_row", "_text", "lo", "hi").unionByName(single)
    return stored(spans.groupBy("_row", "_text").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")


def _pairs(spans: list[dict] | None) -> list[tuple[int, int]]:
    return [(s["lo"], s["hi"]) for s in spans] if spans is not None else []


def substring_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row.

    Null and empty texts have no words: 0, 0 and the digest of nothing. A row that occurs twice
    counts as two documents, so all its windows occur elsewhere. Nulls in doc_id are kept. An
    empty frame gives an empty frame.
    """
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = duplicate_spans(rows)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, marked = batch.column(1).to_pylist(), batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for key, text, s in zip(batch.column(0).to_pylist(), texts, marked):
                removed, rest = kept_words(text, _pairs(s))
                total = len(find_words(d := np.frombuffer((text or "").encode(), dtype=np.uint8), np.array([0, len(d)]))[0])
                out.append((key, total, removed, hashlib.sha256(rest).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    result = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    clean = rows.join(spans.select("_row", "_text"), ["_row", "_text"], "left_anti").select("doc_id", "text")
    marked = rows.join(spans, ["_row", "_text"]).select("doc_id", "text", "spans")
    return map_arrow(clean, report, result).unionByName(map_arrow(marked, report, result))


def remove_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with the duplicate spans cut out of ``text`` and ``n_chars`` counted anew, where it
    is there. A text without such spans stays as it is."""
    rows = _keyed(docs)
    spans = duplicate_spans(rows)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else kept_words(t, _pairs(s))[1].decode() for t, s in zip(texts, spans)], dtype=object)

    out = rows.join(spans, ["_row", "_text"], "left").withColumn("text", cut("text", "spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
