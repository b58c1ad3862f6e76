"""Dictionary names in texts: a ladder of prefix hashes, one path for dictionaries of every size.

A name's length is a sum of falling powers of two, and its prefixes of these lengths are the rungs
on which it is reached: a name of 13 bytes has rungs of 8, 12 and 13 bytes. The hashes of all
windows of a power of two follow from those of half the size, for a whole batch of texts at once. At
every place of a text the climb goes on only while a Bloom filter of all rungs lets it; what
reaches a last rung is a candidate. Candidates meet the names by an equi-join on the bytes
themselves, which verifies them. The filter has a fixed size, whatever the dictionary's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.plans.guards import looked_up, spread
from turfline.session import ship_package

#: Bits of the filter (the driver sees at most a 64th as many words, 8 bytes each).
FILTER_BITS = 1 << 25
#: Bytes of text at whose places the climb starts at once.
BLOCK = 1 << 19

_U = np.uint64
RUNG, LAST = 0x243F6A8885A308D3, 0x13198A2E03707344


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _ladder(data: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Hashes of all windows of 1, 2, 4, ... ``top`` bytes, by their first byte."""
    hashes = {1: _mix(data.astype(np.uint64) + _U(1))}
    r = 1
    while 2 * r <= top:
        h = hashes[r]
        wide = h[:max(0, len(h) - r)] * _U(0x9E3779B97F4A7C15) + h[r:] if len(h) > r else h[:0]
        hashes[2 * r] = _mix(wide + _U(2 * r))
        r *= 2
    return hashes


def _climb(before: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The hash of a prefix from that of the rung before and of the window that follows."""
    return _mix(before * _U(0x9FB21C651E98DF25) + window)


def _bits(hashes: np.ndarray, kind: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter of ``size`` (a power of two) for each hash."""
    key = _mix(hashes ^ _U(kind))
    return (key & _U(size - 1)).astype(np.int64), ((key >> _U(32)) & _U(size - 1)).astype(np.int64)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the offsets of its rows."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _powers(longest: int) -> list[int]:
    return [1 << i for i in range(longest.bit_length() - 1, -1, -1)]


def _rungs(batches: Iterator[pa.RecordBatch], filter_bits: int) -> Iterator[pa.RecordBatch]:
    """Words of the filter that the names of a batch set; below zero, the powers of two they use."""
    for batch in batches:
        data, offsets = _buffer(batch.column(0))
        start, size = offsets[:-1], np.diff(offsets)
        longest = int(size.max()) if len(size) else 0
        ladder, words, masks = _ladder(data, longest), [], []
        at, hashes = np.zeros(len(size), np.int64), np.zeros(len(size), np.uint64)
        for r in _powers(longest):
            has = np.flatnonzero(size & r)
            if not len(has):
                continue
            hashes[has] = _climb(hashes[has], ladder[r][start[has] + at[has]])
            at[has] += r
            last = at[has] == size[has]
            for h, kind in ((hashes[has], RUNG), (hashes[has[last]], LAST)):
                for bit in _bits(h, kind, filter_bits):
                    words.append(bit >> 6)
                    masks.append(np.left_shift(_U(1), (bit & 63).astype(np.uint64)).view(np.int64))
            words.append(np.array([-r]))
            masks.append(np.zeros(1, np.int64))
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(words)), pa.array(np.concatenate(masks))], names=["word", "mask"])


def occurrences(texts: DataFrame, names: DataFrame, text_col: str, name_col: str, id_col: str,
                filter_bits: int = FILTER_BITS) -> DataFrame:
    """(id, name) for every name that occurs in a text, case-insensitively: all columns of ``names`` and the text's id.

    Null or empty names and null texts meet nothing. Texts are searched whole. Names that differ in case
    alone are each found."""
    ship_package(texts.sparkSession)
    keyed = names.withColumn("_key", F.encode(F.lower(name_col), "UTF-8")).where(F.length("_key") > 0)
    filled = keyed.select("_key").distinct().mapInArrow(lambda batches: _rungs(batches, filter_bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    bloom, tops = np.zeros(filter_bits // 64, np.uint64), []
    for r in filled.collect():  # at most filter_bits / 64 words
        if r["word"] < 0:
            tops.append(-r["word"])
        else:
            bloom[r["word"]] = np.int64(r["mask"]).view(np.uint64)
    powers = sorted(tops, reverse=True)
    shared = texts.sparkSession.sparkContext.broadcast(bloom)
    schema = T.StructType([T.StructField(id_col, texts.schema[id_col].dataType), T.StructField("_key", T.BinaryType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value

        def known(hashes: np.ndarray, kind: int) -> np.ndarray:
            found = np.ones(len(hashes), dtype=bool)
            for bit in _bits(hashes, kind, filter_bits):
                found &= (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & _U(1) > 0
            return found

        reach = sum(powers)  # no name is longer
        for batch in batches:
            data, offsets = _buffer(batch.column(1).fill_null(b""))
            for block in range(0, len(data), BLOCK):
                part = data[block:block + BLOCK + reach]
                ladder = _ladder(part, powers[0])
                row = np.searchsorted(offsets, np.arange(block, min(block + BLOCK, len(data))), side="right") - 1
                end = offsets[row + 1] - block  # where the text of each place ends
                place, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
                hashes, done = np.zeros(0, np.uint64), []
                for r in powers:
                    first = np.arange(len(row))
                    before = np.concatenate([place, first])
                    upto = np.concatenate([at, np.zeros(len(first), np.int64)])
                    old = np.concatenate([hashes, np.zeros(len(first), np.uint64)])
                    fits = before + upto + r <= end[before]
                    before, upto, old = before[fits], upto[fits], old[fits]
                    new = _climb(old, ladder[r][before + upto])
                    up = known(new, RUNG)
                    before, upto, new = before[up], upto[up] + r, new[up]
                    full = known(new, LAST)
                    done.append((before[full], upto[full]))
                    place, at, hashes = np.concatenate([place, before]), np.concatenate([at, upto]), np.concatenate([hashes, new])
                begin, size = (np.concatenate([d[i] for d in done]) for i in range(2))
                found = {(int(row[b]), part[b:b + n].tobytes()) for b, n in zip(begin.tolist(), size.tolist())}
                if found:
                    rows, keys = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(keys, pa.binary())], names=schema.names)

    if not powers:
        return texts.select(id_col).limit(0).join(names.limit(0))
    lowered = texts.select(id_col, F.encode(F.lower(text_col), "UTF-8").alias("_text"))
    candidates = spread(lowered).mapInArrow(search, schema).distinct()
    return looked_up(candidates, "_key", keyed).drop("_key")
