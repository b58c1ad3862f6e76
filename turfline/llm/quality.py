"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics. The sums, and sums of
products, of the vectors of each class are added up over all labelled rows of
the training part; class covariances are shrunk towards the pooled one and
towards a multiple of the identity. The score of a text is the logistic of the
difference of the two Gaussian log-densities, with their Cholesky factors kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.llm.store import map_arrow, stored
from turfline.llm.words import find_words, ragged_range, span_hashes, text_slices

#: Share of the pooled covariance in each class's, and of the identity after that.
POOLED, IDENTITY = 0.1, 0.02
#: A text with this score or more passes.
THRESHOLD = 0.3
#: Repetition is counted as if each text had so many more words, none repeated: chance repeats in a line are no sign.
FEW = 20

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 capital, 2 digit, 3 mark of a sentence, 4 other symbol, 5 line feed, 6 white space
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[list(b".,;:?'\"()-")] = 3
_CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 4
_CLASS[10] = 5
_CLASS[[9, 11, 12, 13, 32]] = 6
NAMES = ["words", "word_length", "word_spread", "capitals", "digits", "marks", "symbols", "lines",
         "distinct", "repeated", "repeated_pairs", "common_word", "stops"]


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[offsets]).astype(float)


def _distinct(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and how often its most frequent one occurs."""
    if not len(hashes):
        return np.zeros(texts), np.zeros(texts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
    runs = np.diff(np.append(new, len(h)))
    most = np.zeros(texts)
    np.maximum.at(most, o[new], runs)
    return np.bincount(o[new], minlength=texts).astype(float), most


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    starts, ends, first = find_words(data, offsets)
    words = np.diff(first).astype(float)
    per = 1.0 / np.maximum(words, 1.0)
    owner = np.repeat(np.arange(n), np.diff(first))
    lengths = (ends - starts).astype(float)
    mean = np.bincount(owner, lengths, n) * per
    spread = np.sqrt(np.maximum(np.bincount(owner, lengths * lengths, n) * per - mean * mean, 0))
    kind = _CLASS[data]
    capital = kind == 1
    if len(data) > 1:  # capitals of two bytes in Latin-1: C3 80 to C3 9E
        capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    letters = 1.0 / np.maximum(np.bincount(owner, lengths, n), 1.0)
    hashes = span_hashes(data, starts, ends)
    distinct, most = _distinct(hashes, owner, n)
    same = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    pairs = np.maximum(words - 1, 0)
    at = ragged_range(first[:-1], pairs.astype(np.int64))
    pair_hashes = hashes[at] * np.uint64(0x9E3779B97F4A7C15) + hashes[at + 1] if len(at) else hashes[:0]
    distinct_pairs, _ = _distinct(pair_hashes, owner[at] if len(at) else owner[:0], n)
    stops = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        stops[:] = np.isin(data[ends - 1], np.frombuffer(b".?!", dtype=np.uint8))
    rate = lambda x, eps: np.log((x + eps) / eps)  # noqa: E731  0 for none, about linear far below eps
    return np.column_stack([
        np.log1p(words),
        mean / 4.0,
        spread / 4.0,
        rate(_per_text(capital, offsets) * letters, 0.05),
        rate(_per_text(kind == 2, offsets) * letters, 0.05),
        rate(_per_text(kind == 3, offsets) * letters, 0.05),
        rate(_per_text(kind == 4, offsets) * letters, 0.02),
        rate(_per_text(kind == 5, offsets) * per, 0.02),
        np.log1p(distinct) - 0.8 * np.log1p(words),
        rate(np.bincount(owner, same, n) / (words + FEW), 0.05),
        rate(np.maximum(pairs - distinct_pairs, 0) / (pairs + FEW), 0.1),
        rate(most / (words + FEW), 0.1),
        rate(np.bincount(owner, stops, n) * per, 0.05),
    ])


def statistics(texts: pa.Array) -> np.ndarray:
    """The transformed statistics of each whole text (null counts as empty), one row for each."""
    parts = [_statistics(data, offsets) for _, _, data, offsets in text_slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` (array of doubles) of each row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(1))
            offsets = pa.array(np.arange(len(stats) + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(stats.ravel()))], names=["doc_id", "stats"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), measure, "doc_id long, stats array<double>")


@dataclass
class Discriminant:
    """Means, Cholesky factors (of the inverse scale: solved against), log-determinants and log-prior ratio."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    prior: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        z = (stats - self.shift) / self.scale
        density = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets):
            w = np.linalg.solve(factor, (z - mean).T)
            density.append(-0.5 * (w * w).sum(axis=0) - 0.5 * logdet)
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0] + self.prior, -500, 500)))


@dataclass
class Constant:
    """Where a class has no labelled row: 1 if only class 1 has, 0 if only class 0, else 0.5."""

    value: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.full(len(stats), self.value)


def fit(moments: dict[int, np.ndarray], pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant | Constant:
    """From the matrix [[n, sums], [sums, products]] of each class."""
    counts = {c: m[0, 0] for c, m in moments.items()}
    if not counts.get(0) or not counts.get(1):
        return Constant(1.0 if counts.get(1) else 0.0 if counts.get(0) else 0.5)
    total = moments[0] + moments[1]
    shift = total[0, 1:] / total[0, 0]
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / total[0, 0] - shift**2, 1e-9))
    means, spreads = [], []
    for c in (0, 1):
        m = moments[c]
        mean = m[0, 1:] / m[0, 0]
        spread = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
        means.append((mean - shift) / scale)
        spreads.append(spread / np.outer(scale, scale))
    both = (counts[0] * spreads[0] + counts[1] * spreads[1]) / (counts[0] + counts[1])
    factors, logdets = [], []
    for spread in spreads:
        s = (1 - pooled) * spread + pooled * both
        s = (1 - identity) * s + identity * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        factors.append(factor)
        logdets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(shift, scale, means, factors, logdets, float(np.log(counts[1] / counts[0])))


def held_out(key: Column) -> Column:
    """True for the fifth of rows that never train: crc32(key as text) mod 5 is 0. False for a null key."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant | Constant:
    """Fits on all labelled rows that are not held out; labels other than 0 and 1 are left out.
    A label given twice counts twice. Only sums come to the driver: (statistics + 1)**2 for each class."""
    d = len(NAMES) + 1
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y"))
    marked = marked.where(F.col("_y").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = stats.join(marked, "doc_id").select("_y", "stats")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, d, d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d - 1)
            x = np.column_stack([np.ones(len(x)), x])
            for c in (0, 1):
                sums[c] += x[y == c].T @ x[y == c]
        at = np.arange(2 * d * d)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums.ravel())], names=["at", "value"])

    cells = rows.mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(2 * d * d)
    for r in cells:
        flat[r["at"]] = r["value"]
    flat = flat.reshape(2, d, d)
    return fit({0: flat[0], 1: flat[1]})


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    The statistics are those of the text alone. A null or empty text is scored by the statistics
    of an empty one. Repeated rows get equal scores. Without labelled rows of a class the score is
    constant (see ``Constant``). An empty frame gives an empty frame.
    """
    stats = stored(with_statistics(docs), "stats")
    model = train(stats, labels, label)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns. Scored as ``score_documents`` does."""
    model = train(with_statistics(docs), labels, label)
    at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(statistics(batch.column(at))) >= threshold))

    return map_arrow(docs, choose, docs.schema)
