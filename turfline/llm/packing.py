"""Packing token sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm.store import global_rank, map_arrow, stored
from turfline.llm.words import ragged_range, text_slices

#: Distinct words whose ids a Python worker remembers (about 200 bytes each); beyond, it keeps those it met again.
CACHE_WORDS = 400_000
#: Distinct words that are encoded as one text, with a mark between them.
JOINED, MARK = 200, "0"
#: Bytes of text that are encoded at once.
SLICE = 6 << 20
#: Texts of joined words that are encoded at once: their encodings take far more memory than their ids.
ENCODED = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts through the ids of their distinct words.

    Right for a tokenizer whose normaliser and splitter see no further than white space (as that
    of ``word_bpe_49k``: composition, lower case, a split that drops white space): the ids of a
    text are those of its words one after another. ``tests/llm`` compares with whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # word -> its ids as unsigned 32-bit numbers
        self.again: set[str] = set()  # words met after the texts they were learned from
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def learn(self, words: list[str]) -> None:
        """Encodes words, many as one text. The mark's id parts them; words that hold the mark, and a
        text whose parts are not as many as its words, are encoded one by one."""
        plain = [w for w in words if MARK not in w] if len(self.mark) == 1 else []
        runs = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        alone = [w for w in words if MARK in w] if len(self.mark) == 1 else words
        for run, encoding in self._encoded(runs):
            ids = np.array(encoding.ids, dtype=np.uint32)
            marks = np.flatnonzero(ids == self.mark[0])
            if len(marks) != len(run) - 1:
                alone = alone + run
                continue
            raw = ids.tobytes()
            starts, ends = [0, *(4 * (marks + 1)).tolist()], [*(4 * marks).tolist(), len(raw)]
            self.known.update((w, raw[a:b]) for w, a, b in zip(run, starts, ends))
        for (w,), encoding in self._encoded([[w] for w in alone]):
            self.known[w] = np.array(encoding.ids, dtype=np.uint32).tobytes()

    def _encoded(self, runs: list[list[str]]) -> Iterator[tuple]:
        """Each run of words with the encoding of its words, the mark between them."""
        for i in range(0, len(runs), ENCODED):
            some = runs[i:i + ENCODED]
            yield from zip(some, self.tokenizer.encode_batch_fast([f" {MARK} ".join(run) for run in some], add_special_tokens=False))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        distinct = words.dictionary.to_pylist()
        old = self.known.keys() & distinct
        new = [w for w in distinct if w not in old]
        self.again |= old
        self.learn(new)
        each = [self.known[w] for w in distinct]
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
        pool = np.frombuffer(b"".join(each), dtype=np.uint32)
        if len(self.known) > CACHE_WORDS:
            kept = self.again if len(self.again) <= CACHE_WORDS // 2 else old
            self.known, self.again = {w: self.known[w] for w in kept}, set()
        index = words.indices.to_numpy(zero_copy_only=False)
        counts = sizes[index] if len(index) else np.zeros(0, np.int64)
        ids = pool[ragged_range((np.cumsum(sizes) - sizes)[index], counts)] if len(index) else pool
        before = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return ids, np.diff(before[ends])


@lru_cache(2)
def encoder_of(path: str) -> WordEncoder:
    """One encoder for a Python worker, which later tasks find as they left it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
    return WordEncoder(path)


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
#: Pieces in an Arrow batch at most.
PIECE_ROWS = 4_096


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, most: int = 2048) -> DataFrame:
    """Pieces of at most ``most`` ids of every text (null: empty), each text followed by ``end_id``:
    doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit numbers)."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in joined(batches, SLICE):
            texts = batch.column(1).fill_null("")
            for first, rows, _, _ in text_slices(texts, SLICE):
                ids, counts = encoder.ids(texts.slice(first, rows))
                totals = counts + 1
                ends = np.cumsum(totals)
                flat = np.full(int(ends[-1]), end_id, dtype="<u4")
                inner = np.ones(len(flat), dtype=bool)
                inner[ends - 1] = False
                flat[inner] = ids
                pieces = -(-totals // most)
                owner = np.repeat(np.arange(rows), pieces)
                starts = most * ragged_range(np.zeros(rows, np.int64), pieces)
                lengths = np.minimum(totals[owner] - starts, most)
                borders = np.concatenate([[0], np.cumsum(lengths)])
                keys = batch.column(0).take(pa.array(first + owner))
                for at in range(0, len(owner), PIECE_ROWS):
                    some = slice(at, at + PIECE_ROWS)
                    n = len(owner[some])
                    offsets = borders[at:at + n + 1]
                    raw = flat[offsets[0]:offsets[-1]]
                    offsets = (4 * (offsets - offsets[0])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(at, n), pa.array(starts[some]), pa.array(lengths[some]), pa.array(totals[owner[some]]),
                         pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])],
                        names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECES)


def joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def pack_histogram(counts: dict[int, int], most: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """Packs lengths with these counts, longest first, each into the pack with the most room.

    Returns placements (length, rank, packs, sequence, offset): the pieces of this length with
    ranks ``rank`` to ``rank + packs - 1`` lie at ``offset`` of the sequences from ``sequence``
    on, one each. Packs with equal fill and pattern are one run of sequence numbers; a run is
    split when a length needs only a part of it. Its work depends on the lengths that occur,
    not on how often they do.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, packs)
    rooms: list[int] = []  # rooms that have runs, ascending
    placed, packs = [], 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room not in free:
            free[room] = []
            bisect.insort(rooms, room)
        free[room].append(run)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = rooms[-1] if rooms else 0
            if room < length:
                run, at = (packs, left), 0
                packs += left
                room = most
            else:
                run, at = free[room].pop(), most - room
                if not free[room]:
                    del free[room]
                    rooms.pop()
            n = min(left, run[1])
            placed.append((length, rank, n, run[0], at))
            if run[1] > n:
                put(room, (run[0] + n, run[1] - n))
            if room > length:
                put(room - length, (run[0], n))
            left -= n
            rank += n
    return placed


def pack_pieces(pieces: DataFrame, most: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``most``; other columns are kept.

    Patterns are found on the driver from the histogram of lengths (``most`` counts at most).
    Pieces of one length are numbered over the cluster and find their placement by that number,
    so no length, however frequent, is gathered in one task. The pieces are stored once.
    """
    pieces = stored(pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces", compression="zstd")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = pack_histogram(counts, most)
    before, at = {}, 0
    for length in sorted(counts):
        before[length] = at
        at += counts[length]
    placed.sort(key=lambda p: (p[0], p[1]))
    first = np.array([before[p[0]] + p[1] for p in placed], dtype=np.int64)
    sequence = np.array([p[3] for p in placed], dtype=np.int64)
    offset = np.array([p[4] for p in placed], dtype=np.int64)
    given = [c for c in pieces.columns if c != "_piece"]
    ties = [F.xxhash64(*[c for c in given if c != "length"])] + [F.col(c) for c in ("doc_id", "start") if c in given]
    keys = {f"_t{i}": t for i, t in enumerate(ties)}
    # only lengths and keys are sorted; the rest of a piece moves once, to its place
    ranked = global_rank(pieces.select("_piece", "length", *[t.alias(k) for k, t in keys.items()]), [F.col("length"), *map(F.col, keys)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rank = batch.column(1).to_numpy(zero_copy_only=False)
                i = np.searchsorted(first, rank, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sequence[i] + (rank - first[i])), pa.array(offset[i])], names=["_piece", "sequence_id", "offset"])

    places = map_arrow(ranked.select("_piece", "_rank"), place, "_piece long, sequence_id long, offset long")
    return pieces.join(places, "_piece").select(*given, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, most: int = 2048) -> DataFrame:
    """Every document's ids, cut only where it is longer than ``most``, packed into sequences.

    One row for each piece: doc_id, start, length, ids_crc32 (of ``ids``), doc_tokens, sequence_id,
    offset, ids; the ids of a sequence are those of its pieces in the order of their offsets. A null
    or empty text is the end id alone. Equal rows are separate pieces; a null doc_id is kept as
    null. An empty frame gives an empty frame.
    """
    packed = pack_pieces(token_pieces(docs, tokenizer, end_id, most), most)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
