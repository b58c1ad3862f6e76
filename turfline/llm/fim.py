"""Fill-in-middle texts by a piece table.

A document is a list of descriptors (buffer, start, length) over two buffers that never change:
its own UTF-8 bytes and the sentinels. Cutting splits descriptors, an arrangement permutes the
three sections and puts sentinel descriptors between them, the inverse permutation restores the
text, and digests are streamed over descriptors without a copy of the text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm.store import map_arrow
from turfline.llm.words import SLICE_BYTES, text_slices

Piece = tuple[int, int, int]  # buffer, start, length (bytes)

#: Buffers of a piece table.
TEXT, MARKS = 0, 1
SENTINELS = b"<P><S><M>"
MARK = {name: (MARKS, at, 3) for at, name in ((0, "P"), (3, "S"), (6, "M"))}
#: Each form: the sentinel before each section and the section (0 prefix, 1 middle, 2 suffix).
FORMS = {"psm": (("P", 0), ("S", 2), ("M", 1)), "spm": (("S", 2), ("P", 0), ("M", 1))}

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
#: Bytes of one text whose units are found at once, so that a very long text takes no more memory.
BLOCK = 1 << 20


class Units:
    """Units ``[A-Za-z]+|[^A-Za-z]`` of one UTF-8 text: their number, and where the k-th begins."""

    def __init__(self, raw: bytes):
        self.data = np.frombuffer(raw, dtype=np.uint8)
        self.blocks = range(0, len(raw), BLOCK)
        self.last: tuple[int, np.ndarray, np.ndarray] | None = None
        counts = [(len(s), c.sum()) for s, c in map(self._block, self.blocks)]
        self.units = [0, *accumulate(int(n) for n, _ in counts)]
        self.chars = [0, *accumulate(int(n) for _, n in counts)]
        self.n = self.units[-1]

    def _block(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the block from byte ``at`` where units begin, and which bytes begin a code point."""
        if self.last is None or self.last[0] != at:
            part = self.data[at:at + BLOCK]
            letter, first = LETTER[part], (part & 0xC0) != 0x80
            begins = first.copy()
            begins[1:] &= ~(letter[1:] & letter[:-1])
            if at and letter[0] and LETTER[self.data[at - 1]]:
                begins[0] = False
            self.last = (at, np.flatnonzero(begins), first)
        return self.last[1], self.last[2]

    def place(self, k: int) -> tuple[int, int]:
        """Byte and code point at which unit k begins (the ends of the text for k = n)."""
        if k >= self.n:
            return len(self.data), self.chars[-1]
        i = bisect_right(self.units, k) - 1
        starts, first = self._block(self.blocks[i])
        inside = int(starts[k - self.units[i]])
        return self.blocks[i] + inside, self.chars[i] + int(first[:inside].sum())


def split(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """Descriptors of the first ``at`` bytes and of the rest; one that covers the place becomes two."""
    left: list[Piece] = []
    for i, (buffer, start, length) in enumerate(pieces):
        if at < length:
            head = [(buffer, start, at)] if at else []
            return left + head, [(buffer, start + at, length - at), *pieces[i + 1:]]
        left.append((buffer, start, length))
        at -= length
    return left, []


def arranged(sections: list[list[Piece]], form: str) -> list[Piece]:
    return [p for mark, section in FORMS[form] for p in (MARK[mark], *sections[section])]


def sections_of(output: bytes, form: str) -> list[list[Piece]]:
    """Descriptors of prefix, middle and suffix over an arranged output."""
    begins = []
    at = 0
    for mark, _ in FORMS[form]:
        _, start, length = MARK[mark]
        at = output.index(SENTINELS[start:start + length], at) + length
        begins.append(at)
    ends = [b - 3 for b in begins[1:]] + [len(output)]
    placed = [[(TEXT, b, e - b)] for b, e in zip(begins, ends)]
    order = [section for _, section in FORMS[form]]
    return [placed[order.index(section)] for section in range(3)]  # the inverse permutation


def views(pieces: Iterable[Piece], raw: bytes) -> Iterator[memoryview]:
    buffers = memoryview(raw), memoryview(SENTINELS)
    return (buffers[buffer][start:start + length] for buffer, start, length in pieces)


def digest(pieces: Iterable[Piece], raw: bytes) -> str:
    sha = hashlib.sha256()
    for view in views(pieces, raw):
        sha.update(view)
    return sha.hexdigest()


ARRANGED = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, "
            "pieces array<struct<buffer: int, start: long, length: long>>")
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def fill_in_middle(docs: DataFrame, salt: str = "1:", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Every text (null: empty) cut into three and rearranged: doc_id, n, form, prefix_chars,
    middle_chars, output, output_sha256, pieces.

    ``n`` counts the units of the text. Places and form come from the sha256 of ``salt`` and the
    doc_id (a null doc_id: of the salt alone), so reruns agree and equal rows get equal results.
    An empty text, one that holds a sentinel, and a share of ``100 - plain_from`` in 100 stay
    plain: their output is the text, with null places. ``pieces`` are the descriptors of the
    output over the text (buffer 0) and the sentinels (buffer 1). Other columns of ``docs`` are
    not read, whatever their names. An empty frame gives an empty frame. Long texts are indexed
    in blocks.
    """
    code = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(code, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]).tolist()
            for first, rows, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                out: list[list] = [[] for _ in range(7)]
                for i in range(rows):
                    raw = data[offsets[i]:offsets[i + 1]].tobytes()
                    h1, h2, h3, h4 = hashes[first + i]
                    units = Units(raw)
                    sections: list[list[Piece]] = [[(TEXT, 0, len(raw))] if raw else []]
                    form, prefix, middle = "plain", None, None
                    if raw and h3 % 100 < plain_from and not any(m in raw for m in (b"<P>", b"<S>", b"<M>")):
                        form = "spm" if h4 % 100 < spm_below else "psm"
                        low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
                        (a, prefix), (b, upto) = units.place(low), units.place(high)
                        middle = upto - prefix
                        head, rest = split(sections[0], a)
                        sections = [head, *split(rest, b - a)]
                    pieces = sections[0] if form == "plain" else arranged(sections, form)
                    row = units.n, form, prefix, middle, b"".join(views(pieces, raw)), digest(pieces, raw), pieces
                    for column, value in zip(out, row):
                        column.append(value)
                n, forms, prefixes, middles, outputs, digests, tables = out
                structs = [[dict(zip(("buffer", "start", "length"), p)) for p in t] for t in tables]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                     pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string()),
                     pa.array(digests, pa.string()), pa.array(structs, _PIECES)],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "pieces"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *numbers), arrange, ARRANGED)


def restore(rows: DataFrame, keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """The text rebuilt from ``form`` and ``output`` alone: columns ``keep`` (default: all), then
    restored (unless ``with_text`` is false) and restored_sha256.

    Columns of ``rows`` named restored or restored_sha256 are replaced. A null output is an empty
    plain text. An output without the sentinels of its form is an error.
    """
    keep = [c for c in (rows.columns if keep is None else keep) if c not in ("restored", "restored_sha256")]
    schema = rows.select(keep).schema
    if with_text:
        schema = schema.add("restored", "string")
    schema = schema.add("restored_sha256", "string")
    chosen = rows.select(F.struct(*keep).alias("_kept"), F.col("form").alias("_form"), F.col("output").alias("_output"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column(0).flatten() if keep else []
            forms = batch.column(1).to_pylist()
            for first, n, data, offsets in text_slices(batch.column(2), SLICE_BYTES):
                texts, digests = [], []
                for i in range(n):
                    raw = data[offsets[i]:offsets[i + 1]].tobytes()
                    form = forms[first + i]
                    pieces = [p for s in sections_of(raw, form) for p in s] if form in FORMS else [(TEXT, 0, len(raw))]
                    digests.append(digest(pieces, raw))
                    if with_text:
                        texts.append(b"".join(views(pieces, raw)))
                columns = [c.slice(first, n) for c in kept]
                if with_text:
                    columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=schema.names)

    return map_arrow(chosen, rebuild, schema)
