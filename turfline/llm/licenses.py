"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Words are runs of letters and digits, lower case. Each class of template lengths has
its own windows, twice as long as the templates and half overlapping, so every run of
a template's length lies whole in a window. A window that shares a MinHash value with
a template is a candidate; bands hold one value each, and there are so many of them
that a template with the least containment is missed with ``MISS`` at most. Candidates
are verified by the share of the template's shingles in the window.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm.store import map_arrow
from turfline.llm.words import find_words, gram_hashes, gram_starts, mix, span_hashes, text_slices

SHINGLE = 5
#: Least share of a template's shingles, in hundredths.
CONTAINMENT = 75
MISS = 1e-4

# Usual one-line notices and the first sentences of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-line": "Released under the BSD License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"),
    "ISC-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
}

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text in order, and their counts; a shorter text is one shingle."""
    plain = _PLAIN[data]
    starts, ends, first = find_words(plain, offsets)
    words = span_hashes(plain, starts, ends)
    at, counts = gram_starts(first, SHINGLE)
    grams, owner = gram_hashes(words, SHINGLE)[at] if len(at) else words[:0], np.repeat(np.arange(len(counts)), counts)
    sizes = np.diff(first)
    for few in range(1, SHINGLE):
        rows = np.flatnonzero(sizes == few)
        if len(rows):
            grams = np.concatenate([grams, gram_hashes(words, few, salt=few)[first[rows]]])
            owner = np.concatenate([owner, rows])
    order = np.argsort(owner, kind="stable")
    return grams[order], np.bincount(owner, minlength=len(counts))


def _values(grams: np.ndarray, band: int) -> np.ndarray:
    a, b = mix(np.array([2 * band + 1, 2 * band + 2], dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    return (grams ^ a) * (b | np.uint64(1))


def bands_for(shingles: int, window: int, miss: float = MISS) -> int:
    """Bands of one value by which a window of so many shingles that holds the least share of the
    template's is missed with at most this probability."""
    common = -(-CONTAINMENT * shingles // 100)
    likeness = common / (window + shingles - common)
    return int(np.ceil(np.log(miss) / np.log1p(-min(likeness, 1 - 1e-9))))


@dataclass
class LengthClass:
    step: int
    names: list[str] = field(default_factory=list)
    sets: list[np.ndarray] = field(default_factory=list)
    bands: int = 0


def length_classes(templates: Mapping[str, str]) -> list[LengthClass]:
    """Templates by number of shingles: each number to 16 a class of its own, then doubling."""
    classes: dict[int, LengthClass] = {}
    for name, text in sorted(templates.items()):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        grams = np.unique(_grams(data, np.array([0, len(data)]))[0])
        if not len(grams):
            raise ValueError(f"template {name!r} has no words")
        step = len(grams) if len(grams) <= 16 else 1 << (len(grams) - 1).bit_length()
        c = classes.setdefault(step, LengthClass(step))
        c.names.append(name)
        c.sets.append(grams)
        c.bands = max(c.bands, bands_for(len(grams), 2 * step))
    return [classes[s] for s in sorted(classes)]


def find_templates(grams: np.ndarray, counts: np.ndarray, classes: list[LengthClass]) -> dict[tuple[int, str], tuple[float, int]]:
    """(text, template) -> (greatest containment, first shingle of the first window that has it)."""
    found: dict[tuple[int, str], tuple[float, int]] = {}
    if not len(grams):
        return found
    begins = np.cumsum(counts) - counts
    plans = []
    for c in classes:
        pieces = -(-counts // c.step)
        owner = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        plans.append((c, owner, nth, begins[owner] + nth * c.step, np.zeros((len(owner), len(c.names)), dtype=bool)))
    for band in range(max(c.bands for c in classes)):
        values = _values(grams, band)
        for c, owner, _, starts, hits in plans:
            if band < c.bands:
                least = np.minimum.reduceat(values, starts)
                wide = least.copy()
                wide[:-1] = np.where(owner[1:] == owner[:-1], np.minimum(least[1:], least[:-1]), least[:-1])
                for t, s in enumerate(c.sets):
                    hits[:, t] |= wide == _values(s, band).min()
    for c, owner, nth, starts, hits in plans:
        for w, t in zip(*np.nonzero(hits)):
            text, s = int(owner[w]), c.sets[t]
            window = grams[starts[w]:min(starts[w] + 2 * c.step, begins[text] + counts[text])]
            both = len(np.intersect1d(window, s))
            if 100 * both >= CONTAINMENT * len(s):
                key, got = (text, c.names[t]), (both / len(s), int(nth[w]) * c.step)
                if key not in found or (-got[0], got[1]) < (-found[key][0], found[key][1]):
                    found[key] = got
    return found


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment (0.75 to 1), position (shingles before the window) of each
    template that a text holds, once for each row and template.

    Templates are a parameter, sent to all tasks. Null and empty texts hold none. Repeated rows give
    repeated results; a null doc_id is kept. Templates that share most shingles (versions of one
    license) are all reported; the one with containment 1 is exact. An empty frame gives an empty frame.
    """
    classes = length_classes(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, _, data, offsets in text_slices(batch.column(1)):
                rows = [(keys[first + text], name, *got) for (text, name), got in sorted(find_templates(*_grams(data, offsets), classes).items())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64()))],
                    names=["doc_id", "license", "containment", "position"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan,
                     "doc_id long, license string, containment double, position long")
