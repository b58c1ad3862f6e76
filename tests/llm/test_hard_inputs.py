"""Groups of almost-copies that are no links, very long pages, small memories of words."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from turfline.llm import neardup, packing, pages
from turfline.llm.store import stored


def sets_of(texts):
    return [frozenset(tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)) for t in texts]


def brute(ids, sets):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def family(seed, n, changed):
    """n variants of one text with some words replaced, and some variants of variants."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(160)]
    texts = []
    for i in range(n):
        words = list(base if i % 5 or not texts else r.choice(texts).split())
        for _ in range(changed if i % 5 else r.randint(0, 3)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def test_families_without_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = family(1, 150, 6) + family(2, 90, 3) + family(3, 60, 14)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == brute(list(range(len(texts))), sets_of(texts))


def test_blocks_emit_links_not_pairs(spark):
    """All members of one bucket are plausible pairs of each other; a task emits fewer links than it has members."""
    texts = family(4, 120, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = stored(neardup.with_sets(docs), "sets")
    classes = stored(sets.selectExpr("xxhash64(_set) as id", "doc_id", "_text", "n_shingles as n", "_sig"), "classes")
    members = classes.selectExpr("1L as key", "id as root", "id")
    rows = docs.selectExpr("doc_id as _doc", "xxhash64(text) as _hash", "text")
    links = neardup._block_links(members, classes.select("id", "_sig"), classes, rows).collect()
    known = {r.id: r.doc_id for r in classes.select("id", "doc_id").collect()}
    shingles = sets_of(texts)
    assert 0 < len(links) < len(texts)
    for r in links:
        x, y = shingles[known[r.a]], shingles[known[r.b]]
        assert 100 * len(x & y) >= 75 * len(x | y)


def test_very_long_pages_take_little_memory():
    r = random.Random(2)
    own = [f"line {r.randrange(9000)}" for _ in range(20_000)]
    other = [x if r.random() < 0.7 else "other" for x in own]
    tracemalloc.start()
    keep = pages.unshared(own, other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20  # a bit set for every line would be 50 MB
    rest = iter(other)
    assert all(x in rest for x, k in zip(own, keep) if not k)
    assert keep.count(False) >= sum(a == b for a, b in zip(own, other))


def test_an_encoder_that_forgets_gives_the_same_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    r = random.Random(1)
    whole, small = Tokenizer.from_file(packing.default_tokenizer()), packing.WordEncoder(packing.default_tokenizer())
    for _ in range(12):
        texts = [" ".join(r.choice(["Word", "naïve", "0", "x0y", "the", f"r{r.randrange(400)}", "…"]) for _ in range(r.randint(0, 60))) for _ in range(5)]
        ids, counts = small.ids(pa.array(texts))
        assert [list(p) for p in np.split(ids, np.cumsum(counts)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(small.known) <= 50 + 410


def test_batches_are_joined_by_bytes():
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * 100] * n, pa.string())], names=["t"]) for n in (1, 2, 30, 0, 4)]
    joined = list(packing.joined(iter(batches), 1500))
    assert [b.num_rows for b in joined] == [33, 4] and list(packing.joined(iter([]), 10)) == []
