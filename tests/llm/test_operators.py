"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from turfline.llm import fingerprints, hilbert, licenses, mixing, neardup, packing, pages, quality, substrings, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _row int, id int, size int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sample():
    r = random.Random(3)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(120)
    texts = [None, "", " \t\n", "one", "one", "ONE two three", "one two three", prose(9000), base, base]
    for i in range(30):
        near = base.split()
        for _ in range(r.randint(0, 5)):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        texts.append(" ".join(near))
        texts.append(prose(r.randint(1, 90)) + "\n" + (passage if i % 3 == 0 else "") + " " + prose(20))
    texts.append("a b " * 60)
    texts.append("x. Released under the MIT License. " + prose(40))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[8], (None, "one two"), (None, base), (4, "another text with the id of a second row")]
    return [(i, t, "en", None if n % 5 == 0 else f"s{n % 4}", None if t is None else len(t), "clash", 7, 8, 9) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return docs.drop("_text", "_row", "id", "size")


def test_near_duplicates(docs, none):
    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])

    rows = [(r[0], shingles(r[1])) for r in sample()]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    expected = Counter()
    for n, (key, s) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if group[m] == group[n] and rows[m][0] is not None]
        least = min(ids, default=None)
        expected[key, len(s), least, key is None or key == least] += 1
    got = Counter(tuple(r) for r in neardup.near_duplicates(docs).collect())
    assert got == expected
    assert neardup.near_duplicates(none).count() == 0


def test_signature_batches():
    least = neardup.least_matches()
    assert list(least) == sorted(least) and 0 < least[-1] < 0.75 * neardup.HASHES
    same = np.arange(neardup.HASHES, dtype=np.uint32)[None, :]
    assert list(neardup.plausible(same, same)) == [0] and not len(neardup.plausible(same, same + 1))


def test_block_pairs_find_every_plausible_pair(spark):
    """Buckets with several components, over block borders."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 32, (40, neardup.HASHES), dtype=np.uint32)
    sig = base[r.integers(0, 40, 1500)]
    ids = [int(i) for i in range(1500)]
    root = [i - i % 3 for i in ids]
    sigs = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in zip(ids, sig)], "id long, _sig binary")
    members = spark.createDataFrame([(i, 9 if i < 1400 else 11, x) for i, x in zip(ids, root)], "id long, key long, root long")
    got = {tuple(x) for x in neardup._block_pairs(members, sigs).collect()}
    want = {(j, i) for i in ids for j in range(i) if root[i] != root[j] and (i < 1400) == (j < 1400) and (sig[i] == sig[j]).all()}
    assert {(min(p), max(p)) for p in got} == want


def test_substrings(docs, none):
    rows = [(r[0], words(r[1])) for r in sample()]
    count = Counter(tuple(w[i:i + 35]) for _, w in rows for i in range(len(w) - 34))
    expected = Counter()
    for key, w in rows:
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        rest = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected[key, len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substrings.substring_report(docs).collect()) == expected
    assert substrings.substring_report(none).count() == 0
    cut = substrings.remove_substrings(plain(docs))
    assert cut.columns == plain(docs).columns and cut.count() == len(rows)


def test_top_products(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(9)], "x") for i in range(400)]
    rows += [(500, None, "x"), (550, [1.0, None], "x"), (600, [float("nan")] * 9, "x"), (650, [float("inf")] + [0.0] * 8, "x"), (None, [1.0] * 9, "x")]
    rows += [(700 + i, rows[7][1], "x") for i in range(8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    live = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            live[i] = np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)
    want = set()
    for q in live:
        if q % 50 == 0:
            best = sorted((-int(live[q] @ v), i) for i, v in live.items() if i != q)[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(x) for x in topk.top_products(frame).collect()} == want
    assert topk.top_products(frame.limit(0)).count() == 0


def test_products_are_exact_under_tight_bounds():
    r = np.random.default_rng(2)
    v = np.floor(r.normal(0, 40, (300, 16)))
    axes = np.linalg.eigh(v.T @ v)[1][:, ::-1]
    ids, q = np.arange(300), (np.arange(0, 300, 50), v[::50])
    got = topk.best_of_block(q, (ids, v), topk._bounds(q, (ids, v), 5), axes, 5)
    for key, row in zip(*q):
        best = sorted((-int(x @ row), int(i)) for i, x in zip(ids, v) if i != key)[:5]
        assert [(-s, i) for k, i, s in got if k == key] == best


def test_pages(spark):
    article = "<article><h1>T &amp; U</h1><p>One<br>two<p>three </article>"
    shell = "<header>Top</header><nav><p>menu</nav><div class='ad'>Buy</div>{}<aside>Side</aside><footer>End</footer>"
    rows = [(1, "http://a.org/x/1", shell.format(article)), (2, "http://a.org/x/2?q", shell.format(article)),
            (3, "http://b.org/y/1", "<p>Same line</p><p>Own one</p><script>a<b</script>"),
            (4, "http://b.org/y/2", "<p>Same line</p><p>Own &lt;two&gt;</p><form>Search</form>"),
            (5, None, None), (6, "http://c.org/", ""), (7, None, "<p>alone"), (8, "http://d.org/z", "plain &am")]
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    texts = {1: "T & U\n\nOne two\n\nthree", 2: "T & U\n\nOne two\n\nthree", 3: "Own one", 4: "Own <two>", 5: "", 6: "", 7: "alone", 8: "plain &am"}
    assert got == {k: (t, len(t)) for k, t in texts.items()}
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in "xy")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        keep = pages.unshared(a, b)
        rest = iter(b)
        assert keep.count(False) == table[-1][-1] and all(x in rest for x, k in zip(a, keep) if not k)


def test_licenses(docs, none):
    plain_words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    grams = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    want = Counter()
    for r in sample():
        g = grams(plain_words(r[1]))
        for name, text in licenses.TEMPLATES.items():
            s = set(grams(plain_words(text)))
            step = len(s) if len(s) <= 16 else 1 << (len(s) - 1).bit_length()
            best = max((len(s & set(g[i:i + 2 * step])) / len(s) for i in range(0, len(g), step)), default=0)
            if best >= 0.75:
                want[r[0], name, best] += 1
    assert Counter((r.doc_id, r.license, r.containment) for r in licenses.scan_licenses(docs).collect()) == want and want
    assert licenses.scan_licenses(none).count() == 0


def test_license_bands():
    assert (1 - 1 / 12) ** licenses.bands_for(1, 12) <= licenses.MISS * 1.1


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for r in sample():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            piece = np.array(ids[s:s + 2048], dtype="<u4")
            want[r[0], s, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    at = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and set(at) == set(range(len(at)))
    assert packing.pack_documents(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(got, key=str) == sorted(mixing.mix_documents(docs).collect(), key=str)
    assert sum(r.size for r in got) == sum(len(words(r[1])) for r in sample())
    assert mixing.mix_documents(none).count() == 0
    mixed = mixing.mixed_rows(plain(docs))
    taken, rows = sum(r.taken for r in got), mixed.collect()
    assert mixed.columns == plain(docs).columns
    assert taken - len(got) <= sum(len(words(r.text)) for r in rows) <= taken


def test_sainte_lague():
    for votes, seats in (([5.0, 3.0, 1.0], 9), ([1.0, 1.0], 3), ([7.0, 0.0, 2.5], 20)):
        want = [0] * len(votes)
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))
            want[i] += 1
        assert mixing.sainte_lague(votes, seats) == want


def test_hilbert_shards(docs, none):
    got = hilbert.document_shards(docs.drop("size", "_text")).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == len(sample())
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in sample())
    assert hilbert.document_shards(none.drop("size", "_text")).count() == 0


def test_fingerprints(docs, none):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(sample()) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, r)
    ids = sorted({r[0] for r in sample() if r[0] is not None and r[0] != 4 and r[0] != 25}, reverse=True)
    texts = {r[0]: r[1] or "" for r in sample()}
    a, b = next((a, b) for a, b in zip(ids, ids[1:]) if len(texts[a]) > 100)
    edited = texts[a][:len(texts[a]) - len(texts[a]) // 2] + texts[b][:len(texts[a]) // 2]
    assert prints[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprints.fingerprints(none).count() == 0
    assert fingerprints.likeness(fingerprints.fingerprint(b"abc" * 99), fingerprints.fingerprint(b"abc" * 99)) == 1.0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(r[0], n % 2) for n, r in enumerate(sample()) if r[0]] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(sample()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    kept = quality.keep_good(plain(docs), labels)
    assert kept.columns == plain(docs).columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score_documents(none, labels).count() == 0
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1/"
    labels = spark.read.parquet(base + "labels.parquet")
    got = quality.score_documents(spark.read.parquet(base + "documents.parquet"), labels).where("held_out")
    rows = got.join(labels, "doc_id").where("quality is not null").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
