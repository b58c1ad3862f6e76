"""Fill-in-middle against a brute-force version, and the piece table by itself."""

import hashlib
import random
import re

import pytest

from turfline.llm import fim

SCHEMA = "doc_id long, text string, form string, h1 int, n int, pieces string, output string, _kept int"


def rows():
    r = random.Random(5)
    letters = "aZ é\n\t.𝒳<PSM>́ab"
    texts = [None, "", "a", "word", "é", "𝒳𝒳", "<P>", "x <M> y", "a<" * 40, "P><S" * 9, "one two " * 700, "w" * 3000 + "é" + "v" * 10]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(120)]
    texts += ["<S ><P" + "ab c" * i for i in range(40)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(3, "word"), (None, "no id but text"), (None, None), (-5, "negative id"), (2**62, "large id")]
    return [(i, t, "clash", 1, 2, "clash", "clash", 3) for i, t in out]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    code = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(code[8 * i:8 * i + 8], 16) for i in range(4)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, sha(text), sha(text)), text, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(units), form, len(p), len(m), sha(out), sha(text)), out, text


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)  # in this process; tasks keep the default
    for r in rows():
        raw = (r[1] or "").encode()
        units = fim.Units(raw)
        found = re.findall(r"[A-Za-z]+|[^A-Za-z]", r[1] or "")
        assert units.n == len(found)
        for k in {0, 1, units.n // 2, units.n - 1, units.n} & set(range(units.n + 1)):
            head = "".join(found[:k])
            assert units.place(k) == (len(head.encode()), len(head))


def test_rows_equal_brute_force(spark):
    arranged = fim.fill_in_middle(spark.createDataFrame(rows(), SCHEMA))
    got = fim.restore(arranged).collect()
    want = [brute(r[0], r[1]) for r in rows()]
    key = lambda x: (x[0][0] is None, x[0][0] or 0, x[0][5])
    mine = [((g.doc_id, g.n, g.form, g.prefix_chars, g.middle_chars, g.output_sha256, g.restored_sha256), g.output, g.restored) for g in got]
    assert sorted(mine, key=key) == sorted(want, key=key)
    assert {g.form for g in got} == {"plain", "psm", "spm"}
    by_text = {(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()): (r[1] or "").encode() for r in rows()}
    for g in got:  # the descriptors alone give the output
        buffers = by_text[g.doc_id, g.restored_sha256], fim.SENTINELS
        assert b"".join(buffers[p.buffer][p.start:p.start + p.length] for p in g.pieces) == g.output.encode()


def test_clashing_and_chosen_columns(spark):
    arranged = fim.fill_in_middle(spark.createDataFrame(rows()[:5], SCHEMA)).selectExpr("*", "1 as restored", "2 as _kept", "3 as _form")
    back = fim.restore(arranged)
    assert back.columns == [*fim.fill_in_middle(spark.createDataFrame(rows()[:1], SCHEMA)).columns, "_kept", "_form", "restored", "restored_sha256"]
    assert back.count() == 5
    assert fim.restore(arranged, ["n"], with_text=False).columns == ["n", "restored_sha256"]


def test_empty_and_very_long(spark):
    assert fim.restore(fim.fill_in_middle(spark.createDataFrame([], SCHEMA))).count() == 0
    text = "ab é " * 1_000_000
    docs = spark.createDataFrame([(i, text) for i in (1, 2)], "doc_id long, text string")
    got = fim.restore(fim.fill_in_middle(docs), ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"], with_text=False)
    assert sorted(tuple(r) for r in got.collect()) == [brute(i, text)[0] for i in (1, 2)]


def test_split_keeps_all_bytes():
    pieces = [(0, 0, 4), (1, 3, 3), (0, 9, 5)]
    for at in range(13):
        left, right = fim.split(pieces, at)
        assert sum(p[2] for p in left) == min(at, 12)
        flat = lambda ps: [(b, s + i) for b, s, n in ps for i in range(n)]
        assert flat(left) + flat(right) == flat(pieces)
