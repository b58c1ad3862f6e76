"""Conversation repair against exhaustive search and a plain program over strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from turfline.llm import conversations as conv
from turfline.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, here string, digest int, kind int, audit string, initial int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        kind = ("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "fine")
        seen.add((role, text))
        out.append(kind)
    return out


def repaired_by(edits, rows):
    """(roles and texts, cost) that a string of edits gives over the rows, None if it does not fit."""
    kinds, out, cost, i = faults(rows), [], 0, 0
    for e in edits:
        fitting = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if e == "I":
            out.append((fitting, ""))
            cost += 2
            continue
        if i == len(rows):
            return None
        _, role, text = rows[i]
        if e != "D":
            if kinds[i] in ("blank", "duplicate"):
                return None
            out.append((role if e == "K" else fitting, text))
            cost += {"K": 0, "R": 2}[e] + (kinds[i] == "truncated")
        else:
            cost += 3
        i += 1
    if i < len(rows) or "" in (r for r, _ in out) or not GRAMMAR.fullmatch("".join(r[0] for r, _ in out)):
        return None
    return out, cost


def exhaustive(rows):
    """The cheapest edits, ASCII-least of them, by trying all strings with up to as many inserts as can pay."""
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            edits = "".join("I" * g + c for g, c in itertools.zip_longest(gaps, letters, fillvalue=""))
            got = repaired_by(edits, rows)
            if got and (best is None or (got[1], edits) < best):
                best = (got[1], edits)
    return best


def by_strings(rows):
    """The same by a program whose cells are whole strings."""
    state_of = {"": 0, "s": 1, "u": 2, "a": 3}
    cells = {0: (0, "")}

    def offer(cells, state, value):
        cells[state] = min(cells.get(state, value), value)

    def inserts(cells):
        for _ in range(3):
            for s, (c, e) in list(cells.items()):
                offer(cells, 3 if s == 2 else 2, (c + 2, e + "I"))

    inserts(cells)
    for (_, role, _), kind in zip(rows, faults(rows)):
        new = {}
        for s, (c, e) in cells.items():
            offer(new, s, (c + 3, e + "D"))
            if kind in ("fine", "truncated"):
                extra = kind == "truncated"
                to = state_of.get(role[:1])
                if role and (s, to) in ((0, 1), (0, 2), (1, 2), (3, 2), (2, 3)):
                    offer(new, to, (c + extra, e + "K"))
                offer(new, 3 if s == 2 else 2, (c + 2 + extra, e + "R"))
        cells = new
        inserts(cells)
    return min(cells[s] for s in (0, 3) if s in cells)


def random_rows(r, n, roles=("user", "assistant", "system", "tool", " ", "")):
    texts = ["Hi.", "Yes!", "no end", " \t", "", "Why? \n", "."] + [f"t{i}." for i in range(40)]
    return sorted(((r.choice([None, 1, 2, 3, 5, 9, 9]), r.choice(roles), r.choice(texts)) for _ in range(n)),
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))


def program(rows):
    kinds = {"fine": conv.FINE, "truncated": conv.TRUNCATED, "duplicate": conv.DUPLICATE, "blank": conv.BLANK}
    repair = conv.Repair()
    for (_, role, _), kind in zip(rows, faults(rows)):
        repair.add(role[:1], kinds[kind])
    return repair.result()


def test_program_equals_exhaustive_search():
    r = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(25):
            rows = random_rows(r, n)
            assert program(rows) == exhaustive(rows) == by_strings(rows)


@pytest.mark.parametrize("prime, settle", [((1 << 61) - 1, 4096), ((1 << 61) - 1, 5), (3, 4096), (1, 7)])
def test_program_equals_strings(monkeypatch, prime, settle):
    """Also where hashes collide all the time, and where shared beginnings are written off early."""
    monkeypatch.setattr(conv, "_PRIME", prime)
    monkeypatch.setattr(conv, "SETTLE", settle)
    r = random.Random(2)
    for _ in range(120):
        roles = r.choice([("user", "assistant"), ("user",), ("assistant",), ("system", "user"), ("user", "assistant", "system", "tool", "")])
        rows = random_rows(r, r.randint(1, 60), roles)
        assert program(rows) == by_strings(rows)


def test_long_conversations():
    rows = [(i, "user", f"text {i}.") for i in range(6000)]
    assert program(rows) == by_strings(rows)
    r = random.Random(4)
    rows = [(i, r.choice(["user", "assistant"]), f"text {i}" + r.choice([".", ""])) for i in range(6000)]
    repair = conv.Repair()
    for (_, role, _), kind in zip(rows, faults(rows)):
        repair.add(role[:1], conv.TRUNCATED if kind == "truncated" else conv.FINE)
    assert repair.settled > 3000  # the beginning was written off
    assert repair.result() == by_strings(rows)


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def report(given):
    out = set()
    for c in {r[0] for r in given}:
        rows = [r[1:] for r in damaged(given) if r[0] == c]
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        kinds, turns = faults(rows), {t for t, _, _ in rows if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit = by_strings(rows)
        left = repaired_by(audit, rows)[0]
        out.add((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                 sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                 hashlib.sha256("\n".join(f"{a}:{b}" for a, b in left).encode()).hexdigest()))
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_repair_conversations(spark, sf).collect()
    assert len(got) == len({r[0] for r in given})
    assert {tuple(r) for r in got} == report(given)


def test_hostile_rows(spark):
    r = random.Random(7)
    given = [(i, *row) for i in range(60) for row in random_rows(r, r.randint(1, 12))]
    given += [(None, *row) for row in random_rows(r, 30)]
    given += [(-3, None, None, None), (-4, 7, "user", "x" * 300_000 + "."), (-4, 8, "assistant", "é" * 100_000), (2**62, 2**62, "user", "a.")]
    given += [(-5, 1, "user", "same.")] * 50 + [(-6, i, "user", "ok.") for i in range(3000)]
    given += [(c, t, "user", "drop") for c in range(100, 130) for t in (0,)]  # some lose their only row
    frame = spark.createDataFrame([(*g, "clash", 1, 2, "clash", 3) for g in given], SCHEMA)
    got = conv.repair_report(conv.damage(frame), conv.F.col("here"))
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {tuple(x) for x in got.select(cols).collect()} == report(given)
    assert got.count() == len({g[0] for g in given})
    assert got.where("n_rows = 0 and audit = '' and cost = 0").count() > 0


def test_repaired_rows_follow_the_grammar(spark):
    r = random.Random(9)
    given = [(i, *row) for i in range(40) for row in random_rows(r, 8)]
    frame = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    audits = conv.audit_conversations(frame)
    rows = conv.repaired_rows(frame, audits).collect()
    for i, group in itertools.groupby(sorted(rows, key=lambda x: (x.conv_id, x.position)), key=lambda x: x.conv_id):
        group = list(group)
        assert [g.position for g in group] == list(range(len(group)))
        assert GRAMMAR.fullmatch("".join(g.role[0] for g in group))
        assert all(g.text == "" for g in group if g.edit == "I")


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert conv.repair_report(frame).count() == 0
    assert conv.repair_report(conv.damage(frame), conv.F.col("here")).count() == 0


def test_one_shuffle_for_the_audit(spark):
    frame = spark.createDataFrame([(1, 1, "user", "a.")], "conv_id long, turn long, role string, text string")
    plan = conv.audit_conversations(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
