"""Outputs that must hold the whole job, on small tables with nulls, empty and long texts and repeats."""

import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from turfline.llm import hilbert, mixing, neardup, packing, pages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def test_packed_sequences_hold_the_ids_of_the_texts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    long = " ".join(f"word{i % 37} of É{i}" for i in range(1500))
    rows = [(1, long, "a"), (2, "", "a"), (3, None, "a"), (None, "no id", "a"), (5, "same row", "a"), (5, "same row", "a")]
    pieces = corpus_pipeline.packing_stage(spark, frame(spark, rows), "").collect()
    sequences = defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == len(sequences[r.sequence_id])
        sequences[r.sequence_id] += np.frombuffer(r.ids, dtype="<u4").tolist()
    got = defaultdict(list)
    for r in sorted(pieces, key=lambda r: r.start):
        got[r.doc_id, r.doc_tokens].append(sequences[r.sequence_id][r.offset:r.offset + r.length])
    for key, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        parts = got[key, len(ids)]
        assert parts == [ids] * rows.count((key, text, "a")) if len(ids) <= 2048 else sum(parts, []) == ids
    assert len(got) == 5 and max(map(len, sequences.values())) <= 2048


def test_mix_takes_the_words_of_the_chosen_blocks(spark):
    """A long text taken at half its size: its words come from all over the text, line feeds and
    repeated rows included, just as many as ``taken`` says."""
    long = "\n".join(" ".join(f"w{10 * i + j}" for j in range(10)) for i in range(2000)) + "\n"
    rows = [(1, long, "a"), (2, " ".join(f"b{i}" for i in range(40000)), "b"), (2, " ".join(f"b{i}" for i in range(40000)), "b"), (None, "no id", "b"), (4, None, "a"), (5, " ", "a")]
    docs = frame(spark, rows)
    weights = {"a": 1.0, "b": 9.0}
    mixed = mixing.mixed_rows(docs, lambda sources: weights).collect()
    sized = mixing.mix_documents(docs, lambda sources: weights).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == sum(r.taken for r in sized)
    part = [r for r in mixed if r.doc_id == 1]
    (taken,) = [r.taken for r in sized if r.doc_id == 1]
    assert len(part) == 1 and 0 < taken < 20000 and part[0].n_chars == len(part[0].text)
    places = [int(w[1:]) for w in part[0].text.split()]
    assert places == sorted(set(places)) and len(places) == taken
    gaps = [b - a for a, b in zip(places, places[1:])]
    assert places[-1] > 15000 and max(gaps) < 10000 and len([g for g in gaps if g > 1]) > 5
    assert all((sep == "\n") == (int(w[1:]) % 10 == 9) for w, sep in re.findall(r"(w\d+)(\s)", part[0].text))


def test_one_row_of_each_group_stays_and_keeps_its_text(spark):
    """Repeated rows, copies without an id and an id on two texts."""
    text = lambda c, n=200: " ".join(f"{c}{i}" for i in range(n))
    near = text("n").replace("n100 ", "other ")
    rows = [(7, text("a"), "s"), (7, text("a"), "s"), (7, text("a"), "t"), (None, text("b"), "s"), (None, text("b"), "s"),
            (9, text("c"), "s"), (None, text("c"), "s"), (5, text("n"), "s"), (5, near, "s"), (5, near, "s"), (None, near, "s"),
            (8, text("d"), "s"), (None, text("e"), "s"), (None, None, "s"), (None, "", "s"), (3, "", "s"), (3, "", "s")]
    docs = frame(spark, rows)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns
    empty = sorted(((i, t) for i, t in got if not t), key=str)
    assert empty == sorted([(None, None), (None, ""), (3, ""), (3, "")], key=str)
    full = [(i, t) for i, t in got if t]
    assert sorted((i or 0, t[0]) for i, t in full) == [(0, "b"), (0, "e"), (5, "n"), (7, "a"), (8, "d"), (9, "c")]
    left = corpus_pipeline.substring_stage(spark, kept, "").collect()
    assert sorted(r.text for r in left if r.text) == sorted(t for _, t in full)
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_copied_pages_and_mixed_hosts_keep_their_main_text(spark, monkeypatch):
    monkeypatch.setattr(pages, "RANKS", 2)  # runs of copies over the borders of blocks
    copy, main = "<p>Shared</p><p>Copied text</p>", "<main><p>Main text</p></main>"
    rows = [(i, f"http://a.org/x/{i}", copy) for i in range(1, 6)] + [(5, "http://a.org/x/5", copy), (9, "http://a.org/x/9", "<p>Shared</p><p>Own</p>")]
    rows += [(11, "http://b.org/1", main), (12, "http://b.org/2", main), (13, "http://c.org/1", copy), (14, "http://c.org/2", copy)]
    rows += [(15, "http://d.org/1", "<div>Menu line</div><article><p>Story</p></article>"), (16, "http://d.org/2", "<div>Menu line</div><p>Plain</p>"), (17, None, copy)]
    got = sorted((r.page_id, r.text) for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    both = "Shared\n\nCopied text"
    assert got == sorted([(i, "Copied text") for i in (1, 2, 3, 4, 5, 5)] + [(9, "Own"), (11, "Main text"), (12, "Main text"), (13, both), (14, both),
                                                                             (15, "Story"), (16, "Plain"), (17, both)])


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i, "x" * (i % 50), f"s{i % 4}") for i in range(60)] + [(7, "same", "a")] * 3 + [(None, "no id", "a"), (None, None, None), (7, "other", "b")]
    docs = frame(spark, rows)
    hilbert.write_shards(docs, str(tmp_path / "shards"), shards=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(back.select(docs.columns).collect()) == Counter(docs.collect())
    slots = back.select("shard", "slot").collect()
    assert len(slots) == len(set(slots)) == len(rows) and {r.shard for r in slots} == {0, 1, 2, 3}
