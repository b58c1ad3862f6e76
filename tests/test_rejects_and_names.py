"""Rejects of ingest, duplicate names, exact medians, chunk coverage."""
import random

import numpy as np

from turfline.operators import answer as AN
from turfline.operators import scoring as SC
from turfline.operators import text as TX
from turfline.sources import ingest as IN


def test_broken_documents_are_rejected(spark):
    docs = spark.createDataFrame([('[{"id": "1", "event": "2", "finished": true}]',), ("[]",), ("{broken",), ("not json",)], "value string")
    rows, bad = IN.ingest_fixtures(docs)
    assert [r["id"] for r in rows.collect()] == [1]
    assert sorted(r["raw"] for r in bad.collect()) == ["not json", "{broken"]
    _, players, bad = IN.ingest_snapshot(docs.where("value like '{%'"))
    assert players.count() == 0 and bad.count() == 1


def test_one_answer_for_players_of_one_name(spark):
    scored = spark.createDataFrame([("Ann", 5.0, "Forward", 0, True), ("Ann", 3.0, "Forward", 0, True)],
                                   "web_name string, raw_pred double, position_name string, has_injury_news int, is_available boolean")
    asked = spark.createDataFrame([(1, "start Ann?"), (2, "nobody")], "query_id long, query string")
    got = {r["query_id"]: r["predicted_points"] for r in AN.predict_for_questions(asked, scored).collect()}
    assert got == {1: 3.0, 2: None}


def test_medians_equal_numpy(spark):
    r = random.Random(1)
    rows = [(r.choice([None, 0.0, 1.0, r.gauss(0, 9)]), float(r.randint(0, 3)), None) for _ in range(1001)]
    got = SC.exact_medians(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert got["c"] is None
    for i, c in enumerate("ab"):
        assert got[c] == np.median([x[i] for x in rows if x[i] is not None])


def test_chunks_cover_the_text_in_order():
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice(["ab", "c" * 30, " ", "\n", "\n\n"]) for _ in range(r.randint(0, 200)))
        spans = TX.chunk_offsets(text, 40, 10)
        assert all(0 < hi - lo <= 40 for lo, hi in spans)
        assert all(a[0] < b[0] <= a[1] < b[1] and a[1] - b[0] <= 10 for a, b in zip(spans, spans[1:]))
        assert not spans or (spans[0][0] == 0 and spans[-1][1] == len(text.rstrip()))
