"""Dictionary names in texts against a plain search."""
import random

import pytest
from pyspark.sql import functions as F

from turfline.operators import names as NM
from turfline.operators import text as TX
from turfline.operators.serve import search_entities, search_texts

ALPHABET = "ab .éÉßİ𝒳"


def random_case(seed, n_texts=80, n_names=120, longest=40):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(ALPHABET) for _ in range(r.randint(1, n)))
    texts = [(i, word(200)) for i in range(n_texts)] + [(900, None), (901, ""), (902, "A" * 5000)]
    names = [(word(longest), r.randint(0, 30)) for _ in range(n_names)]
    names += [(t[1][3:3 + r.randint(1, 70)], 5) for t in texts[:30] if t[1] and len(t[1]) > 80]
    return texts, names + [(None, 1), ("", 2), ("a", 3), ("a" * 4097, 4)]


def java_lower(spark, strings):
    frame = spark.createDataFrame([(s,) for s in strings], "s string")
    return {r["s"]: r["l"] for r in frame.select("s", F.lower("s").alias("l")).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_longest_name_equals_plain_search(spark, seed):
    texts, names = random_case(seed)
    low = java_lower(spark, {s for s in [t for _, t in texts] + [n for n, _ in names] if s is not None})
    want = {}
    for i, t in texts:
        hits = [(-len(n), o, n) for n, o in names if n and t is not None and low[n] in low[t]]
        want[i] = min(hits)[2] if hits else None
    q = spark.createDataFrame(texts, "query_id long, query string")
    n = spark.createDataFrame(names, "web_name string, o long")
    best = TX.match_entity_longest(q, n, order_col="o").collect()
    assert {r["query_id"]: r["matched"] for r in best} == want


def test_a_full_filter_costs_no_correctness(spark):
    """With a filter of 64 bits nearly every place is a candidate; the join verifies."""
    texts, names = random_case(9, 10, 400, 12)
    texts, names = texts[:-1], [(n, o) for n, o in names[:-1] if n]
    q = spark.createDataFrame(texts, "query_id long, query string")
    n = spark.createDataFrame(names, "web_name string, o long")
    low = java_lower(spark, {s for s in [t for _, t in texts] + [m for m, _ in names] if s is not None})
    found = {(r["query_id"], r["web_name"]) for r in NM.occurrences(
        q, n.select("web_name").distinct(), "query", "web_name", "query_id", filter_bits=64).collect()}
    assert found == {(i, m) for i, t in texts for m in {m for m, _ in names} if m and t is not None and low[m] in low[t]}


def test_windows_over_block_borders(spark):
    text = "x" * (NM.BLOCK - 7) + "needle in two blocks" + "y" * 100
    q = spark.createDataFrame([(1, text), (2, "needle in two block")], "query_id long, query string")
    n = spark.createDataFrame([("Needle in Two Blocks",), ("needle",)], "web_name string")
    got = {(r["query_id"], r["matched"]) for r in TX.match_entity_longest(q, n).collect()}
    assert got == {(1, "Needle in Two Blocks"), (2, "needle")}


def test_no_names_and_no_texts(spark):
    q = spark.createDataFrame([(1, "a")], "query_id long, query string")
    n = spark.createDataFrame([("a",)], "web_name string")
    assert [tuple(r) for r in TX.match_entity_longest(q, n.limit(0)).collect()] == [(1, None)]
    assert TX.match_entity_longest(q.limit(0), n).count() == 0


def test_a_hot_name_spreads_over_tasks(spark):
    q = spark.range(4000).select(F.col("id").alias("query_id"), F.lit("all about saka today").alias("query"))
    n = spark.createDataFrame([("Saka",), ("saka today",)], "web_name string")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = NM.occurrences(q, n, "query", "web_name", "query_id")
        tasks = hits.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert hits.count() == 8000 and tasks >= 4


def test_search_texts_equals_contains(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcé %_\\") for _ in range(r.randint(0, n)))
    texts, patterns = {word(12) for _ in range(300)}, {word(5) for _ in range(60)} | {"", "a", "%", "_", "zzz", "\\"}
    t = spark.createDataFrame([(x,) for x in texts] + [(None,)], "text string")
    p = spark.createDataFrame([(x,) for x in patterns] + [(None,)], "pattern string")
    got = {(x["pattern"], x["text"]) for x in search_texts(t, p).collect()}
    assert got == {(a, b) for a in patterns for b in texts if a in b}
    assert search_texts(t.limit(0), p).count() == 0 and search_texts(t, p.limit(0)).count() == 0


def test_search_has_no_nested_loop(spark):
    players = spark.createDataFrame([(1, "Saka", "Arsenal", 1, 2, 3, 5.0)], "id int, web_name string, team_name string, "
                                    "goals_scored int, assists int, total_points int, form double")
    found = search_entities(players, spark.createDataFrame([("sa",), ("",)], "pattern string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["pattern"] for r in found.collect()} == {"sa", ""}
