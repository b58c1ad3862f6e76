"""Searches take the rows whose id is divisible by 50 as queries, each against all rows."""
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from turfline import constants as K
from turfline.operators import vectors as VX
from turfline.plans.catalog import load_all
from turfline.plans.queries import q_serve, q_vectors

REG = load_all()


@pytest.fixture()
def folder(tmp_path):
    r = np.random.default_rng(11)
    vecs = r.normal(size=(260, 8)).astype(np.float32)
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": pa.array(range(260), pa.int64()), "embedding": pa.array(vecs.tolist(), pa.list_(pa.float32())),
                             "label": pa.array([i % 4 for i in range(260)], pa.int32())}), tmp_path / "embeddings.parquet")
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"question {c} {t}") for c in (0, 1, 50, 75, 100) for t in range(4)]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*turns))))), tmp_path / "conversations.parquet")
    return str(tmp_path), vecs


def test_searches_take_every_50th_vector_against_all_rows(spark, folder):
    path, vecs = folder
    want = {i for i in range(260) if i % 50 == 0}
    got = REG["mmr_select"].query(spark, path).collect()
    assert {r.query_id for r in got} == want and len(got) == len(want) * K.RETRIEVE_K
    for q in want:
        others = np.array([i for i in range(260) if i != q])
        order = others[np.argsort(-(vecs[others].astype(float) @ vecs[q].astype(float)), kind="stable")][:3 * K.RETRIEVE_K]
        picks = order[VX.mmr_order(vecs[q], vecs[order], K.RETRIEVE_K)]
        assert [r.doc_id for r in sorted(got, key=lambda r: r.mmr_rank) if r.query_id == q] == picks.tolist()
    hybrid = REG["retrieve_hybrid"].query(spark, path)
    assert {r.query_id for r in hybrid.select("query_id").collect()} == want
    assert hybrid.where(F.col("doc_id") % q_vectors.QUERY_EVERY != 0).count() > 0


def test_searched_questions_keep_their_whole_conversation(spark, folder):
    rows = q_serve._searched(spark, folder[0]).collect()
    assert sorted((r.conv_id, r.turn) for r in rows) == [(c, t) for c in (0, 50, 100) for t in range(4)]


def test_candidates_of_a_query_stay_together_in_a_join_that_turns_into_a_broadcast(spark):
    """Planned by sorting, the join of candidates and queries may run as a broadcast join over local reads. (Seen
    apart once, on a larger table; this small one did not show it before the grouped map either.)"""
    r = np.random.default_rng(3)
    vecs = {i: [float(x) for x in r.normal(size=4)] for i in range(400)}
    cands = spark.createDataFrame([(q, q * 10 + k, k + 1, vecs[(q + k) % 400]) for q in range(300) for k in range(10)],
                                  "query_id long, doc_id long, rank int, embedding array<double>").repartition(7, "doc_id")
    queries = spark.createDataFrame([(q, vecs[q]) for q in range(300)], "query_id long, embedding array<double>").repartition(5)
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760"}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = VX.mmr_select(cands, queries, 4).groupBy("query_id").count().collect()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert len(got) == 300 and {r["count"] for r in got} == {4}
