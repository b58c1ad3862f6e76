"""Catalog entries: the stored document index (build, rebuild, incremental update) and embeddings.

The oracles recompute identities, content hashes and vectors. A vector is compared through ``vector``:
the MD5 of its non-zero dimensions with their float32 values in units of 2**-24. The hashed terms
need MurmurHash3, written out in the SQL over the distinct words.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline import constants as K
from turfline.operators import index as IX
from turfline.operators import vectors as VX
from turfline.plans.catalog import register
from turfline.plans.queries.q_text import CARD_SQL, NEWS_TEXT_SQL
from turfline.plans.queries.q_upsert import REFRESHED_CARD_SQL, refreshed_players
from turfline.sources import fixtures as FX
from turfline.sources.segments import SegmentStore
from turfline.sources.tables import read_table
from turfline.streaming.jobs import run_dir

SHIFT = K.CHUNK_SIZE - K.CHUNK_OVERLAP
#: News chunks and cards, as (type, article_id, name, chunk_no, content).
NEWS_DOCS_SQL = f"""
SELECT 'news' AS type, article_id, CAST(NULL AS VARCHAR) AS name, CAST(k AS INTEGER) AS chunk_no,
       substr(full_text, k * {SHIFT} + 1, {K.CHUNK_SIZE}) AS content
FROM ({NEWS_TEXT_SQL}) t,
     LATERAL (SELECT unnest(generate_series(0, GREATEST(0, CAST(ceil((length(full_text) - {K.CHUNK_SIZE}) / {float(SHIFT)}) AS BIGINT)))) AS k) s
WHERE length(full_text) > 0"""


def card_docs(sql: str) -> str:
    return f"SELECT 'player' AS type, CAST(NULL AS BIGINT) AS article_id, name, 0 AS chunk_no, page_content AS content FROM ({sql}) c"


def _rotl(x: str, n: int) -> str:
    return f"((({x}) << {n}) % 4294967296 | (({x}) >> {32 - n}))"


def _times(x: str, y: int) -> str:
    return f"CAST((CAST(({x}) AS HUGEINT) * {y}) % 4294967296 AS BIGINT)"


def murmur_sql(word: str) -> str:
    """MurmurHash3 (32 bits, seed 42) of an ASCII word, as a number from 0 to 2**32 - 1."""
    def block(bytes_: str, at: str, n: int) -> str:
        return " + ".join(f"CAST(coalesce({bytes_}[{at} + {i + 1}], 0) AS BIGINT) * {256 ** i}" for i in range(n))

    def mixed(k: str) -> str:
        return _times(_rotl(_times(k, 3432918353), 15), 461845907)

    codes = f"list_transform(string_split({word}, ''), lambda c: ord(c))"
    body = (f"list_reduce(list_prepend(CAST(42 AS BIGINT), list_transform(range(0, length({word}) // 4), lambda i: {mixed(block(codes, '4 * i', 4))})), "
            f"lambda h, k: ({_rotl('xor(h, k)', 13)} * 5 + 3864292196) % 4294967296)")
    tail = f"CASE WHEN length({word}) % 4 = 0 THEN {body} ELSE xor({body}, {mixed(block(codes, f'(length({word}) // 4) * 4', 3))}) END"
    h = f"xor({tail}, length({word}))"
    h = _times(f"xor({h}, ({h}) >> 16)", 2246822507)
    return h


def vectors_sql(docs: str, key: str) -> str:
    """(key, vector) of all documents of ``docs`` (key, content) that have a word."""
    return f"""
SELECT {key}, md5(string_agg(CAST(dim AS VARCHAR) || ':' || CAST(CAST(floor(CAST(CAST(n / norm AS FLOAT) AS DOUBLE) * 16777216.0E0) AS BIGINT) AS VARCHAR), ',' ORDER BY dim)) AS vector
FROM (SELECT {key}, dim, n, sqrt(CAST(sum(n * n) OVER (PARTITION BY {key}) AS DOUBLE)) AS norm
      FROM (SELECT {key}, dim, CAST(sum(n) AS DOUBLE) AS n
            FROM (SELECT {key}, word, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(content), '[0-9a-z_]+')) AS word FROM ({docs}) d0) d1 GROUP BY ALL) d2
            JOIN (SELECT word, xor(h2, h2 >> 16) % 256 AS dim
                  FROM (SELECT word, {_times("xor(h1, h1 >> 13)", 3266489909)} AS h2
                        FROM (SELECT word, {murmur_sql("word")} AS h1
                              FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(content), '[0-9a-z_]+')) AS word FROM ({docs}) w0) w1) w2) w3) w4 USING (word)
            GROUP BY ALL) d3) d4
GROUP BY {key}"""


def index_sql(docs: str, more: str = "") -> str:
    """The index rows of ``docs`` (type, article_id, name, chunk_no, content, and the columns ``more``)."""
    keyed = f"SELECT *, sha256(content) AS content_hash FROM ({docs}) k0"
    contents = f"SELECT DISTINCT sha256(content) AS content_hash, content FROM ({docs}) c0"
    return f"""
SELECT type, article_id, name, chunk_no, d.content_hash, v.vector{more}
FROM ({keyed}) d LEFT JOIN ({vectors_sql(contents, "content_hash")}) v ON d.content_hash = v.content_hash"""


def vector_digest(c: str = "embedding"):
    """MD5 of the non-zero dimensions and their float32 values in units of 2**-24; null for a zero vector."""
    pairs = F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    parts = F.transform(F.filter(pairs, lambda p: p["x"] != 0), lambda p: F.concat(
        p["i"].cast("string"), F.lit(":"), F.floor(p["x"].cast("double") * 16777216.0).cast("string")))
    return F.when(F.size(parts) > 0, F.md5(F.array_join(parts, ",")))


def _rows(index: DataFrame, *more) -> DataFrame:
    return index.select("type", "article_id", "name", "chunk_no", "content_hash", vector_digest().alias("vector"), *more)


def _store(spark: SparkSession, name: str) -> SegmentStore:
    return SegmentStore(spark, os.path.join(run_dir(spark, name), "index"))


@register("embed_text", oracle=f"""
SELECT doc_id, 256 AS dims, v.vector FROM documents LEFT JOIN
({vectors_sql("SELECT doc_id, coalesce(text, '') AS content FROM documents", "doc_id")}) v USING (doc_id)""")
def q_embed_text(spark, sf):
    e = VX.embed_text(read_table(spark, sf, "documents").select("doc_id", "text"), "text")
    return e.select("doc_id", F.size("embedding").alias("dims"), vector_digest().alias("vector"))


ALL_DOCS_SQL = f"{NEWS_DOCS_SQL} UNION ALL {card_docs(CARD_SQL)}"


@register("vector_index_build", oracle=index_sql(ALL_DOCS_SQL), fx=["fx_news", "fx_players"])
def q_vector_index_build(spark, sf):
    store = _store(spark, "build")
    IX.rebuild(store, FX.fx_news(spark, sf), FX.fx_players(spark, sf), chunker="fixed")
    return _rows(IX.read_index(store))


def updated(spark, sf) -> tuple[SegmentStore, IX.Update]:
    """An index of the news up to a mark and of all cards, and the update that follows: the later news, and new
    cards of the players who played."""
    news = FX.fx_news(spark, sf)
    store = _store(spark, "update")
    mark = news.agg(F.expr("max(id) div 2")).first()[0]
    IX.rebuild(store, news.where(F.col("id") <= mark), FX.fx_players(spark, sf), chunker="fixed")
    return store, IX.update(store, news, refreshed_players(spark, sf), chunker="fixed")


UPDATED_DOCS_SQL = f"""
SELECT *, CASE WHEN article_id > (SELECT max(id) // 2 FROM fx_news) THEN 2 ELSE 1 END AS added FROM ({NEWS_DOCS_SQL}) n
UNION ALL SELECT r.*, CASE WHEN r.content IN (SELECT content FROM ({card_docs(CARD_SQL)}) o WHERE o.name = r.name) THEN 1 ELSE 2 END FROM ({card_docs(REFRESHED_CARD_SQL)}) r
UNION ALL SELECT *, 1 FROM ({card_docs(CARD_SQL)}) c2 WHERE name NOT IN (SELECT name FROM ({REFRESHED_CARD_SQL}) r2)"""


@register("index_update_incremental", oracle=index_sql(UPDATED_DOCS_SQL, ", CAST(added AS BIGINT) AS added"), fx=["fx_news", "fx_players"])
def q_index_update_incremental(spark, sf):
    # ``added`` tells the version that embedded a document: what has not changed keeps its first.
    store, _ = updated(spark, sf)
    return _rows(IX.read_index(store), "added")


@register("index_update_counts", oracle=f"""
SELECT CAST(count(*) FILTER (added = 2) AS BIGINT) AS embedded, CAST(count(*) FILTER (added = 1) AS BIGINT) AS kept,
       CAST((SELECT count(*) FROM ({card_docs(CARD_SQL)}) o JOIN ({REFRESHED_CARD_SQL}) r ON o.name = r.name AND o.content <> r.page_content) AS BIGINT) AS removed
FROM ({UPDATED_DOCS_SQL}) u""", fx=["fx_news", "fx_players"])
def q_index_update_counts(spark, sf):
    store, done = updated(spark, sf)
    index = IX.read_index(store)
    return index.select(F.lit(done.embedded).cast("bigint").alias("embedded"), "added").groupBy("embedded").agg(
        F.count(F.when(F.col("added") < done.version, 1)).alias("kept"), F.lit(done.removed).cast("bigint").alias("removed"))


@register("full_rebuild", oracle=index_sql(f"{NEWS_DOCS_SQL} UNION ALL {card_docs(REFRESHED_CARD_SQL)}"), fx=["fx_news", "fx_players"])
def q_full_rebuild(spark, sf):
    # A rebuild replaces what is stored: cards of players who are gone from the table go with it.
    news, store = FX.fx_news(spark, sf), _store(spark, "rebuild")
    IX.rebuild(store, news.where(F.col("id") % 2 == 0), FX.fx_players(spark, sf), chunker="fixed")
    IX.rebuild(store, news, refreshed_players(spark, sf), chunker="fixed")
    return _rows(IX.read_index(store))
