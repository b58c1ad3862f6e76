"""Queries ``opN_<name>`` over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm import conversations, fim, fingerprints, hilbert, licenses, mixing, neardup, packing, pages, quality, substrings, topk, warc
from turfline.llm.store import shared_path
from turfline.sources.tables import read_table as read

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op2_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(read(spark, sf_dir, "pages"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.document_shards(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(read(spark, sf_dir, "documents"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents")).drop("ids")  # their digest stays


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(read(spark, sf_dir, "conversations"))
    return conversations.repair_report(rows, F.col("here")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(read(spark, sf_dir, "documents"))
    return fim.restore(cut, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"], with_text=False)


def op13_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    return warc.page_report(warc.assemble(warc.read_records(spark, path)))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_fingerprints, op2_top_products, op3_quality, op4_main_text, op5_near_duplicates, op6_mix_sources,
    op7_licenses, op8_hilbert_shards, op9_substrings, op10_pack_sequences, op11_repair_conversations,
    op12_fill_in_middle, op13_warc_captures,
)}

ORACLES: dict[str, str] = {
    "op2_top_products": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_repair_conversations": """
        WITH RECURSIVE given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)) AS key
            FROM conversations),
        hashed AS (
            SELECT *, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), key), lambda crc, byte:
                list_reduce(list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, bit: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1))))) % 20 AS fault
            FROM given),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM (SELECT *, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed)),
        placed AS (
            SELECT *, substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
        rows_ AS (
            SELECT *, CASE WHEN trimmed = '' THEN 3 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                           WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS kind,
                   lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
        counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 3) AS blank,
                   count(*) FILTER (kind = 2) AS duplicate, count(*) FILTER (kind = 1) AS truncated,
                   count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
        edits(state, edit, initial, goes, cost, name) AS (VALUES
            (0, 'K', 's', 1, 0, 's'), (0, 'K', 'u', 2, 0, 'u'), (1, 'K', 'u', 2, 0, 'u'), (3, 'K', 'u', 2, 0, 'u'), (2, 'K', 'a', 3, 0, 'a'),
            (0, 'R', NULL, 2, 2, 'u'), (1, 'R', NULL, 2, 2, 'u'), (3, 'R', NULL, 2, 2, 'u'), (2, 'R', NULL, 3, 2, 'a'),
            (0, 'D', NULL, 0, 3, ''), (1, 'D', NULL, 1, 3, ''), (2, 'D', NULL, 2, 3, ''), (3, 'D', NULL, 3, 3, '')),
        inserts(state, edit, goes, cost, name) AS (VALUES
            (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''),
            (0, 'I', 2, 2, 'u'), (1, 'I', 2, 2, 'u'), (3, 'I', 2, 2, 'u'), (2, 'I', 3, 2, 'a'),
            (0, 'II', 3, 4, 'ua'), (1, 'II', 3, 4, 'ua'), (2, 'II', 2, 4, 'au'), (3, 'II', 3, 4, 'ua')),
        cells(conv_id, i, state, best) AS (
            SELECT c.conv_id, CAST(0 AS BIGINT), goes, struct_pack(cost := CAST(cost AS BIGINT), audit := edit, roles := name)
            FROM (SELECT DISTINCT conv_id FROM conversations) c, inserts WHERE state = 0
            UNION ALL
            SELECT conv_id, i, goes, min(best) FROM (
                SELECT c.conv_id, r.i, n.goes, struct_pack(
                           cost := CAST((c.best).cost + e.cost + n.cost + CASE WHEN r.kind = 1 AND e.edit <> 'D' THEN 1 ELSE 0 END AS BIGINT),
                           audit := (c.best).audit || e.edit || n.edit, roles := (c.best).roles || e.name || n.name) AS best
                FROM cells c JOIN rows_ r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = c.i + 1
                JOIN edits e ON e.state = c.state AND (e.initial IS NULL OR e.initial = r.initial) AND (e.edit = 'D' OR r.kind < 2)
                JOIN inserts n ON n.state = e.goes)
            GROUP BY conv_id, i, goes),
        best AS (
            SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
                   coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, min(x.best) AS best
            FROM cells x LEFT JOIN counts c ON x.conv_id IS NOT DISTINCT FROM c.conv_id
            WHERE x.i = coalesce(n, 0) AND x.state IN (0, 3) GROUP BY ALL),
        letters AS (
            SELECT conv_id, (best).roles AS roles, edit, j, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS place
            FROM (SELECT conv_id, best, unnest(string_split((best).audit, '')) AS edit, unnest(range(length((best).audit))) AS j FROM best WHERE (best).audit <> '')
            WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
        repaired AS (
            SELECT l.conv_id, string_agg(CASE WHEN edit = 'K' THEN r.role WHEN substr(roles, CAST(place AS BIGINT), 1) = 'u' THEN 'user' ELSE 'assistant' END
                                         || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY j) AS body
            FROM letters l LEFT JOIN rows_ r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.i WHERE edit <> 'D' GROUP BY l.conv_id)
        SELECT b.conv_id, gaps, blank, duplicate, truncated, illegal, (best).cost AS cost, (best).audit AS audit, sha256(coalesce(body, '')) AS repaired_sha256
        FROM best b LEFT JOIN repaired p ON b.conv_id IS NOT DISTINCT FROM p.conv_id""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS code FROM documents),
        u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
                     list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(code, i, 8) AS BIGINT)) AS h FROM d),
        p AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
                     greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                          WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        s AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
                     array_to_string(units[b + 1:], '') AS suffix FROM p)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(prefix || middle || suffix) AS restored_sha256 FROM s""",
    "op13_warc_captures": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        g AS (SELECT *, sha1(body) AS code, max(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 40, 5), lambda i: array_to_string(list_transform([32768, 1024, 32, 1], lambda d:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(code, i + 1, 5) AS BIGINT) // d) % 32, 1)), '')), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM g""",
}
