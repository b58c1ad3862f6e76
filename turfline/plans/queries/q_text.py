"""Catalog entries: documents, chunks, HTML, intent, names, entity matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline import constants as K
from turfline.operators import text as TX
from turfline.operators import windows as WN
from turfline.plans.catalog import register
from turfline.sources import fixtures as FX
from turfline.sources.tables import read_table

NEWS_RE = "|".join(K.NEWS_INTENT_KEYWORDS)
STATS_RE = "|".join(K.STATS_INTENT_KEYWORDS)
STOP_LIST = ", ".join(f"'{w}'" for w in K.NAME_STOPWORDS)

CARD_SQL = """
SELECT id, 'player' AS type, web_name AS name,
  'Player: ' || web_name || chr(10) || 'Total Points: ' || CAST(total_points AS VARCHAR) || chr(10) ||
  'Cost: £' || printf('%.1f', now_cost / 10.0E0) || 'm' || chr(10) ||
  'Goals: ' || CAST(goals_scored AS VARCHAR) || chr(10) || 'Assists: ' || CAST(assists AS VARCHAR) || chr(10) ||
  'Clean Sheets: ' || CAST(clean_sheets AS VARCHAR) || chr(10) || 'xG: N/A' || chr(10) || 'xA: N/A' || chr(10) ||
  'Yellow Cards: N/A' || chr(10) || 'Red Cards: N/A' || chr(10) || 'Saves: N/A' || chr(10) || 'BPS: N/A' || chr(10) ||
  'Transfers In (GW): N/A' || chr(10) || 'Transfers Out (GW): N/A' || chr(10) ||
  'Form: ' || COALESCE(CAST(form AS VARCHAR), 'nan') || chr(10) ||
  'News: ' || COALESCE(NULLIF(news, ''), 'No news') AS page_content
FROM fx_players"""

NEWS_TEXT_SQL = """
SELECT id AS article_id, source,
  'Source: ' || COALESCE(source, 'None') || chr(10) || 'Title: ' || COALESCE(title, 'None') || chr(10) ||
  'Content: ' || COALESCE(body, 'None') AS full_text
FROM fx_news"""


@register("render_player_card", oracle=CARD_SQL, fx=["fx_players"])
def q_render_player_card(spark, sf):
    return TX.render_player_card(FX.fx_players(spark, sf))


@register("render_news_text", oracle=NEWS_TEXT_SQL, fx=["fx_news"])
def q_render_news_text(spark, sf):
    return TX.render_news_text(FX.fx_news(spark, sf))


@register("chunk_fixed", oracle=f"""
SELECT article_id, CAST(k AS INTEGER) AS chunk_no, substr(full_text, k * {K.CHUNK_SIZE - K.CHUNK_OVERLAP} + 1, {K.CHUNK_SIZE}) AS chunk
FROM ({NEWS_TEXT_SQL}) t,
     LATERAL (SELECT unnest(generate_series(0, GREATEST(0, CAST(ceil((length(full_text) - {K.CHUNK_SIZE}) / {float(K.CHUNK_SIZE - K.CHUNK_OVERLAP)}) AS BIGINT)))) AS k) s
WHERE length(full_text) > 0""", fx=["fx_news"])
def q_chunk_fixed(spark, sf):
    docs = TX.render_news_text(FX.fx_news(spark, sf))
    return TX.chunk_fixed(docs, "full_text").select("article_id", "chunk_no", "chunk")


@register("chunk_recursive")
def q_chunk_recursive(spark, sf):
    docs = TX.render_news_text(FX.fx_news(spark, sf))
    return TX.chunk_recursive(docs, ["article_id"], "full_text")


STRIP_SQL = """
SELECT page_id, regexp_replace(
  replace(replace(replace(replace(replace(replace(
    regexp_replace(html, '(<[^>]*>)+', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '^\\s+|\\s+$', '', 'g') AS text
FROM pages"""


@register("strip_html", oracle=STRIP_SQL)
def q_strip_html(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", TX.strip_html_regex("html").alias("text"))


@register("strip_html_exact")
def q_strip_html_exact(spark, sf):
    pages = read_table(spark, sf, "pages")
    return pages.select("page_id", TX.strip_html_exact("html").alias("text"))


@register("classify_intent", oracle=f"""
SELECT query_id, CASE WHEN r AND NOT m THEN 'rag' WHEN m AND NOT r THEN 'ml' ELSE 'both' END AS intent
FROM (SELECT query_id, COALESCE(regexp_matches(lower(query), '{NEWS_RE}'), false) AS r,
             COALESCE(regexp_matches(lower(query), '{STATS_RE}'), false) AS m FROM fx_queries) t""",
          fx=["fx_queries"])
def q_classify_intent(spark, sf):
    q = FX.fx_queries(spark, sf)
    return q.select("query_id", TX.classify_intent("query").alias("intent"))


@register("detect_proper_noun", oracle=f"""
SELECT query_id, list_filter(regexp_extract_all(query, '[A-Z][a-z]+'), lambda w: NOT list_contains([{STOP_LIST}], lower(w)))[1] AS name
FROM fx_queries""", fx=["fx_queries"])
def q_detect_proper_noun(spark, sf):
    q = FX.fx_queries(spark, sf)
    return q.select("query_id", TX.detect_proper_noun("query").alias("name"))


def match_sql(order: str) -> str:
    return f"""
SELECT q.query_id,
       (SELECT n.web_name FROM fx_names n WHERE contains(lower(q.query), lower(n.web_name))
        ORDER BY length(n.web_name) DESC, {order} LIMIT 1) AS matched
FROM fx_queries q"""


@register("match_entity_longest", oracle=match_sql("n.id"), fx=["fx_queries", "fx_names"])
def q_match_entity_longest(spark, sf):
    return TX.match_entity_longest(FX.fx_queries(spark, sf), FX.fx_names(spark, sf), order_col="id")


@register("match_entity_longest_join", oracle=match_sql("n.web_name"), fx=["fx_queries", "fx_names"])
def q_match_entity_longest_join(spark, sf):
    # The same operator for a dictionary without an order: ties go to the smallest name.
    return TX.match_entity_longest(FX.fx_queries(spark, sf), FX.fx_names(spark, sf))


@register("entity_note_articles", oracle=f"""
SELECT id, '{K.NEWS_SOURCE_OFFICIAL}' AS source, COALESCE(web_name, CAST(id AS VARCHAR)) || '{K.NOTE_TITLE_SUFFIX}' AS title,
       '{K.NOTE_URL_PREFIX}' || CAST(id AS VARCHAR) AS url, regexp_replace(news, '^\\s+|\\s+$', '', 'g') AS body
FROM fx_players WHERE regexp_replace(news, '^\\s+|\\s+$', '', 'g') <> ''""", fx=["fx_players"])
def q_entity_note_articles(spark, sf):
    return TX.entity_note_articles(FX.fx_players(spark, sf))


@register("union_docs", oracle=f"""
SELECT 'news' AS type, article_id, source, CAST(NULL AS VARCHAR) AS name, CAST(k AS INTEGER) AS chunk_no,
       substr(full_text, k * {K.CHUNK_SIZE - K.CHUNK_OVERLAP} + 1, {K.CHUNK_SIZE}) AS page_content
FROM ({NEWS_TEXT_SQL}) t,
     LATERAL (SELECT unnest(generate_series(0, GREATEST(0, CAST(ceil((length(full_text) - {K.CHUNK_SIZE}) / {float(K.CHUNK_SIZE - K.CHUNK_OVERLAP)}) AS BIGINT)))) AS k) s
WHERE length(full_text) > 0
UNION ALL
SELECT 'player', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), name, 0, page_content FROM ({CARD_SQL}) c""",
          fx=["fx_news", "fx_players"])
def q_union_docs(spark, sf):
    return TX.build_documents(FX.fx_news(spark, sf), FX.fx_players(spark, sf), chunker="fixed")


@register("dedupe_by_content", oracle="""
SELECT source, arg_min(id, id) AS id FROM fx_news GROUP BY source, body""", fx=["fx_news"])
def q_dedupe_by_content(spark, sf):
    news = FX.fx_news(spark, sf)
    return TX.dedupe_by_content(news, ["source"], "body", "id").select("source", "id")


@register("last_n_turns", oracle=f"""
SELECT query_id, CAST(COALESCE(len(h), 0) AS INTEGER) AS n_history,
       COALESCE(array_to_string(h, chr(10)), '') AS history_text
FROM (SELECT query_id,
             list(CASE WHEN role = 'user' THEN 'human' ELSE 'assistant' END || ': ' || query)
               OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {K.HISTORY_TURNS} PRECEDING AND 1 PRECEDING) AS h
      FROM fx_queries) t""", fx=["fx_queries"])
def q_last_n_turns(spark, sf):
    q = FX.fx_queries(spark, sf)
    h = WN.last_n_turns(q, K.HISTORY_TURNS)
    return h.select("query_id", F.size("history").cast("int").alias("n_history"),
                    F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"])),
                                 "\n").alias("history_text"))
