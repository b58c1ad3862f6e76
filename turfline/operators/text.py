"""Text operators: documents, chunks, HTML, intent and entity matching.

Built-in string functions are used wherever the semantics allow. Python runs
only in vectorised ``mapInArrow`` / ``pandas_udf`` steps: the recursive
splitter, the exact HTML text extraction and the substring automaton for
entity matching; each processes one Arrow batch at a time on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline import constants as K
from turfline.functions.columns import col_of, keyword_regex
from turfline.operators.names import occurrences
from turfline.plans.guards import spread
from turfline.session import map_arrow

# ---------------------------------------------------------------- document rendering

CARD_INT_FIELDS = [("Yellow Cards", "yellow_cards"), ("Red Cards", "red_cards"), ("Saves", "saves"),
                   ("BPS", "bps"), ("Transfers In (GW)", "transfers_in_event"),
                   ("Transfers Out (GW)", "transfers_out_event")]


def _opt(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def fmt_stat(c: Column, fmt: str = "%.2f") -> Column:
    """Formatted number, or 'N/A' for NULL/NaN."""
    return F.when(c.isNull() | F.isnan(c.cast("double")), F.lit("N/A")).otherwise(
        F.format_string(fmt, c.cast("double")))


def render_player_card(players: DataFrame) -> DataFrame:
    """16-line card per player -> (type, name, page_content). Absent optional
    statistics print 'N/A'; an empty or NULL note prints 'No news'."""
    p = players
    lines = [
        F.concat(F.lit("Player: "), F.col("web_name")),
        F.concat(F.lit("Total Points: "), F.col("total_points").cast("string")),
        F.concat(F.lit("Cost: £"), F.format_string("%.1f", F.col("now_cost") / F.lit(10.0)), F.lit("m")),
        F.concat(F.lit("Goals: "), F.col("goals_scored").cast("string")),
        F.concat(F.lit("Assists: "), F.col("assists").cast("string")),
        F.concat(F.lit("Clean Sheets: "), F.col("clean_sheets").cast("string")),
        F.concat(F.lit("xG: "), fmt_stat(_opt(p, "xg_scored", "double"))),
        F.concat(F.lit("xA: "), fmt_stat(_opt(p, "xa", "double"))),
    ]
    for label, name in CARD_INT_FIELDS:
        lines.append(F.concat(F.lit(f"{label}: "),
                              F.coalesce(_opt(p, name, "bigint").cast("string"), F.lit("N/A"))))
    lines += [
        F.concat(F.lit("Form: "), F.coalesce(F.col("form").cast("string"), F.lit("nan"))),
        F.concat(F.lit("News: "), F.coalesce(F.nullif(F.col("news"), F.lit("")), F.lit("No news"))),
    ]
    keep = [F.col("id")] if "id" in p.columns else []
    return p.select(*keep, F.lit("player").alias("type"), F.col("web_name").alias("name"),
                    F.concat_ws("\n", *lines).alias("page_content"))


def render_news_text(news: DataFrame) -> DataFrame:
    """'Source: ..\\nTitle: ..\\nContent: ..' per article."""
    txt = F.concat(F.lit("Source: "), F.coalesce(F.col("source"), F.lit("None")),
                   F.lit("\nTitle: "), F.coalesce(F.col("title"), F.lit("None")),
                   F.lit("\nContent: "), F.coalesce(F.col("body"), F.lit("None")))
    return news.select(F.col("id").alias("article_id"), "source", txt.alias("full_text"))


# ---------------------------------------------------------------- chunking

def chunk_fixed(df: DataFrame, text_col: str, size: int = K.CHUNK_SIZE,
                overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Overlapping fixed windows: starts 0, size-overlap, ... until the text end
    is covered; empty text yields no chunk. Narrow (explode), no shuffle."""
    step = size - overlap
    n = F.length(text_col)
    last = F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(float(step)))).cast("int")
    out = df.where(n > 0).select("*", F.posexplode(F.sequence(F.lit(0), last)).alias("chunk_no", "_k"))
    return out.withColumn("chunk", F.expr(f"substring({text_col}, _k * {step} + 1, {size})")).drop("_k")


def chunk_offsets(text: str, size: int, overlap: int,
                  separators: Sequence[str] = ("\n\n", "\n", " ")) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``size`` characters, in one forward sweep.

    A chunk ends at the last break of its window, before a separator of the strongest kind found
    there, or at ``size`` characters if there is none. The next chunk starts at the first space
    or line break of the last ``overlap`` characters; where the text was cut inside a word it
    repeats all of them, and without a space nothing. Trailing white space is left out."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n, start, spans = len(text.rstrip()), 0, []
    while n - start > size:
        end = -1
        for sep in separators:
            end = text.rfind(sep, start + overlap + 1, start + size + len(sep))
            if end >= 0:
                break
        cut = end < 0
        if cut:
            end = start + size
        spans.append((start, end))
        carried = [] if cut else [at for at in (text.find(c, end - overlap, end) for c in ("\n", " ")) if at >= 0]
        start = end - overlap if cut else min(carried, default=end)
    if start < n:
        spans.append((start, n))
    return spans


def split_recursive(text: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> list[str]:
    """The trimmed, non-empty chunks at ``chunk_offsets``."""
    chunks = (text[lo:hi].strip() for lo, hi in chunk_offsets(text, size, overlap))
    return [c for c in chunks if c]


#: Characters of text whose chunks leave a task as one batch (a longer text's chunks leave alone).
CHUNKED_CHARS = 1 << 21


def chunk_recursive(df: DataFrame, key_cols: Sequence[str], text_col: str,
                    size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """(keys..., chunk_no, chunk) via ``mapInArrow``: texts are read one by one from a batch, and their chunks
    leave after every ``CHUNKED_CHARS`` characters, so a task's memory grows with neither rows nor lengths."""
    keys = list(key_cols)
    src = spread(df.select(*keys, text_col))
    fields = [f for f in src.schema.fields if f.name in keys]
    schema = T.StructType(fields + [T.StructField("chunk_no", T.IntegerType()),
                                    T.StructField("chunk", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, numbers, chunks, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                kept = [batch.column(i).take(pa.array(owner, pa.int32())) for i in range(len(keys))]
                return pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())],
                                                  names=[*keys, "chunk_no", "chunk"])

            for row, value in enumerate(batch.column(len(keys))):
                text = value.as_py()
                if text is None:
                    continue
                for i, c in enumerate(split_recursive(text, size, overlap)):
                    owner.append(row)
                    numbers.append(i)
                    chunks.append(c)
                held += len(text)
                if held >= CHUNKED_CHARS:
                    yield out()
                    owner, numbers, chunks, held = [], [], [], 0
            if owner:
                yield out()

    return map_arrow(src, run, schema)


# ---------------------------------------------------------------- HTML

# Entities decoded by the regex form (the exact form decodes all of them).
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                 ("&amp;", "&")]


def strip_html_regex(c: str | Column) -> Column:
    """Tags -> one space per run of tags, listed entities decoded, outer whitespace trimmed."""
    x = F.regexp_replace(col_of(c), r"(<[^>]*>)+", " ")
    for ent, ch in HTML_ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return F.regexp_replace(x, r"^\s+|\s+$", "")


class _Text(HTMLParser):
    """Collects the text nodes, without those of scripts and styles if asked."""

    def __init__(self, drop_script: bool):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self._drop = ("script", "style") if drop_script else ()
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        self._skip += tag in self._drop

    def handle_endtag(self, tag):
        if tag in self._drop and self._skip:
            self._skip -= 1

    def handle_data(self, data):
        if not self._skip:
            self.parts.append(data)


def _strip_one(html: str | None, drop_script: bool) -> str | None:
    if html is None:
        return None
    p = _Text(drop_script)
    try:
        p.feed(html)
        p.close()  # flush a trailing text node instead of losing it
    except Exception:  # noqa: BLE001 - unparsable input is returned as is
        return html
    return " ".join(p.parts).strip()


def strip_html_exact(c: str | Column, drop_script: bool = False) -> Column:
    """Text nodes joined by a space, all entities decoded (``pandas_udf``)."""

    @F.pandas_udf(T.StringType())
    def _udf(s: pd.Series) -> pd.Series:
        return s.map(lambda h: _strip_one(h, drop_script))

    return _udf(col_of(c))


# ---------------------------------------------------------------- intent and names

def classify_intent(q: str | Column, news_words=K.NEWS_INTENT_KEYWORDS,
                    stats_words=K.STATS_INTENT_KEYWORDS, whole_word: bool = False) -> Column:
    """Only news words -> 'rag'; only stats words -> 'ml'; both or none -> 'both'."""
    low = F.lower(col_of(q))
    rag = F.coalesce(low.rlike(keyword_regex(news_words, whole_word)), F.lit(False))
    ml = F.coalesce(low.rlike(keyword_regex(stats_words, whole_word)), F.lit(False))
    return F.when(rag & ~ml, F.lit("rag")).when(ml & ~rag, F.lit("ml")).otherwise(F.lit("both"))


def detect_proper_noun(q: str | Column, stopwords=K.NAME_STOPWORDS,
                       pattern: str = K.PROPER_NOUN_PATTERN) -> Column:
    """First capitalised word not in the stop list, else NULL."""
    words = F.regexp_extract_all(col_of(q), F.lit(pattern), 0)
    stop = F.array(*[F.lit(w) for w in stopwords])
    kept = F.filter(words, lambda w: ~F.array_contains(stop, F.lower(w)))
    return F.try_element_at(kept, F.lit(1))


def match_entity_longest(queries: DataFrame, names: DataFrame, query_col: str = "query",
                         name_col: str = "web_name", id_col: str = "query_id", order_col: str | None = None) -> DataFrame:
    """Per query: the longest dictionary name occurring (case-insensitively) as a
    substring. Ties go to the name that comes first by ``order_col`` (the table's order), then, or
    without it, to the smallest name. Queries with no match get NULL.

    One distributed path for dictionaries of every size (``names.occurrences``)."""
    order = F.col(order_col) if order_col else F.lit(0)
    dic = names.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("_name")).agg(F.min(order).alias("_order"))
    hits = occurrences(queries, dic, query_col, "_name", id_col)
    best = hits.groupBy(id_col).agg(F.min_by("_name", F.struct(-F.length("_name"), F.col("_order"), F.col("_name"))).alias("matched"))
    return queries.select(id_col).join(best, id_col, "left")


# ---------------------------------------------------------------- articles and documents

def _trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def entity_note_articles(players: DataFrame) -> DataFrame:
    """Every entity with a non-empty (trimmed) note -> one article with a stable
    synthetic url; the title falls back to the id when the name is missing."""
    body = _trim_ws(F.col("news"))
    name = F.coalesce(F.col("web_name"), F.col("id").cast("string"))
    return players.where(body != "").select(
        "id", F.lit(K.NEWS_SOURCE_OFFICIAL).alias("source"),
        F.concat(name, F.lit(K.NOTE_TITLE_SUFFIX)).alias("title"),
        F.concat(F.lit(K.NOTE_URL_PREFIX), F.col("id").cast("string")).alias("url"),
        body.alias("body"))


DOC_COLS = ["type", "article_id", "source", "name", "chunk_no", "page_content"]


def news_documents(news: DataFrame, chunker: str = "recursive") -> DataFrame:
    """Rendered article text split into chunks, tagged (type=news, article_id, source)."""
    docs = render_news_text(news)
    if chunker == "fixed":
        ch = chunk_fixed(docs, "full_text").select("article_id", "source", "chunk_no",
                                                   F.col("chunk").alias("page_content"))
    else:
        src = docs.select("article_id", "source", "full_text")
        ch = chunk_recursive(src, ["article_id", "source"], "full_text").withColumnRenamed("chunk", "page_content")
    return ch.select(F.lit("news").alias("type"), "article_id", "source",
                     F.lit(None).cast("string").alias("name"), F.col("chunk_no").cast("int"), "page_content")


def player_documents(players: DataFrame) -> DataFrame:
    cards = render_player_card(players)
    return cards.select("type", F.lit(None).cast("bigint").alias("article_id"),
                        F.lit(None).cast("string").alias("source"), "name",
                        F.lit(0).alias("chunk_no"), "page_content")


def build_documents(news: DataFrame, players: DataFrame, chunker: str = "recursive") -> DataFrame:
    """News chunks followed by player cards (bag union, no shuffle)."""
    return news_documents(news, chunker).unionByName(player_documents(players)).select(*DOC_COLS)


def dedupe_by_content(df: DataFrame, group_cols: Sequence[str], content_col: str,
                      priority_col: str) -> DataFrame:
    """Keep the first row (smallest priority) per (group, content): a partial
    ``min_by`` aggregate, so repeated content is collapsed map-side."""
    payload = [c for c in df.columns if c not in (*group_cols, content_col)]
    agg = df.groupBy(*group_cols, content_col).agg(
        F.min_by(F.struct(*payload), F.col(priority_col)).alias("_r"))
    return agg.select(*group_cols, content_col, *[F.col(f"_r.{c}").alias(c) for c in payload])
