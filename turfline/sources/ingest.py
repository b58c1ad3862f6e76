"""Ingest: nested JSON payloads and XML feeds -> typed rows.

All parsing is built-in (``from_json`` / ``from_xml`` + ``inline``): narrow
per-record work, no shuffle. Numeric fields are declared as STRING and cast
leniently, so a value that does not parse becomes NULL instead of failing the
batch; a document that does not parse at all goes to a reject table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.columns import blank_to_null, lenient_cast
from turfline.operators.text import strip_html_regex

HISTORY_FIELDS = ["round", "seq", "total_points", "goals_scored", "assists", "clean_sheets", "minutes",
                  "bonus", "bps", "expected_goals", "expected_assists", "saves", "yellow_cards", "red_cards"]
HISTORY_SCHEMA = ("struct<player_id: string, history: array<struct<"
                  + ", ".join(f"{f}: string" for f in HISTORY_FIELDS) + ">>>")

ELEMENT_FIELDS = ["id", "web_name", "team", "element_type", "total_points", "now_cost", "selected_by_percent",
                  "selected_by_pct", "minutes", "goals_scored", "assists", "clean_sheets", "bonus", "form",
                  "ict_index", "chance_of_playing_next_round", "chance_of_playing_this_round", "news",
                  "expected_goals", "expected_assists", "yellow_cards", "red_cards", "saves", "bps",
                  "transfers_in_event", "transfers_out_event", "value_season"]
SNAPSHOT_SCHEMA = ("struct<teams: array<struct<id: string, name: string, short_name: string, strength: string>>, "
                   "elements: array<struct<" + ", ".join(f"{f}: string" for f in ELEMENT_FIELDS) + ">>>")

FIXTURE_SCHEMA = ("array<struct<id: string, event: string, kickoff_time: string, team_h: string, team_a: string, "
                  "team_h_score: string, team_a_score: string, finished: boolean, "
                  "team_h_difficulty: string, team_a_difficulty: string>>")


def read_documents(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole)


def parse_with_rejects(docs: DataFrame, schema: str, required: str) -> tuple[DataFrame, DataFrame]:
    """Parse each document; (parsed, rejects). A document is rejected when it
    does not parse or lacks the ``required`` field; the others continue."""
    parsed = docs.select(F.col("value"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("doc"))
    ok = F.col("doc").isNotNull() & F.col(f"doc.{required}").isNotNull()
    return parsed.where(ok).select("doc"), parsed.where(~ok).select(F.col("value").alias("raw"))


def ingest_history(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One payload per player -> one row per history element, carrying player_id."""
    good, bad = parse_with_rejects(docs, HISTORY_SCHEMA, "history")
    rows = good.select(F.col("doc.player_id").alias("pid"), F.inline("doc.history"))
    out = rows.select(
        lenient_cast("pid", "bigint").alias("player_id"),
        *[lenient_cast(f, "bigint").alias(f) for f in ["round", "seq", "total_points", "goals_scored", "assists",
                                                       "clean_sheets", "minutes", "bonus", "bps", "saves",
                                                       "yellow_cards", "red_cards"]],
        lenient_cast("expected_goals", "double").alias("xg_scored"),
        lenient_cast("expected_assists", "double").alias("xa"))
    return out, bad


def ingest_snapshot(docs: DataFrame, fetched_at: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshot documents -> (teams, players, rejects), renamed and leniently cast.
    ``selected_by_pct`` falls back to the alternate key only when the first is
    absent; a missing note becomes ''."""
    good, bad = parse_with_rejects(docs, SNAPSHOT_SCHEMA, "elements")
    teams = good.select(F.inline("doc.teams")).select(
        lenient_cast("id", "bigint").alias("id"), "name", "short_name",
        lenient_cast("strength", "bigint").alias("strength"))
    e = good.select(F.inline("doc.elements"))
    ints = ["total_points", "now_cost", "minutes", "goals_scored", "assists", "clean_sheets", "bonus",
            "chance_of_playing_next_round", "chance_of_playing_this_round", "yellow_cards", "red_cards", "saves",
            "bps", "transfers_in_event", "transfers_out_event"]
    players = e.select(
        lenient_cast("id", "bigint").alias("id"), "web_name",
        lenient_cast("team", "bigint").alias("team_id"),
        lenient_cast("element_type", "bigint").alias("position"),
        *[lenient_cast(c, "bigint").alias(c) for c in ints],
        lenient_cast(F.coalesce("selected_by_percent", "selected_by_pct"), "double").alias("selected_by_pct"),
        lenient_cast("form", "double").alias("form"),
        lenient_cast("ict_index", "double").alias("ict_index"),
        lenient_cast("expected_goals", "double").alias("xg_scored"),
        lenient_cast("expected_assists", "double").alias("xa"),
        lenient_cast("value_season", "double").alias("value_season"),
        F.coalesce(F.nullif(F.col("news"), F.lit("")), F.lit("")).alias("news"))
    if fetched_at is not None:
        teams = teams.withColumn("fetched_at", F.lit(fetched_at))
        players = players.withColumn("fetched_at", F.lit(fetched_at))
    return teams, players, bad


def ingest_fixtures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixture documents -> (rows, rejects); ``event`` -> gameweek; finished -> 0/1 with null as 0.
    A document is rejected when it does not parse, or none of its objects has an id."""
    parsed = docs.select("value", F.from_json("value", FIXTURE_SCHEMA).alias("a"))
    ok = F.col("a").isNotNull() & ((F.size("a") == 0) | F.exists("a", lambda x: x["id"].isNotNull()))
    ok = F.coalesce(ok, F.lit(False))
    bad = parsed.where(~ok).select(F.col("value").alias("raw"))
    f = parsed.where(ok).select(F.inline("a"))
    rows = f.select(
        lenient_cast("id", "bigint").alias("id"), lenient_cast("event", "bigint").alias("gameweek"),
        F.to_timestamp("kickoff_time").alias("kickoff_time"),
        *[lenient_cast(c, "bigint").alias(c) for c in ["team_h", "team_a", "team_h_score", "team_a_score"]],
        F.coalesce(F.col("finished"), F.lit(False)).cast("int").alias("finished"),
        *[lenient_cast(c, "bigint").alias(c) for c in ["team_h_difficulty", "team_a_difficulty"]])
    return rows, bad


FEED_SCHEMA = ("channel struct<item: array<struct<title: string, link: string, guid: string, "
               "description: string, summary: string, content: string>>>, "
               "entry array<struct<title: string, link: struct<_href: string>, id: string, "
               "summary: string, content: string, description: string>>")


def parse_feed_items(feeds: DataFrame, source_col: str = "source") -> DataFrame:
    """Feed XML -> (source, title, url, body). RSS ``item`` and Atom ``entry`` are
    both read, by one parse. url = link (Atom: the href), else guid, else Atom id; body = the
    first non-empty of description, summary, content with tags stripped; only
    items with a title and a url are kept."""
    parsed = feeds.select(source_col, F.from_xml("value", FEED_SCHEMA).alias("_doc"))

    def item(x: F.Column, link: F.Column, other: F.Column) -> F.Column:
        return F.struct(x["title"].alias("title"), F.coalesce(blank_to_null(link), blank_to_null(other)).alias("url"),
                        *[x[c].alias(c) for c in ("description", "summary", "content")])

    none = F.array().cast("array<struct<title: string, url: string, description: string, summary: string, content: string>>")
    rss = F.transform(F.col("_doc.channel.item"), lambda x: item(x, x["link"], x["guid"]))
    atom = F.transform(F.col("_doc.entry"), lambda x: item(x, x["link"]["_href"], x["id"]))
    items = parsed.select(source_col, F.inline(F.concat(F.coalesce(rss, none), F.coalesce(atom, none))))
    raw_body = F.coalesce(blank_to_null("description"), blank_to_null("summary"), blank_to_null("content"),
                          F.lit(""))
    out = items.select(source_col, F.trim("title").alias("title"), F.trim("url").alias("url"),
                       strip_html_regex(raw_body).alias("body"))
    return out.where((F.col("title") != "") & F.col("title").isNotNull() & (F.col("url") != "") & F.col("url").isNotNull())


def feed_union(spark: SparkSession, path: str, feeds_dim: DataFrame) -> DataFrame:
    """All feed files in one read, each tagged with its source name through a
    (small, checked) feeds dimension keyed by the feed number."""
    from turfline.plans.guards import small_side

    docs = spark.read.text(path, wholetext=True).select("value", F.col("_b").cast("long").alias("feed_no"))
    tagged = docs.join(small_side(feeds_dim), "feed_no", "inner")
    return parse_feed_items(tagged.select("value", "source"), "source")
