"""The stored document index: documents (news chunks and player cards) with their vectors.

The index is a ``SegmentStore``. A document is known by ``doc_key``, a SHA-256 over its identity and
its content, so what has not changed is recognised without its text or vector and is not embedded
again. A rebuild writes one segment of rows. An update writes a segment of the rows that are new
and a segment of the keys that are gone; both appear with one manifest. Small segments are merged
level by level without being embedded anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.operators import text as TX
from turfline.operators import upsert as UP
from turfline.operators import vectors as VX
from turfline.sources.segments import Manifest, Segment, SegmentStore

ROWS, REMOVED = "rows", "removed"
#: Segments of one level that are merged into one of the next.
FANOUT = 8
#: Share of removed rows (in per cent of all) from which the whole index is written anew.
REMOVED_PERCENT = 20

INDEX_SCHEMA = T.StructType([
    T.StructField("article_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("chunk_no", T.IntegerType()), T.StructField("page_content", T.StringType()),
    T.StructField("content_hash", T.StringType()), T.StructField("doc_key", T.BinaryType()), T.StructField("doc_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("added", T.LongType()), T.StructField("type", T.StringType())])
REMOVED_SCHEMA = T.StructType([T.StructField("doc_key", T.BinaryType())])


@dataclass
class Update:
    """What an update did: rows that were embedded, rows that were removed, the version it made."""

    embedded: int
    removed: int
    version: int


def keyed_documents(docs: DataFrame) -> DataFrame:
    """Documents with content_hash, doc_key and doc_id."""
    docs = docs.withColumn("content_hash", F.sha2(F.coalesce("page_content", F.lit("")), 256))
    identity = F.to_json(F.struct("type", "article_id", "source", "name", "chunk_no", "content_hash"))
    return docs.withColumns({"doc_key": F.unhex(F.sha2(identity, 256)),
                             "doc_id": F.xxhash64("type", "article_id", "name", "chunk_no", "page_content")})


def card_documents(players: DataFrame) -> DataFrame:
    """Keyed player cards, equal ones once (news rows have ids of their own)."""
    return keyed_documents(TX.player_documents(players)).dropDuplicates(["doc_key"])


def embedded_documents(docs: DataFrame, version: int) -> DataFrame:
    """Documents with their vectors, marked as added by ``version``."""
    return VX.embed_text(docs, "page_content").withColumn("added", F.lit(version).cast("long")).select(*INDEX_SCHEMA.fieldNames())


def rebuild(store: SegmentStore, news: DataFrame, players: DataFrame, chunker: str = "recursive") -> Update:
    """All documents embedded into one segment, which alone makes the next version. With no news the
    news mark stays as it was (or absent). Without any document the index is empty."""
    old = store.manifest()
    version = old.version + 1
    docs = keyed_documents(TX.news_documents(news, chunker)).unionByName(card_documents(players))
    rows = store.write(embedded_documents(docs, version), ROWS, version, level=1, partition_by=["type"])
    new = store.commit(old, [rows], {**_state(old.state, news), "players_embedded": "1"})
    return Update(rows.rows, sum(s.rows for s in old.of(ROWS)), new.version)


def update(store: SegmentStore, news: DataFrame, players: DataFrame, chunker: str = "recursive") -> Update:
    """News above the mark is added; every stored card whose name occurs among ``players`` gives way to the
    new cards of that name. Only documents whose key is not stored are embedded.

    Of the stored index only names and keys of cards are read (news above the mark cannot be stored
    yet). A player without a name has a card that no later update replaces by name.
    """
    old = store.manifest()
    version = old.version + 1
    new_news = UP.incremental_since_watermark(news, int(old.state.get("last_news_id", "0")))
    cards = card_documents(players)
    stored = _live(store, old, F.col("type") == "player").select("doc_key", "name")
    changed = cards.join(stored.select("doc_key"), "doc_key", "left_anti")
    added = changed.unionByName(keyed_documents(TX.news_documents(new_news, chunker)))
    rows = store.write(embedded_documents(added, version), ROWS, version, partition_by=["type"])
    names = cards.select("name").where(F.col("name").isNotNull()).distinct()
    gone = stored.join(names, "name", "left_semi").join(cards.select("doc_key"), "doc_key", "left_anti")
    removed = store.write(gone.select("doc_key"), REMOVED, version)
    segments = old.segments + [s for s in (rows, removed) if s.rows]
    new = store.commit(old, segments, {**_state(old.state, new_news), "players_embedded": "1"})
    compact(store)
    return Update(rows.rows, removed.rows, new.version)


def add_news(store: SegmentStore, news: DataFrame, chunker: str = "recursive", epoch: int | None = None) -> Update:
    """Embeds the documents of newly inserted articles. A batch whose number is committed is not added again, and
    one without articles makes no version."""
    old = store.manifest()
    if epoch is not None and epoch <= int(old.state.get("epoch", "-1")):
        return Update(0, 0, old.version)
    version = old.version + 1
    rows = store.write(embedded_documents(keyed_documents(TX.news_documents(news, chunker)), version), ROWS, version, partition_by=["type"])
    if not rows.rows:
        return Update(0, 0, old.version)
    state = _state(old.state, news) if epoch is None else {**_state(old.state, news), "epoch": str(epoch)}
    new = store.commit(old, old.segments + [rows], state)
    compact(store)
    return Update(rows.rows, 0, new.version)


def _state(state: dict[str, str], news: DataFrame) -> dict[str, str]:
    mark = news.agg(F.max("id").cast("string").alias("id")).first()["id"]
    return {**state, **({} if mark is None else {"last_news_id": mark})}


def _live(store: SegmentStore, manifest: Manifest, where=None, segments: list[Segment] | None = None) -> DataFrame:
    """The rows that count. A row whose key a later version removed is left out; only cards are ever
    removed, so news passes by the join."""
    rows = store.read(manifest.of(ROWS) if segments is None else segments, INDEX_SCHEMA, where=where)
    if not manifest.of(REMOVED):
        return rows
    removed = store.read(manifest.of(REMOVED), REMOVED_SCHEMA, "gone").groupBy("doc_key").agg(F.max("gone").alias("gone"))
    cards, rest = rows.where("type = 'player'"), rows.where("type <> 'player'")
    kept = cards.join(removed, "doc_key", "left").where(F.col("gone").isNull() | (F.col("gone") <= F.col("added"))).drop("gone")
    return kept.select(*rows.columns).unionByName(rest)


def read_index(store: SegmentStore, version: int | None = None) -> DataFrame:
    """The documents of a version (default: the newest) with their vectors; ``added`` is the version that embedded them."""
    return _live(store, store.manifest(version))


def compact(store: SegmentStore) -> None:
    """Merges the segments of a level once there are ``FANOUT`` of them; writes the whole index anew, without
    removed rows, once these are ``REMOVED_PERCENT`` of all. Vectors are copied, never computed."""
    while True:
        old = store.manifest()
        rows, removed = old.of(ROWS), old.of(REMOVED)
        all_rows, gone = sum(s.rows for s in rows), sum(s.rows for s in removed)
        full = [s.level for s in rows if len(old.of(ROWS, s.level)) >= FANOUT]
        if gone * 100 > all_rows * REMOVED_PERCENT:
            merged, rest = rows, []
        elif full:
            # removed keys stay: segments of other levels may still hold them
            merged = old.of(ROWS, min(full))
            rest = [s for s in old.segments if s not in merged]
        else:
            return
        merged_rows = _live(store, old, segments=merged)
        first, last = min(s.first for s in merged), max(s.last for s in merged)
        one = store.write(merged_rows, ROWS, last, max(s.level for s in merged) + 1, first, ["type"])
        store.commit(old, rest + ([one] if one.rows else []), old.state)
