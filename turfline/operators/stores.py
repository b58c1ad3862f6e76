"""Keyed tables that grow by batches, as segment stores.

Rows lie in buckets by a hash of their key (a folder each). Small segments are merged level by
level, ``FANOUT`` into one, so that after n batches there are about ``FANOUT * log(n)`` of them. The
last batch number is part of the manifest: a batch that is tried again after its commit does nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.operators.upsert import first_by_key, latest_by_key
from turfline.session import stored
from turfline.sources.segments import Manifest, SegmentStore

ROWS, FILTER = "rows", "filter"
#: Segments of one level that are merged into one of the next.
FANOUT = 8
#: Buckets of keys; bits of a bucket's Bloom filter (a power of two) and bits a key sets in it.
BUCKETS, FILTER_BITS, KEY_BITS = 64, 1 << 20, 4

_FILTER_SCHEMA = T.StructType([T.StructField("word", T.IntegerType()), T.StructField("mask", T.LongType()), T.StructField("bucket", T.IntegerType())])


class _Batched:
    """What both tables share: buckets, batch numbers, merging by level."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS):
        self.store, self.schema, self.keys, self.buckets = SegmentStore(spark, base), schema, list(keys), buckets
        self._stored_schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def done(self, epoch: int | None) -> bool:
        """Whether the batch of this number is committed."""
        return epoch is not None and epoch <= int(self.store.manifest().state.get("epoch", "-1"))

    def _rows(self, manifest: Manifest, level: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        where = None if buckets is None else F.col("bucket").isin(list(buckets))
        return self.store.read(manifest.of(ROWS, level), self._stored_schema, where=where)

    def _state(self, old: Manifest, epoch: int | None) -> dict[str, str]:
        return old.state if epoch is None else {**old.state, "epoch": str(epoch)}

    def _merged(self, rows: DataFrame, kind: str) -> DataFrame:
        return rows

    def _compact(self) -> None:
        kinds = {ROWS: self._stored_schema, FILTER: _FILTER_SCHEMA}
        while True:
            old = self.store.manifest()
            full = [(s.kind, s.level) for s in old.segments if len(old.of(s.kind, s.level)) >= FANOUT]
            if not full:
                return
            kind, level = min(full)
            some = old.of(kind, level)
            rows = self._merged(self.store.read(some, kinds[kind]), kind)
            one = self.store.write(rows, kind, max(s.last for s in some), level + 1, min(s.first for s in some), ["bucket"])
            self.store.commit(old, [s for s in old.segments if s not in some] + [one], old.state)


class UpsertTable(_Batched):
    """Last write wins: one row for each key, that with the greatest ``order_cols`` (a total order).

    A batch is reduced to one row for each key before it is written. Reading takes the latest of
    the rows of all segments; merging does the same for the segments of a level."""

    def __init__(self, spark, base, schema, keys, order_cols: Sequence[str], buckets: int = BUCKETS):
        super().__init__(spark, base, schema, keys, buckets)
        self.order_cols = list(order_cols)

    def upsert(self, batch: DataFrame, epoch: int | None = None) -> None:
        if self.done(epoch):
            return
        old = self.store.manifest()
        rows = latest_by_key(batch.select(*self.schema.fieldNames()), self.keys, self.order_cols).withColumn("bucket", self.bucket())
        new = self.store.write(rows, ROWS, old.version + 1, partition_by=["bucket"])
        self.store.commit(old, old.segments + ([new] if new.rows else []), self._state(old, epoch))
        self._compact()

    def _merged(self, rows: DataFrame, kind: str) -> DataFrame:
        return latest_by_key(rows, self.keys, self.order_cols)

    def read(self) -> DataFrame:
        rows = self._rows(self.store.manifest()).drop("bucket")
        return latest_by_key(rows, self.keys, self.order_cols)


class KeyedTable(_Batched):
    """First arrival wins: a row is inserted if its key is not stored; stored rows never change.

    Each bucket has a Bloom filter, a table of 64-bit words. A batch looks its keys up in the filters of its
    buckets and reads the stored keys of only those buckets where some key may be stored, to decide
    exactly. A null key is never stored already: each batch inserts one such row."""

    def __init__(self, spark, base, schema, key: str, order_col: str, buckets: int = BUCKETS):
        super().__init__(spark, base, schema, [key], buckets)
        self.key, self.order_col = key, order_col

    def _words(self, rows: DataFrame) -> DataFrame:
        """For each row the words and masks of its key's bits."""
        bits = [F.pmod(F.xxhash64(self.key, F.lit(i)), F.lit(FILTER_BITS)).cast("int") for i in range(1, KEY_BITS + 1)]
        bit = F.explode(F.array_distinct(F.array(*bits)))
        some = rows.select(self.key, "bucket", bit.alias("_bit"))
        return some.select(self.key, "bucket", F.shiftright("_bit", 6).alias("word"),
                           F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit").bitwiseAND(63)).alias("mask"))

    def insert(self, batch: DataFrame, epoch: int | None = None) -> tuple[DataFrame, list[int]]:
        """Stores the new rows; returns them and the buckets whose stored keys were read. For a batch that is
        committed already, the rows it inserted."""
        if self.done(epoch):
            return self.inserted(epoch), []
        old = self.store.manifest()
        firsts = first_by_key(batch.select(*self.schema.fieldNames()), [self.key], [self.order_col])
        firsts = stored(firsts.withColumn("bucket", self.bucket()), "batch")
        read: list[int] = []
        new = firsts
        if old.of(ROWS):
            maybe = stored(self._maybe(firsts, old), "maybe")
            read = sorted(r["bucket"] for r in maybe.select("bucket").distinct().collect())  # at most the buckets
            if read:
                present = self._rows(old, buckets=read).select(self.key).join(maybe.select(self.key), self.key, "left_semi")
                new = firsts.join(present.distinct(), self.key, "left_anti").select(*firsts.columns)
        version = old.version + 1
        rows = self.store.write(new, ROWS, version, partition_by=["bucket"])
        added = self.store.read([rows], self._stored_schema)
        words = self._words(added.where(F.col(self.key).isNotNull())).groupBy("bucket", "word").agg(F.bit_or("mask").alias("mask"))
        bloom = self.store.write(words.select("word", "mask", "bucket"), FILTER, version, partition_by=["bucket"])
        segments = old.segments + [s for s in (rows, bloom) if s.rows]
        state = {**self._state(old, epoch), **({} if epoch is None else {"last": rows.path})}
        self.store.commit(old, segments, state)
        self._compact()
        return added.drop("bucket"), read

    def _maybe(self, firsts: DataFrame, manifest: Manifest) -> DataFrame:
        """The keys of the batch, with their bucket, all of whose bits are set."""
        keys = firsts.where(F.col(self.key).isNotNull())
        hit = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # at most the buckets
        filters = self.store.read(manifest.of(FILTER), _FILTER_SCHEMA, where=F.col("bucket").isin(hit))
        filters = filters.groupBy("bucket", "word").agg(F.bit_or("mask").alias("have"))
        words = self._words(keys).join(filters, ["bucket", "word"], "left")
        is_set = F.coalesce(F.col("have").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
        return words.groupBy(self.key, "bucket").agg(F.min(is_set).alias("all")).where("all").drop("all")

    def inserted(self, epoch: int) -> DataFrame:
        """The rows that the last committed batch inserted."""
        manifest = self.store.manifest()
        if manifest.state.get("epoch") != str(epoch):
            return self.store.spark.createDataFrame([], self.schema)
        path = f"{self.store.base}/{manifest.state['last']}"
        return self.store.spark.read.schema(self._stored_schema).parquet(path).drop("bucket")

    def _merged(self, rows: DataFrame, kind: str) -> DataFrame:
        if kind == FILTER:
            return rows.groupBy("bucket", "word").agg(F.bit_or("mask").alias("mask")).select("word", "mask", "bucket")
        return rows

    def read(self) -> DataFrame:
        return self._rows(self.store.manifest()).drop("bucket")
