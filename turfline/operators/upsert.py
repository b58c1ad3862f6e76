"""Upsert, dedupe, incremental refresh and schema evolution.

Last-write-wins and first-occurrence-wins are expressed as ``max_by`` /
``min_by`` aggregates rather than ``row_number`` windows: the aggregate has a
partial (map-side) phase, so a key that holds a third of all rows is reduced
to one row per map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.session import stored


def _pick_by_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], last: bool) -> DataFrame:
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order_cols])
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*[F.col(c) for c in payload]), ordering).alias("_row")
    out = df.groupBy(*keys).agg(row)
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload]).select(*df.columns)


def latest_by_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order_cols`` (last write wins)."""
    return _pick_by_key(df, keys, order_cols, last=True)


def first_by_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """One row per key: the one with the smallest ``order_cols`` (first occurrence wins)."""
    return _pick_by_key(df, keys, order_cols, last=False)


def upsert_by_key(existing: DataFrame, updates: DataFrame, keys: Sequence[str],
                  order_cols: Sequence[str] = ()) -> DataFrame:
    """Replace rows by primary key; updates beat stored rows; within the batch
    the greatest ``order_cols`` wins (the batch's own sequence column)."""
    cols = existing.columns
    extra = [c for c in order_cols if c not in cols]
    ex = existing.select(*cols, *[F.lit(None).cast(updates.schema[c].dataType).alias(c) for c in extra],
                         F.lit(0).alias("_v"))
    up = updates.select(*cols, *extra, F.lit(1).alias("_v"))
    return latest_by_key(ex.unionByName(up), keys, ["_v", *order_cols]).drop("_v", *extra)


def insert_if_absent(existing: DataFrame, batch: DataFrame, key: str = "url", order_col: str = "id") -> DataFrame:
    """Rows of ``batch`` whose ``key`` is not stored yet; first occurrence in the
    batch wins; stored rows never change. Returns only the rows to insert.

    For any two frames: the batch is reduced map-side to one row a key, then one anti join. A table that
    grows by batches keeps its keys in buckets with Bloom filters (``stores.KeyedTable``)."""
    firsts = first_by_key(batch, [key], [order_col])
    return firsts.join(existing.select(key), on=key, how="left_anti").select(*batch.columns)


def insert_if_absent_count(existing: DataFrame, batch: DataFrame, key: str = "url",
                           order_col: str = "id") -> DataFrame:
    """One row: number inserted and stored total after the insert."""
    new = insert_if_absent(existing, batch, key, order_col)
    n_new = new.agg(F.count(F.lit(1)).alias("inserted"))
    n_old = existing.agg(F.count(F.lit(1)).alias("_old"))
    return n_new.select("inserted", (F.col("inserted") + n_old.scalar()).alias("total"))


def assign_row_ids(df: DataFrame, order_cols: Sequence, start: int | DataFrame = 1,
                   id_col: str = "row_id", num_partitions: int | None = None) -> DataFrame:
    """Dense increasing ids in ``order_cols`` order, without a global window.

    Range-partition by the order, number rows inside each partition, and add
    the cumulative count of the preceding partitions (a table with one row per
    partition). ``order_cols`` must be a total order for reproducible ids.
    ``start`` is a constant or a one-row DataFrame with a column ``start``.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    tagged = stored(ranged.sortWithinPartitions(*order)
                    .withColumn("_p", F.spark_partition_id())
                    .withColumn("_m", F.monotonically_increasing_id()), "numbered")
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a window without keys is bounded by the partition count.
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_p")
    local = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    if isinstance(start, DataFrame):
        base = start.select(F.col("start").cast("long")).scalar()
    else:
        base = F.lit(int(start))
    return out.withColumn(id_col, base + F.col("_off") + local).drop("_p", "_m", "_off", "_start")


def stamp_ingest_time(df: DataFrame, batch_ts: str, col: str = "fetched_at") -> DataFrame:
    """Same ingest timestamp on each row of a batch (a parameter, for determinism)."""
    return df.withColumn(col, F.lit(batch_ts).cast("timestamp"))


def schema_add_columns(df: DataFrame, target: T.StructType) -> DataFrame:
    """Bring an old table to the current schema: absent columns become NULL,
    present ones keep their values; applying it twice equals applying it once."""
    have = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have
            else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields]
    extra = [c for c in df.columns if c not in {f.name for f in target.fields}]
    return df.select(*cols, *extra)


# ---------------------------------------------------------------- state / watermarks

STATE_SCHEMA = T.StructType([T.StructField("key", T.StringType(), False),
                             T.StructField("value", T.StringType(), True)])


def state_get(state: DataFrame, key: str, default: str = "0") -> DataFrame:
    """One-row frame ``value``: the stored value or the default."""
    hit = state.where(F.col("key") == key).agg(F.max("value").alias("_v"))
    return hit.select(F.coalesce("_v", F.lit(default)).alias("value"))


def state_set(state: DataFrame, key: str, value: DataFrame | str) -> DataFrame:
    """Replace by key on the 2-column state table."""
    spark = state.sparkSession
    if isinstance(value, str):
        new = spark.createDataFrame([(key, value)], STATE_SCHEMA)
    else:
        new = value.select(F.lit(key).alias("key"), F.col("value").cast("string"))
    return upsert_by_key(state, new, ["key"])


def watermark_value(state: DataFrame, key: str, default: int = 0) -> int:
    """Read a high-water mark as a literal (one bounded scalar), so the range
    filter reaches the parquet scan as a pushed predicate."""
    row = state_get(state, key, str(default)).first()
    return int(row["value"])


def incremental_since_watermark(df: DataFrame, mark: int, id_col: str = "id") -> DataFrame:
    return df.where(F.col(id_col) > F.lit(mark))


def advance_watermark(batch: DataFrame, old_mark: int | DataFrame, id_col: str = "id") -> DataFrame:
    """New mark = max(id) of the batch; unchanged when the batch is empty."""
    old = F.lit(int(old_mark)) if not isinstance(old_mark, DataFrame) else None
    agg = batch.agg(F.max(id_col).cast("long").alias("_mx"))
    if old is None:
        old = old_mark.select(F.col("value").cast("long")).scalar()
    return agg.select(F.coalesce("_mx", old).alias("mark"))


def refresh_by_key(stored: DataFrame, new_docs: DataFrame, key: str = "name") -> DataFrame:
    """Delete every stored row whose ``key`` occurs in the new batch, then add
    the batch. Rows with a NULL key are never deleted; they bypass the anti join
    entirely, so NULL keys (e.g. every news chunk) never pile into one shuffle
    partition."""
    gone = new_docs.select(key).where(F.col(key).isNotNull()).distinct()
    keyed = stored.where(F.col(key).isNotNull()).join(gone, on=key, how="left_anti")
    unkeyed = stored.where(F.col(key).isNull())
    return keyed.select(*stored.columns).unionByName(unkeyed).unionByName(new_docs.select(*stored.columns))
