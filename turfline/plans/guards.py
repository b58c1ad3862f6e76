"""Size guards for broadcast decisions.

Policy
------
* A one-row global aggregate (or state row) is never joined: its columns are
  attached as scalar subqueries (``with_scalars``), computed once and inlined.
* Any other side is broadcast only after a bounded probe of its rows and bytes proves it
  small (``small_side``). Beyond the bound it is returned unchanged and the planner
  falls back to a shuffle (sort-merge) join, which AQE may still demote to a
  broadcast at runtime from measured shuffle sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.session import stored

#: Rows and bytes above which a side is never broadcast (dimension-sized data only).
DEFAULT_BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: eight for a fixed-size value, its own length for a text."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 8
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            width = width + F.length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
        else:
            width = width + 8
    return width


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes; the probe stops after one row too many."""
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b")).first()
    return size["n"] <= max_rows and (size["b"] or 0) <= max_bytes


def small_side(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
               materialize: bool = False, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` iff it holds at most ``max_rows`` rows and ``max_bytes`` bytes.

    With ``materialize`` the side is stored first, so the probe and the
    join read the same computed rows (useful for derived aggregates).
    """
    if materialize:
        df = stored(df, "side")
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


#: Parts into which the rows of one key are dealt before they meet what belongs to that key.
KEY_PARTS = 32


def looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` joined with the rows of ``table`` that have their ``key``. The rows of a frequent key are dealt
    to ``KEY_PARTS`` parts by their hash; a part gets the key's rows of ``table`` once. Neither side is broadcast by
    its number of rows, and no task gets all rows of a key."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(KEY_PARTS)))
    parts = dealt.select(key, "_part").distinct().join(table, key)
    return dealt.join(parts, [key, "_part"]).drop("_part")


def reuse(df: DataFrame) -> DataFrame:
    """Store a derived frame that is read more than once (a size probe plus
    the join, or two branches of one plan), so its upstream work (e.g. a k-NN
    scan of the whole corpus) runs once. Nothing stays cached afterwards."""
    return stored(df, "reused")


def with_scalars(df: DataFrame, one: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate, a state row)
    to every row of ``df`` as scalar subqueries: each value is computed once and
    inlined into the projection, so there is no join and no pairs table.
    Several columns come from one struct-valued subquery held in one column and
    read by a second projection (the optimizer does not inline a subquery that
    is referenced more than once), so the one-row frame is evaluated once; more
    than one row is an error instead of a silent multiplication of ``df``."""
    cols = list(cols or one.columns)
    if len(cols) == 1:
        return df.withColumn(cols[0], one.select(cols[0]).scalar())
    out = df.withColumn("_scalars", one.select(F.struct(*cols)).scalar())
    return out.withColumns({c: F.col("_scalars").getField(c) for c in cols}).drop("_scalars")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition only when ``df`` has fewer partitions than the
    cluster's default parallelism (e.g. one small file with a single row group)
    before CPU-heavy per-row work. On a large input with many splits this is a
    no-op, so no shuffle is added at scale."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
