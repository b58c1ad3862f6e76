"""Written intermediate tables in the shared folder, and global row numbers.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs at most the stage that is running.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfline.session import ensure_checkpoint_dir, map_arrow  # noqa: F401  (map_arrow: for the operators)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back (each caller gets its own path)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table (ids, keys, labels) in a partition, and the partitions that it keeps at least.
FEW_ROWS, FEW_PARTS = 50_000, 16


def few(df: DataFrame, rows: int, per: int = FEW_ROWS) -> DataFrame:
    """``df`` in no more partitions than about ``rows`` rows need, ``per`` rows to each.

    A small table dealt to all shuffle partitions costs more in tasks and files than in rows. All
    rows stay, nothing moves: neighbouring partitions become one task, more of them the more rows there are.
    """
    return df.coalesce(max(FEW_PARTS, -(-rows // per)))


def global_rank(df: DataFrame, order: list[Column], name: str = "_rank") -> DataFrame:
    """Rows numbered from 0 in the order of ``order``, which should end in columns that tell
    rows apart: equal keys stay in one range, all else is dealt out.

    Rows are range-partitioned, sorted inside their partition and stored; the number is the
    position in the partition plus the rows of the partitions before. The only frame that is
    windowed without a key has one row per partition.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order)))
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "rank")
    ranged = ranged.withColumns({"_part": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND((1 << 33) - 1)})
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (ranged.join(F.broadcast(before), "_part")  # one row per partition
            .withColumn(name, F.col("_before") + F.col("_pos"))
            .drop("_part", "_pos", "_before", "_at"))
