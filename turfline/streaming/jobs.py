"""Structured Streaming jobs built on the batch operators.

The reference refreshes on a timer; here each refresh is a micro-batch of new
files read by a file source with a checkpoint, processed with ``foreachBatch``:

* ``stream_upsert``: every batch is reduced to its latest row per key and
  becomes a segment of an ``UpsertTable``; segments are merged level by level, so
  reading stays bounded after many batches.
* ``stream_insert_if_absent``: url de-duplication keeps no operator state; each
  batch asks the Bloom filters of a ``KeyedTable`` and reads the stored urls of the
  buckets that may hold one of its own.
* ``stream_refresh_index``: the same batch embeds the rows it inserted into the
  stored index, and does nothing when the insert was empty.

Tables note the last batch they committed, so a batch that is tried again is not applied twice.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.operators import index as IX
from turfline.operators.stores import KeyedTable, UpsertTable
from turfline.session import ensure_checkpoint_dir
from turfline.sources.segments import SegmentStore


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def _run(spark: SparkSession, source_path: str, schema, max_files: int, base: str, apply) -> None:
    """All files of the source in micro-batches of ``max_files``, each given to ``apply(batch, epoch)``."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_path)
    q = (src.writeStream.foreachBatch(apply).option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_upsert(spark: SparkSession, source_path: str, schema, keys: Sequence[str], order_cols: Sequence[str],
                  max_files: int = 1, base: str | None = None) -> DataFrame:
    """Upsert each micro-batch of new files into a keyed table; returns the table."""
    base = base or run_dir(spark, "upsert")
    table = UpsertTable(spark, os.path.join(base, "table"), schema, keys, order_cols)
    _run(spark, source_path, schema, max_files, base, lambda batch, epoch: table.upsert(batch, epoch))
    return table.read()


def stream_insert_if_absent(spark: SparkSession, source_path: str, schema, key: str = "url",
                            order_col: str = "id", max_files: int = 1, base: str | None = None,
                            index: bool = False, chunker: str = "fixed") -> tuple[DataFrame, DataFrame | None]:
    """Insert new articles deduplicated by ``key`` across batches (first arrival
    wins); with ``index`` also embed the documents of each batch that
    inserted something. Returns (stored table, index or None)."""
    base = base or run_dir(spark, "insert")
    table = KeyedTable(spark, os.path.join(base, "table"), schema, key, order_col)
    documents = SegmentStore(spark, os.path.join(base, "index"))

    def apply(batch: DataFrame, epoch: int) -> None:
        rows, _ = table.insert(batch, epoch)
        if index:
            IX.add_news(documents, rows, chunker, epoch)

    _run(spark, source_path, schema, max_files, base, apply)
    return table.read(), IX.read_index(documents) if index else None


def write_ordered_files(df: DataFrame, order_col: str, path: str, parts: int = 4) -> str:
    """Replay a table as an ordered arrival sequence (test input for the file
    source): ``parts`` files in ascending ``order_col`` ranges, one write per
    range so file times follow the range order. Not a production write path."""
    spark = df.sparkSession
    bounds = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()  # one row
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        return path
    step = (hi - lo) // parts + 1
    for i in range(parts):
        part = df.where((F.col(order_col) >= lo + i * step) & (F.col(order_col) < lo + (i + 1) * step))
        part.coalesce(1).write.mode("overwrite" if i == 0 else "append").parquet(path)
    return path
