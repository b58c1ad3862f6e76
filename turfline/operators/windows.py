"""Ordered per-entity operators (trailing frames, first rows, listings).

Trailing frames ("the n rows before this one") take one range shuffle by (entity, order) and a halo:
each sorted range is passed once, carrying the last n rows along; only the first n rows of a range
may lack rows that lie in earlier ranges, and only the last n rows of a range can be lacking. These
few border rows meet in a small join. An entity with a third of all rows spreads over many ranges, and
no row is copied but into the frames of its successors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.operators.upsert import first_by_key
from turfline.session import ensure_checkpoint_dir

#: Rows of the stored pass: complete, short of rows from earlier ranges, last rows of a range.
COMPLETE, SHORT, LAST = 0, 1, 2


def _frames(table: pa.Table, parts: list[str], payload: pa.StructArray, n: int) -> tuple[pa.ListArray, np.ndarray]:
    """For each row the payload of the up to n rows before it with equal ``parts``, and the first row of its run."""
    rows = table.num_rows
    new = np.zeros(rows, dtype=bool)
    new[0] = True
    for name in parts:
        codes = table.column(name).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    at = np.arange(rows)
    run = np.maximum.accumulate(np.where(new, at, 0))
    low = np.maximum(run, at - n)
    ends = np.concatenate([[0], np.cumsum(at - low)])
    index = np.repeat(low - ends[:-1], at - low) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), payload.take(pa.array(index, pa.int64()))), run


def _pass(parts: list[str], names: list[str], fields: list[str], n: int, schema: pa.Schema):
    """The pass over one sorted range: every row with its frame, then the last n rows once more.

    Columns: those of the input, then the frame, the kind of the row, its range and its place there."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_no, seen, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            table = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            old = table.num_rows - new.num_rows
            columns = [table.column(f).combine_chunks() for f in fields]
            payload = pa.StructArray.from_arrays(columns, [f.removeprefix("_of_") for f in fields])
            frames, run = _frames(table, parts, payload, n)
            place = seen + np.arange(new.num_rows)
            # the range begins at this table's first row as long as all rows before are still held
            short = (place < n) & (run[old:] == 0) & (seen == old) & (range_no > 0)
            yield out(table.slice(old), frames.slice(old), np.where(short, SHORT, COMPLETE), place, range_no)
            seen += new.num_rows
            held = table.slice(max(0, table.num_rows - n))
        if held is not None:
            own = pa.ListArray.from_arrays(pa.array(np.arange(held.num_rows + 1), pa.int32()), pa.StructArray.from_arrays(
                [held.column(f).combine_chunks() for f in fields], [f.removeprefix("_of_") for f in fields]))
            yield out(held, own, np.full(held.num_rows, LAST), seen - held.num_rows + np.arange(held.num_rows), range_no)

    def out(table: pa.Table, frames: pa.ListArray, kinds: np.ndarray, place: np.ndarray, range_no: int) -> pa.RecordBatch:
        n_rows = table.num_rows
        own = [table.column(c).combine_chunks() for c in names]
        extra = [frames, pa.array(kinds, pa.int32()), pa.array(np.full(n_rows, range_no), pa.int64()), pa.array(place, pa.int64())]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(own + extra, schema)], schema=schema)

    return step


def preceding_rows(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence[str], n: int,
                   payload: dict[str, Column], out: str = "preceding") -> DataFrame:
    """Add ``out``: array of up to ``n`` structs (payload) of the rows before each row inside its
    partition, oldest first (empty for the first row).

    Null keys are one partition; rows with equal ``part_cols + order_cols`` come in some order.
    The pass is stored once, in the shared folder, and its border rows are read from there."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    parts, fields = list(part_cols), [f"_of_{k}" for k in payload]
    source = df.withColumns({f: v for f, v in zip(fields, payload.values())})
    item = T.StructType([T.StructField(k, source.schema[f].dataType) for k, f in zip(payload, fields)])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(item)), T.StructField("_kind", T.IntegerType()),
                           T.StructField("_range", T.LongType()), T.StructField("_place", T.LongType())])
    keys = [*parts, *order_cols]
    ranged = source.repartitionByRange(*keys).sortWithinPartitions(*keys)
    path = f"{ensure_checkpoint_dir(spark)}/frames-{uuid.uuid4().hex}"
    step = _pass(parts, df.columns, fields, n, to_arrow_schema(schema))
    ranged.mapInArrow(step, schema).write.parquet(path)
    done = spark.read.schema(schema).parquet(path)

    # At most n rows of a range are last ones: numbered over all ranges, the rows that a short one
    # lacks are the numbers before its range.
    last = done.where(F.col("_kind") == LAST).select(*[F.col(c).alias(f"_part_{i}") for i, c in enumerate(parts)],
                                                     F.get(out, F.lit(0)).alias("_item"), "_range", "_place")
    last = last.withColumn("_no", F.row_number().over(Window.orderBy("_range", "_place")))
    upto = last.groupBy("_range").agg(F.max("_no").alias("_no"))  # one row for each range
    starts = upto.select("_range", F.lag("_no").over(Window.orderBy("_range")).alias("_upto"))
    wanted = done.where(F.col("_kind") == SHORT).drop("_kind").join(starts, "_range")
    lacking = wanted.select("_range", "_place", "_upto", *[F.col(c).alias(f"_mine_{i}") for i, c in enumerate(parts)],
                            F.explode(F.sequence(F.lit(0), F.lit(n - 1) - F.col("_place"))).alias("_back"))
    lacking = lacking.withColumn("_no", F.col("_upto") - F.col("_back")).join(last.drop("_range", "_place"), "_no")
    for i in range(len(parts)):
        lacking = lacking.where(F.col(f"_mine_{i}").eqNullSafe(F.col(f"_part_{i}")))
    found = lacking.groupBy("_range", "_place").agg(F.array_sort(F.collect_list(F.struct("_no", "_item"))).alias("_found"))
    mended = wanted.join(found, ["_range", "_place"], "left").withColumn(
        out, F.concat(F.coalesce(F.transform("_found", lambda x: x["_item"]), F.array().cast(schema[out].dataType)), F.col(out)))
    columns = [*df.columns, out]
    return done.where(F.col("_kind") == COMPLETE).select(columns).unionByName(mended.select(columns))


def last_n_turns(messages: DataFrame, n: int, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "query") -> DataFrame:
    """For every message, the n messages before it; role user -> human, else assistant."""
    role = F.when(F.col(role_col) == "user", F.lit("human")).otherwise(F.lit("assistant"))
    return preceding_rows(messages, [conv_col], [turn_col], n,
                          {"role": role, "content": F.col(text_col)}, out="history")


def rolling_mean(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence[str], value: str,
                 window: int, out: str) -> DataFrame:
    """Trailing mean over ``window`` rows (this one included); NULL until the
    window is full (pandas ``rolling(window).mean()``)."""
    p = preceding_rows(df, part_cols, order_cols, window - 1, {"v": F.col(value)}, out="_prev")
    total = F.aggregate(F.col("_prev"), F.col(value).cast("double"), lambda acc, x: acc + x["v"])
    full = F.size("_prev") == window - 1
    return p.withColumn(out, F.when(full, total / F.lit(float(window)))).drop("_prev")


def first_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """First row per key in ``order_col`` order (partial ``min_by`` aggregate)."""
    return first_by_key(df, [key], [order_col])
