"""Row position per series without a single-task sort (WIN-1, §A).

:func:`range_positions` is the form for stored series: Spark's range
partitioner samples the order of all rows and cuts it into ranges of about
equal row counts, whatever the data's rate (a day that holds nine tenths of a
series is cut like any other stretch).  The rows are written once, sorted within
their range; the writing numbers them, so a row's place in its range costs
nothing more.  A zone map (rows, first and last time of each key in each range)
then gives every range its offset: one shuffle of the rows in all.

:func:`with_position` is the lazy form, with calendar buckets:

``row_number() over (order by date)`` with no partition moves the whole table
into one task.  Instead:

1. count rows per (keys, bucket) -- a partial+final hash aggregate;
2. exclusive running sum of those counts per key -> bucket offset
   (the only window without the row data; it sees keys x buckets rows);
3. ``idx = offset + row_number() over (partition by keys, bucket order by ...) - 1``.

The bucket (default: calendar day of the first ordering column) bounds how
many rows one window partition holds, so a hot key is still spread over many
tasks.  The offsets table is small (keys x buckets); AQE broadcasts it when
its measured size is under the broadcast threshold and shuffles otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: monotonically_increasing_id: the partition's number in the upper bits, the row's place in it in the lower 33.
_PLACE_BITS = 33


def zone_map(ranged: DataFrame, order_col: str, keys=()) -> DataFrame:
    """Rows, first row number and first and last time of each key in each range of a numbered table."""
    return ranged.groupBy(*keys, F.shiftright("_at", _PLACE_BITS).alias("_range")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("_at").alias("first_row"), F.min(order_col).alias("first"), F.max(order_col).alias("last"))


def ranged_rows(df: DataFrame, order_cols, keys=(), ranges: int | None = None, name: str = "ranges") -> DataFrame:
    """``df`` written in ranges of (keys, order) of about equal size, each row with its number ``_at``."""
    order = [*keys, *order_cols]
    parts = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return materialize(parts.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)


def range_positions(df: DataFrame, order_cols, keys=(), idx_col: str = "idx", count_col: str | None = "n", ranges: int | None = None) -> DataFrame:
    """Add a dense 0-based position per key in ``order_cols`` (column names) order, plus the series length.

    ``order_cols`` must identify rows uniquely within a key.  Rows with a null
    key are a series of their own; a null time comes first.  ``ranges`` is the
    number of ranges (the session's shuffle partitions if not given).
    """
    keys = list(keys)
    rows = ranged_rows(df, list(order_cols), keys, ranges, "positions")
    per_key = Window.partitionBy(*keys)
    zones = zone_map(rows, order_cols[0], keys).select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of_range"),
        (F.coalesce(F.sum("rows").over(per_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first_row")).alias("_off"),
        F.sum("rows").over(per_key).alias("_n"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys],
                  F.shiftright("_at", _PLACE_BITS) == F.col("_of_range"))
    out = rows.join(zones if keys else F.broadcast(zones), same)   # without keys: a row for each range
    counts = [F.col("_n").cast("bigint").alias(count_col)] if count_col else []
    return out.select(*df.columns, (F.col("_off") + F.col("_at")).cast("bigint").alias(idx_col), *counts)


def day_bucket(c: Column, unit: str = "day") -> Column:
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def with_position(
    df: DataFrame,
    order_cols,
    keys=(),
    idx_col: str = "idx",
    count_col: str | None = "n",
    bucket: Column | None = None,
    unit: str = "day",
) -> DataFrame:
    """Add a dense 0-based position per key in ``order_cols`` order, plus the series length.

    ``order_cols`` must identify rows uniquely within a key (ties would make
    the position arbitrary); the first column must be monotone with ``bucket``.
    Rows with a null key are a series of their own; rows with a null first
    order column come first.
    ``unit`` sets the calendar bucket (``day`` for hourly data, ``month`` or
    ``year`` for daily data) so that a bucket holds many rows but a bounded number.
    """
    keys = list(keys)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    b = df.withColumn("_bucket", bucket if bucket is not None else day_bucket(order_cols[0], unit))
    counts = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    per_key = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = counts.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_cnt").over(per_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(*keys)).alias("_n"),
    )
    on = keys + ["_bucket"]
    offsets = offsets.select(*[F.col(c).alias(f"_at_{c}") for c in on], "_off", "_n")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in on])
    joined = b.join(offsets, on=same, how="inner").drop(*[f"_at_{c}" for c in on])
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order_cols)
    out = joined.withColumn(idx_col, (F.col("_off") + F.row_number().over(within) - 1).cast("bigint"))
    if count_col:
        out = out.withColumn(count_col, F.col("_n").cast("bigint"))
    return out.drop("_bucket", "_off", "_cnt", "_n")


def with_position_global(df: DataFrame, order_cols, keys=(), idx_col: str = "idx") -> DataFrame:
    """Plain form: one window per key (a single task when ``keys`` is empty); used as a check."""
    w = Window.partitionBy(*keys).orderBy(*order_cols) if keys else Window.orderBy(*order_cols)
    return df.withColumn(idx_col, (F.row_number().over(w) - 1).cast("bigint"))
