"""Evenly spaced evaluation-case sampling and first-N selection (ORD-3, ORD-4).

ORD-4 expands each series length into N candidate positions (N is a
parameter, not data) with ``explode(sequence(...))``, keeps the distinct ones and equi-joins them to the
indexed series on (keys, idx).  Only the N numbered positions are ever
ordered together, never the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def even_positions(lengths: DataFrame, num_cases: int = 1000, window: int = 72,
                   horizon: int = 24, test_ratio_start: float = 0.8, keys=()) -> DataFrame:
    """Distinct positions ``start + k*(end-start) div (N-1)`` with the last forced to ``end``.

    ``start = max(int(n * ratio), window)``, ``end = n - horizon - 1`` per key;
    ``lengths`` has the keys and ``n``.  Output: keys, ``idx``, ``case_id``
    (1-based in position order, per key).
    """
    keys = list(keys)
    if num_cases < 1:
        raise ValueError("num_cases must be >= 1")
    b = lengths.select(
        *keys,
        F.greatest(F.floor(F.col("n").cast("double") * F.lit(float(test_ratio_start))), F.lit(window)).cast("bigint").alias("_s"),
        (F.col("n") - F.lit(horizon + 1)).cast("bigint").alias("_e"),
    ).where("_e >= _s")   # a series too short for the test part has no positions
    span = F.col("_e") - F.col("_s")
    if num_cases == 1:
        pos = F.col("_s")
    else:
        pos = F.when(F.col("_k") == num_cases - 1, F.col("_e")).otherwise(
            F.col("_s") + F.floor((F.col("_k") * span) / F.lit(num_cases - 1)).cast("bigint"))
    cand = b.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(num_cases - 1).cast("bigint"))))
    idx = cand.select(*keys, pos.cast("bigint").alias("idx")).distinct()
    w = Window.partitionBy(*keys).orderBy("idx") if keys else Window.orderBy("idx")
    return idx.withColumn("case_id", F.row_number().over(w).cast("bigint"))


def series_lengths(series: DataFrame, keys=()) -> DataFrame:
    """Per-key length, taken from the ``n`` column the position step adds."""
    keys = list(keys)
    return series.groupBy(*keys).agg(F.max("n").alias("n"))


def even_sample(spark: SparkSession, series: DataFrame, num_cases: int = 1000, window: int = 72, horizon: int = 24,
                keys=()) -> DataFrame:
    """Sampled request rows of an indexed series: keys, case_id, idx, and the series columns."""
    keys = list(keys)
    pos = even_positions(series_lengths(series, keys), num_cases, window, horizon, keys=keys)
    return pos.join(series, on=keys + ["idx"], how="inner")


def first_cases(cases: DataFrame, max_cases: int | None, order_col: str = "case_id") -> DataFrame:
    """First N cases by id; ``None`` keeps all (ORD-3).  Planned as TakeOrderedAndProject."""
    return cases if max_cases is None else cases.orderBy(order_col).limit(max_cases)
