"""Data-quality reports on raw and clean series (AGG-12..15, ORD-2/5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """Null count per column plus the row count, one global aggregate (AGG-12)."""
    cols = list(cols or df.columns)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        *[F.count_if(F.col(c).isNull()).cast("bigint").alias(f"{c}_nulls") for c in cols],
    )


def series_range(series: DataFrame, keys=(), date_col: str = "date") -> DataFrame:
    """Row count, first and last time (AGG-13), per key when keys are given."""
    return series.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.min(date_col).alias("start_date"),
        F.max(date_col).alias("end_date"),
    )


def step_frequency(series: DataFrame, keys=(), top: int | None = 5, date_col: str = "date") -> DataFrame:
    """Most common time steps between consecutive rows (AGG-14, WIN-2, ORD-5).

    The first row of each key has no step and is left out.  ``top`` keeps the
    k most frequent (count desc, then step) -- a top-k report; ``None`` keeps all.
    """
    steps = W.step_sizes(series, keys, date_col=date_col).where(F.col("step_seconds").isNotNull())
    freq = steps.groupBy("step_seconds").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    if top is None:
        return freq
    return freq.orderBy(F.col("count").desc(), F.col("step_seconds")).limit(top)


def preview(df: DataFrame, k: int = 5, order_col: str = "case_id") -> DataFrame:
    """First rows by a key (ORD-2)."""
    return df.orderBy(order_col).limit(k)
