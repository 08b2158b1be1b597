"""Irregular reports -> one row per hour (PRJ-1..5, FLT-1/2, AGG-1).

The collapse is keyed on (series keys, hour) with partial aggregation before
the shuffle, so a hot hour is pre-combined on every map task and never
materialised as one group.  With a single integer tie column the order is one
fixed-width number and the aggregate is a hash aggregate; other orders are
structs, which Spark aggregates after a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import vocab

# FIXED VALUES: raw column names of the hourly report files and their clean names.
RAW_RENAMES = {
    "DATE": "date",
    "HourlyDryBulbTemperature": "temperature",
    "HourlyDewPointTemperature": "dew_point",
    "HourlyWindSpeed": "wind_speed",
}

# A plain decimal number (optional sign, optional exponent), surrounded by blanks.
_NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def lenient_number(c: Column) -> Column:
    """Text to double, anything non-numeric to null (PRJ-4).

    The regex guard keeps Java-only forms such as ``57d`` / ``57f`` and the
    words NaN / Infinity out, so the result equals a strict decimal parse.
    """
    s = c.cast("string")
    return F.when(s.rlike(_NUMERIC), F.trim(s).try_cast("double"))


def lenient_timestamp(c: Column, fmt: str | None = None) -> Column:
    """Text to TIMESTAMP_NTZ, unparsable to null (PRJ-2)."""
    if fmt:
        return F.try_to_timestamp(c.cast("string"), F.lit(fmt)).cast("timestamp_ntz")
    return c.cast("string").try_cast("timestamp_ntz")


def strict_timestamp(c: Column) -> Column:
    """Text to TIMESTAMP_NTZ; a bad value fails the job (PRJ-3, ANSI cast)."""
    return c.cast("timestamp_ntz")


def floor_hour(c: Column) -> Column:
    """Floor to the hour, staying TIMESTAMP_NTZ (PRJ-5)."""
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def floor_day(c: Column) -> Column:
    return F.date_trunc("day", c).cast("timestamp_ntz")


def rename_raw(df: DataFrame, renames: dict | None = None) -> DataFrame:
    """Keep and rename the four report columns (PRJ-1, PRJ-6)."""
    renames = renames or RAW_RENAMES
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in renames.items()])


def coerce_reports(df: DataFrame, time_col: str = "date", value_cols=None, time_format: str | None = None) -> DataFrame:
    """Parse time and measures leniently, drop rows without a time (PRJ-2, PRJ-4, FLT-1)."""
    value_cols = value_cols or vocab.MEASURES
    t = F.col(time_col)
    if isinstance(df.schema[time_col].dataType, StringType):
        t = lenient_timestamp(t, time_format)
    else:
        t = t.cast("timestamp_ntz")
    cols = {time_col: t}
    for c in value_cols:
        dt = df.schema[c].dataType
        cols[c] = lenient_number(F.col(c)) if isinstance(dt, StringType) else F.col(c).cast("double")
    return df.withColumns(cols).where(F.col(time_col).isNotNull())


#: Digits of the microseconds of a day, of a bigint, and that a DECIMAL holds.
_DAY_DIGITS, _LONG_DIGITS, _DECIMAL_DIGITS = 11, 19, 38


def _packed_order(time: Column, period: Column, ties) -> Column:
    """(microseconds into the period, *ties) as one DECIMAL; ``ties``: (column name, its digits) each."""
    digits = _DAY_DIGITS
    order = (F.unix_micros(time.cast("timestamp")) - F.unix_micros(period.cast("timestamp"))).cast(f"decimal({digits},0)")
    for name, width in ties:
        digits += width
        if digits > _DECIMAL_DIGITS:
            raise ValueError(f"the ties have more than {_DECIMAL_DIGITS - _DAY_DIGITS} digits together")
        # a tie of more digits than stated fails the cast (ANSI)
        order = (order * F.lit("1" + "0" * width).cast(f"decimal({width + 1},0)") + F.col(name).cast(f"decimal({width},0)")).cast(f"decimal({digits},0)")
    return order.cast(f"decimal({_DECIMAL_DIGITS},0)")


def last_per_period(
    df: DataFrame,
    time_col: str = "date",
    value_cols=None,
    keys=(),
    tie_cols=(),
    period: str = "hour",
    drop_incomplete: bool = True,
    unique_tie=None,
) -> DataFrame:
    """Last non-null value per column within each period (AGG-1, FLT-2).

    ``last`` is per column and skips nulls, so one output row may mix reports.
    The order inside a period is (time, *tie_cols, value): ending the ordering
    key with the value makes equal timestamps deterministic.  Rows whose
    measure is null carry a null ordering key and are ignored by ``max_by``.
    ``unique_tie`` names, instead of ``tie_cols``, one integer column, or gives
    (column, digits) of several with 27 digits together, that are not negative
    or null and tell rows of one key and time apart: (time, *ties) are then packed into one
    DECIMAL(38), whose buffer a hash aggregate can hold; a tie of more digits
    than stated is an error.
    Output is one row per (keys, period) with at least one time; periods with
    any null measure are dropped when ``drop_incomplete``.
    """
    value_cols = list(value_cols or vocab.MEASURES)
    keys = list(keys)
    floor = floor_hour if period == "hour" else floor_day if period == "day" else None
    if floor is None:
        raise ValueError(f"unsupported period {period!r}")
    if unique_tie and tie_cols:
        raise ValueError("give tie_cols or unique_tie, not both")
    p = df.withColumn("_period", floor(F.col(time_col)))
    if unique_tie:
        ties = [(unique_tie, _LONG_DIGITS)] if isinstance(unique_tie, str) else unique_tie
        p = p.withColumn("_order", _packed_order(F.col(time_col), F.col("_period"), ties))
    aggs = []
    for c in value_cols:
        v = F.col(c)
        order = F.col("_order") if unique_tie else F.struct(F.col(time_col), *[F.col(t) for t in tie_cols], v)
        order_key = F.when(v.isNotNull(), order)
        aggs.append(F.max_by(v, order_key).alias(c))
    out = p.groupBy(*keys, "_period").agg(*aggs).withColumnRenamed("_period", time_col)
    if drop_incomplete:
        out = out.dropna(subset=value_cols)
    return out.select(*keys, time_col, *value_cols)


def clean_hourly(raw: DataFrame, time_col: str = "date", value_cols=None, keys=(), tie_cols=(), time_format=None,
                 unique_tie=None) -> DataFrame:
    """Raw reports to the clean hourly series: coerce, drop bad times, collapse, drop incomplete hours."""
    value_cols = list(value_cols or vocab.MEASURES)
    coerced = coerce_reports(raw, time_col, value_cols, time_format)
    # NaN is "missing" for the downstream dropna, as in a pandas frame
    coerced = coerced.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in value_cols})
    return last_per_period(coerced, time_col, value_cols, keys, tie_cols, "hour", unique_tie=unique_tie)
