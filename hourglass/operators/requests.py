"""Forecast requests as tables: lookup, history range join, cases (JN-1..3, FLT-3/4/6, ML-4/5, UDF-4).

A request is a row, never a driver loop: thousands of requests are answered
by one plan.  Position look-ups (row r-71, r+24, ...) are computed once per
series row with halo-chunked window functions and then equi-joined to the
requests on (keys, date) -- a shuffle join both sides of which scale with the
data (AQE turns it into a broadcast only when a side measures small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from . import windows as W

MEASURES = vocab.MEASURES


def forecast_frame(series: DataFrame, value_cols=None, keys=(), window: int = 72, horizon: int = 24,
                   include_request_row: bool = True, chunk: int = W.DEFAULT_CHUNK) -> DataFrame:
    """Per series row r: window bounds, persistence prediction, target time and actuals.

    ``include_request_row``: inputs r-W+1 .. r (predict alignment) or r-W .. r-1
    (case alignment).  The persistence prediction is the last input row.
    """
    value_cols = list(value_cols or MEASURES)
    keys = list(keys)
    last = 0 if include_request_row else 1   # lag of the last input row
    first = window - 1 + last                # lag of the first input row
    fr = W.framed(series, "idx", keys, back=first, forward=horizon, chunk=chunk)
    s = fr.spec
    out = fr.df.select(
        *keys, "idx", "n", "date", "_chunk",
        F.lag("date", first).over(s).alias("input_window_start"),
        F.lag("date", last).over(s).alias("input_window_end"),
        F.lead("date", horizon).over(s).alias("target_date"),
        *[F.lag(c, last).over(s).alias(f"p_{c}") for c in value_cols],
        *[F.lead(c, horizon).over(s).alias(f"a_{c}") for c in value_cols],
    )
    out = fr.home(out)
    return out.withColumn(
        "status",
        F.when(F.col("idx") < F.lit(first), F.lit("no_history"))
        .when(F.col("idx") + F.lit(horizon) >= F.col("n"), F.lit("no_future"))
        .otherwise(F.lit("ok")),
    )


def request_lookup(requests: DataFrame, series: DataFrame, keys=(), window: int = 72, horizon: int = 24,
                   request_col: str = "request_time") -> DataFrame:
    """Batch form of the single-request prediction tool (ML-4 with persistence, JN-2, FLT-4, FLT-6).

    Every request gets one row with ``status`` in ok / not_found / no_history /
    no_future; values are null unless ok.  Output times are text, values
    rounded to 2 as the tool returns them.
    """
    keys = list(keys)
    f = forecast_frame(series, MEASURES, keys, window, horizon, include_request_row=True)
    r = requests.select(*keys, F.col(request_col).cast("timestamp_ntz").alias("_rt"))
    j = r.join(f.withColumnRenamed("date", "_rt"), on=keys + ["_rt"], how="left")
    ok = F.col("status") == "ok"
    status = F.coalesce(F.col("status"), F.lit("not_found"))
    val = lambda c: F.when(ok, c)
    err = {m: F.abs(F.col(f"p_{m}") - F.col(f"a_{m}")) for m in MEASURES}
    cols = [
        *keys,
        T.fmt_ts(F.col("_rt")).alias("request_time"),
        status.alias("status"),
        val(T.fmt_ts(F.col("input_window_start"))).alias("input_window_start"),
        val(T.fmt_ts(F.col("input_window_end"))).alias("input_window_end"),
        F.lit(horizon).alias("forecast_horizon_hours"),
        val(T.fmt_ts(F.col("target_date"))).alias("forecast_target_time"),
        *[val(F.round(F.col(f"p_{m}"), 2)).alias(f"predicted_{m}") for m in MEASURES],
        *[val(F.round(F.col(f"a_{m}"), 2)).alias(f"actual_{m}") for m in MEASURES],
        *[val(F.round(err[m], 2)).alias(f"{m}_abs_error") for m in MEASURES],
        val(F.round((err["temperature"] + err["dew_point"] + err["wind_speed"]) / F.lit(3.0), 2)).alias("average_abs_error"),
    ]
    return j.select(*cols)


def eval_cases(samples: DataFrame, series: DataFrame, keys=(), window: int = 72, horizon: int = 24,
               nested: bool = False) -> DataFrame:
    """Evaluation cases at sampled rows (ML-5): inputs r-W .. r-1, target r+H, persistence prediction.

    ``samples`` has keys, ``idx`` and ``case_id``.  Flat 12-column form (PRJ-7)
    unless ``nested``.
    """
    keys = list(keys)
    f = forecast_frame(series, MEASURES, keys, window, horizon, include_request_row=False)
    j = samples.select(*keys, "idx", "case_id").join(f, on=keys + ["idx"], how="inner").where(F.col("status") == "ok")
    pred = {m: F.round(F.col(f"p_{m}"), 2) for m in MEASURES}
    act = {m: F.round(F.col(f"a_{m}"), 2) for m in MEASURES}
    err = {m: F.round(F.abs(F.col(f"p_{m}") - F.col(f"a_{m}")), 2) for m in MEASURES}
    base = [*keys, F.col("case_id"), T.fmt_ts(F.col("date")).alias("request_time"),
            T.fmt_ts(F.col("target_date")).alias("forecast_target_time")]
    if nested:
        return j.select(*base,
                        F.struct(*[pred[m].alias(m) for m in MEASURES]).alias("prediction"),
                        F.struct(*[act[m].alias(m) for m in MEASURES]).alias("actual"),
                        F.struct(*[err[m].alias(m) for m in MEASURES]).alias("absolute_error"))
    return j.select(*base,
                    *[pred[m].alias(f"predicted_{m}") for m in MEASURES],
                    *[act[m].alias(f"actual_{m}") for m in MEASURES],
                    *[err[m].alias(f"{m}_abs_error") for m in MEASURES])


def flatten_case(cases: DataFrame) -> DataFrame:
    """Nested case -> 12 flat columns (PRJ-7)."""
    return cases.select(
        "case_id", "request_time", "forecast_target_time",
        *[F.col(f"prediction.{m}").alias(f"predicted_{m}") for m in MEASURES],
        *[F.col(f"actual.{m}").alias(f"actual_{m}") for m in MEASURES],
        *[F.col(f"absolute_error.{m}").alias(f"{m}_abs_error") for m in MEASURES],
    )


def time_range(series: DataFrame, start, end, date_col: str = "date") -> DataFrame:
    """Closed time-range filter (FLT-3); pushed into the parquet scan when ``series`` is a scan."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("timestamp_ntz")
    return series.where(F.col(date_col).between(lit(start), lit(end)))


def write_history(series: DataFrame, path: str, date_col: str = "date", unit: str = "day") -> None:
    """A series as Parquet, one folder for each stretch of time (``unit``: day, month or year)."""
    part = F.date_trunc(unit, F.col(date_col)).cast("date")
    # a stretch is written by one task at a time, but a long one may take as many as its size asks for
    series.withColumn("time_part", part).hint("rebalance", "time_part").write.partitionBy("time_part").option("compression", "zstd").parquet(path)


def read_history(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def time_ranges(spans: DataFrame, history: DataFrame, keys=(), start: str = "start", end: str = "end", date_col: str = "date", unit: str = "day") -> DataFrame:
    """The history's rows in each closed range of ``spans`` (FLT-3 for a table of requests).

    The spans are few against the history: each is spread over the stretches
    that it touches and joined by stretch (and keys), so the scan reads only
    the folders that some span needs -- Spark prunes them while the query runs.
    """
    keys = list(keys)
    step = {"day": "INTERVAL 1 DAY", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[unit]
    floor = lambda c: F.date_trunc(unit, F.col(c)).cast("date")
    touched = spans.where(F.col(start) <= F.col(end)).withColumn("time_part", F.explode(F.sequence(floor(start), floor(end), F.expr(step))))
    joined = history.join(touched, on=["time_part", *keys], how="inner")
    return joined.where(F.col(date_col).between(F.col(start), F.col(end))).drop("time_part")


def history_records(requests: DataFrame, series: DataFrame, keys=(), window_size: int = 72,
                    value_cols=None, request_col: str = "target_time", date_col: str = "date") -> DataFrame:
    """History answer per request: rows in [t - W h, t - 1 h], exact-count check (JN-3, WIN-11).

    The range join is made an equi-join on (keys, day): each request is
    exploded to the few calendar days its range touches, joined to the series
    rows of those days, filtered to the exact range and grouped back per
    request.  The group per request holds at most the rows of its range.
    Output: status ``ok`` / ``insufficient_history``, counts, bounds, and
    ``records`` (time-sorted array of structs; null unless ok).
    """
    value_cols = list(value_cols or MEASURES)
    keys = list(keys)
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    r = requests.select(*keys, F.col(request_col).cast("timestamp_ntz").alias("_t")).distinct()
    r = r.withColumns({
        "_end": F.col("_t") - F.expr("INTERVAL 1 HOUR"),
        "_start": F.col("_t") - F.make_dt_interval(hours=F.lit(window_size)),
    })
    r = r.withColumn("_day", F.explode(F.sequence(day(F.col("_start")), day(F.col("_end")), F.expr("INTERVAL 1 DAY"))))
    s = series.select(*keys, F.col(date_col).alias("_d"), *value_cols).withColumn("_day", day(F.col("_d")))
    j = r.join(s, on=keys + ["_day"], how="left")
    in_range = F.col("_d").between(F.col("_start"), F.col("_end"))
    rec = F.struct(F.col("_d").alias(date_col), *[F.col(c) for c in value_cols])
    g = j.groupBy(*keys, "_t", "_start", "_end").agg(
        F.count_if(in_range).alias("returned_records"),
        F.sort_array(F.collect_list(F.when(in_range, rec))).alias("records"),
    )
    ok = F.col("returned_records") == F.lit(window_size)
    return g.select(
        *keys,
        T.fmt_ts(F.col("_t")).alias("target_time"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("insufficient_history")).alias("status"),
        F.lit(window_size).cast("bigint").alias("expected_records"),
        F.col("returned_records").cast("bigint").alias("returned_records"),
        T.fmt_ts(F.col("_start")).alias("history_start"),
        T.fmt_ts(F.col("_end")).alias("history_end"),
        F.when(ok, F.col("records")).alias("records"),
    )
