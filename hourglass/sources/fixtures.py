"""Mappings of the driver's parquet tables onto the engine's input shapes.

RAW       irregular reports from ``events`` (several per hour, some unparsable)
SERIES    RAW cleaned to one row per hour, with row position
PANEL     one row per (supplier, day) from ``lineitem``, with row position
CASES     evaluation cases from ``orders``
RESPONSES two text answers per case (verified template + generated variants)
REQUESTS  forecast requests: every SERIES hour plus one time outside the range

These are definitions over whole tables: every row of the source is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..functions.answers import render_template
from ..operators import clean, position
from ..session import materialize
from .tables import read_table


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW: ``date``, three text measures and ``event_id`` (order inside the hour)."""
    return raw_from(read_table(spark, sf_dir, "events"))


def raw_from(ev: DataFrame) -> DataFrame:
    """The RAW mapping on any frame with the ``events`` columns (batch or streaming)."""
    return ev.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp_ntz").alias("date"),
        F.when(F.col("event_type") == "error", F.concat(F.col("value").cast("string"), F.lit("s")))
        .otherwise(F.col("value").cast("string")).alias("temperature"),
        F.get_json_object(F.col("props"), "$.k").alias("dew_point"),
        (F.col("user_id") % 40).cast("string").alias("wind_speed"),
    )


def raw_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """RAW as a file stream over the ``events`` parquet (schema taken from the table)."""
    import os

    schema = read_table(spark, sf_dir, "events").schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return raw_from(src.parquet(os.path.join(sf_dir, "events*.parquet")))


def series(spark: SparkSession, sf_dir: str, with_idx: bool = True, materialized: bool = True) -> DataFrame:
    """SERIES: the clean hourly table (``date``, 3 measures), with ``idx`` and ``n``.

    ``materialized``: the collapse is written once, in ranges of equal size, to
    the checkpoint folder, and the indexed table is written once more for plans
    that use it in several branches.
    """
    s = clean.clean_hourly(raw_reports(spark, sf_dir), unique_tie="event_id")
    if not with_idx:
        return s
    if not materialized:
        return position.with_position(s, ["date"])
    return materialize(position.range_positions(s, ["date"]), "series")


PANEL_MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


def panel(spark: SparkSession, sf_dir: str, with_idx: bool = True, materialized: bool = True) -> DataFrame:
    """PANEL: last value per (l_suppkey, day), ties by order key, line and part, which tell the rows of a key and day apart."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("timestamp_ntz").alias("date"),
        "l_orderkey", "l_linenumber", "l_partkey", *PANEL_MEASURES,
    )
    p = clean.last_per_period(li, "date", PANEL_MEASURES, keys=["l_suppkey"],
                              unique_tie=[("l_orderkey", 13), ("l_linenumber", 3), ("l_partkey", 11)], period="day")
    if not with_idx:
        return p
    if materialized:
        return position.range_positions(p, ["date"], keys=["l_suppkey"])
    return position.with_position(p, ["date"], keys=["l_suppkey"], unit="month")


def cases(spark: SparkSession, sf_dir: str, extra=()) -> DataFrame:
    """CASES in the nested evaluation-case shape (``extra`` order columns carried along)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", *extra)
    d = F.col("o_orderdate").cast("timestamp_ntz")
    pred = F.struct(
        F.col("o_totalprice").cast("double").alias("temperature"),
        ((F.col("o_custkey") % 1000) / F.lit(10.0)).alias("dew_point"),
        ((F.col("o_orderkey") % 300) / F.lit(10.0)).alias("wind_speed"),
    )
    act = F.struct(
        F.lit(250000.0).alias("temperature"),
        ((F.col("o_custkey") % 970) / F.lit(10.0)).alias("dew_point"),
        ((F.col("o_orderkey") % 290) / F.lit(10.0)).alias("wind_speed"),
    )
    c = o.select(
        F.col("o_orderkey").cast("bigint").alias("case_id"),
        T.fmt_ts(d).alias("request_time"),
        T.fmt_ts(d + F.expr("INTERVAL 24 HOURS")).alias("forecast_target_time"),
        pred.alias("prediction"),
        act.alias("actual"),
        *extra,
    )
    return c.withColumn("absolute_error", F.struct(*[
        F.round(F.abs(F.col(f"prediction.{m}") - F.col(f"actual.{m}")), 2).alias(m) for m in vocab.MEASURES
    ]))


def tool_output(c: DataFrame) -> DataFrame:
    return c.withColumn("tool_output", F.struct(
        F.col("request_time"), F.col("forecast_target_time"),
        *[F.col(f"prediction.{m}").alias(f"predicted_{m}") for m in vocab.MEASURES],
    ))


def single_tool_text(t, x, y, z, variant) -> "F.Column":
    """Generated-answer stand-in: ten text variants chosen by ``variant`` (0..9)."""
    v2 = lambda t_, x_, y_, z_: render_template(vocab.VERIFIED_V2, t=t_, x=x_, y=y_, z=z_)
    fx, fy, fz = T.fmt_num(x), T.fmt_num(y), T.fmt_num(z)
    return (
        F.when(variant == 0, v2(t, fx, fy, fz))
        .when(variant == 1, render_template(vocab.VERIFIED_V1, t=t, x=fx, y=fy, z=fz))
        .when(variant == 2, v2(t, T.fmt_num(F.round(x + F.lit(1.0), 2)), fy, fz))
        .when(variant == 3, F.concat(F.lit("The forecast target time is "), t, F.lit(". The predicted temperature is "), fx,
                                     F.lit("°F. The predicted dew point is "), fy, F.lit("°F.")))
        .when(variant == 4, v2(F.replace(t, F.lit(" "), F.lit("T")), fx, fy, fz))
        .when(variant == 5, v2(F.replace(t, F.lit(" "), F.lit("  ")), fx, fy, fz))
        .when(variant == 6, F.concat(v2(t, fx, fy, fz), F.lit(" Expect rain and humidity.")))
        .when(variant == 7, F.concat(F.lit("At "), t, F.lit(": "), fx, F.lit(", "), fy, F.lit(", "), fz))
        .when(variant == 8, F.concat(F.lit("forecast_target_time: "), t, F.lit("\npredicted_temperature: "), fx,
                                     F.lit("\npredicted_dew_point: "), fy, F.lit("\npredicted_wind_speed: "), fz,
                                     F.lit("\nabsolute_error: not reported")))
        .otherwise(F.concat(F.lit("The forecast target time is "), t, F.lit(". The predicted temperature is\n"), fx,
                            F.lit("°F. The predicted dew point is\n"), T.fmt_num(F.round(y + F.lit(0.05), 2)),
                            F.lit("°F. The predicted wind speed is\n"), fz, F.lit(" mph.")))
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RESPONSES: one verified (agentic) and one generated (single_tool) record per case."""
    from ..operators.answers import verified_run, user_request

    c = tool_output(cases(spark, sf_dir))
    agentic = verified_run(c)
    to = F.col("tool_output")
    single = c.select(
        F.lit("single_tool").alias("system"),
        F.lit("single_tool_local_model").alias("system_type"),
        "case_id", "request_time", "forecast_target_time", "tool_output", "prediction", "actual", "absolute_error",
        user_request(F.col("request_time")).alias("user_request"),
        single_tool_text(to["forecast_target_time"], to["predicted_temperature"], to["predicted_dew_point"],
                         to["predicted_wind_speed"], F.col("case_id") % 10).alias("llm_response"),
    )
    return agentic.unionByName(single, allowMissingColumns=True)


def requests(spark: SparkSession, sf_dir: str, s: DataFrame | None = None) -> DataFrame:
    """REQUESTS: every SERIES hour plus one timestamp one day after the range (not found)."""
    s = s if s is not None else series(spark, sf_dir, with_idx=False)
    hours = s.select(F.col("date").alias("request_time"))
    outside = s.agg((F.max("date") + F.expr("INTERVAL 24 HOURS")).alias("request_time"))
    return hours.unionByName(outside)
