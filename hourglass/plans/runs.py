"""Registered queries over files of several headers, run logs, late reports, time-partitioned history, lag moments and trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import clean, forecast, moments, records, requests
from ..operators import windows as W
from ..session import scratch_path
from ..sources import files
from ..sources import fixtures as fx
from ..sources.runlog import RunLog
from ..streaming.collapse import HourlyLog
from . import more as M
from . import oracle as O

MEASURES = vocab.MEASURES
REPORT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


# -- reports in several files -----------------------------------------------------------------

def _report_parts(spark: SparkSession, sf: str, parts: int) -> list[str]:
    """RAW as report CSV folders of different column orders, with other columns between them, dealt by report."""
    names = {v: k for k, v in clean.RAW_RENAMES.items()}
    raw = fx.raw_reports(spark, sf)
    measures = [F.col(m).alias(names[m]) for m in MEASURES]
    time, number, station = F.date_format("date", REPORT_TIME).alias(names["date"]), F.col("event_id").alias("REPORT_ID"), F.lit("STATION-1").alias("STATION")
    layouts = [[station, number, time, *measures], [measures[1], time, measures[2], F.lit("x").alias("REM"), measures[0], number],
               [number, *measures[::-1], station, F.lit(None).cast("string").alias("HourlyVisibility"), time]]
    paths = []
    for k in range(parts):
        paths.append(scratch_path(spark, f"reports-{k}"))
        files.write_csv(raw.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == k).select(*layouts[k % len(layouts)]), paths[-1])
    return paths


def q_reports_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Report files of three headers read by column name, then cleaned (SRC-1, SRC-2 header catalogue)."""
    back = files.read_raw_reports(spark, _report_parts(spark, sf, 3), keep=["REPORT_ID"])
    return clean.clean_hourly(back.withColumn("REPORT_ID", F.col("REPORT_ID").cast("bigint")), unique_tie="REPORT_ID")


def q_stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly series from a stream of report files that come in any order, late ones included (AGG-1 incremental)."""
    folder = scratch_path(spark, "late-reports")
    raw = fx.raw_reports(spark, sf).select(F.date_format("date", REPORT_TIME).alias("date"), "event_id", *MEASURES)
    files.write_csv(raw.repartition(6, F.xxhash64("event_id")), folder)
    stream = (spark.readStream.schema("date string, event_id bigint, " + ", ".join(f"{m} string" for m in MEASURES))
              .option("header", True).option("maxFilesPerTrigger", 2).csv(folder))
    return HourlyLog(spark, scratch_path(spark, "hourly-log"), tie_cols=["event_id"], fold_every=2).run(stream).table()


# -- a log of runs ---------------------------------------------------------------------------

def q_run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs' records in one JSONL log: one run repeated, one killed before its commit and then retried (SNK-5, SET-1)."""
    r = fx.responses(spark, sf).drop("source_system")
    log = RunLog(spark, scratch_path(spark, "run-log"), files.RESPONSE_SCHEMA, "json")
    agentic, single = r.where("system = 'agentic'"), r.where("system = 'single_tool'")
    log.append(agentic.where("case_id % 2 = 0"), "agentic")     # replaced by the whole run below
    log.append(agentic, "agentic")
    log._write(single.where("case_id % 3 = 0"))                  # files of a run that never got to its commit
    log.append(single, "single_tool")
    return records.normalise(log.read()).drop("request_time")


# -- time ranges -----------------------------------------------------------------------------

def q_time_range(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and mean temperature of a time range per nation of one region: the history's days are pruned by the ranges (FLT-3)."""
    path = scratch_path(spark, "history-by-day")
    requests.write_history(fx.series(spark, sf, with_idx=False), path)
    start = F.lit("2024-01-03 06:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("n_nationkey"))
    spans = spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey = 1").select(
        "n_nationkey", start.alias("start"), (start + F.expr("INTERVAL 36 HOURS")).alias("end"))
    rows = requests.time_ranges(spans, requests.read_history(spark, path))
    return rows.groupBy("n_nationkey").agg(F.count(F.lit(1)).cast("bigint").alias("history_rows"), F.min("date").alias("first"), F.max("date").alias("last"),
                                           F.round(F.avg("temperature"), 6).alias("temperature"))


# -- records of every shape ---------------------------------------------------------------------

def q_record_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Expected, predicted and actual values of records of four shapes, lower levels holding other values (PRJ-10, PRJ-11)."""
    c = fx.cases(spark, sf)
    shape = F.col("case_id") % 4

    def level(at, add, prefix=""):
        off = F.when(shape == at, F.lit(0.0)).otherwise(F.lit(float(add)))
        return [(F.col(f"prediction.{m}") + off).alias(f"{prefix}{m}") for m in MEASURES]

    tool = F.when(shape == 0, F.struct("forecast_target_time", *level(0, 0, "predicted_")))
    nested = F.when(shape <= 1, F.struct(*level(1, 1)))
    expected = F.when(shape <= 2, F.struct(*level(2, 2)))
    r = c.select("case_id", "forecast_target_time", tool.alias("tool_output"), nested.alias("prediction"), expected.alias("expected_prediction"),
                 F.when(shape % 2 == 0, F.col("actual")).alias("actual"), *level(3, 3, "predicted_"),
                 *[(F.col(f"actual.{m}") + F.when(shape % 2 == 1, F.lit(0.0)).otherwise(F.lit(1.0))).alias(f"actual_{m}") for m in MEASURES])
    x = r.select("case_id", records.expected_of(r).alias("e"), records.prediction_of(r).alias("p"), records.actual_of(r).alias("a"))
    return x.select("case_id", F.col("e.forecast_target_time").alias("expected_time"), *[F.round(F.col(f"{s}.{m}"), 4).alias(f"{n}_{m}")
                                                                                        for s, n in (("e", "expected"), ("p", "predicted"), ("a", "actual")) for m in MEASURES])


# -- a panel stored for its windows ---------------------------------------------------------------

KEY = ["l_suppkey"]


def _stored_panel(spark: SparkSession, sf: str) -> W.Framed:
    return W.laid_out(fx.panel(spark, sf), KEY, back=71, forward=24, chunk=500)


def q_stored_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The forecast frame of every supplier day from the stored panel: no exchange of rows (JN-1, FLT-6)."""
    f = requests.forecast_frame(_stored_panel(spark, sf), fx.PANEL_MEASURES, KEY)
    return f.select(*KEY, "date", "status", "input_window_start", "target_date", "p_l_quantity", "a_l_quantity")


def q_stored_history(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the ten days before each day of a supplier from the stored panel: no exchange of rows (WIN-11)."""
    h = W.history_counts(_stored_panel(spark, sf), KEY, hours=240, period_hours=24)
    return h.select(*KEY, "date", "history_rows", "history_complete")


def q_stored_persistence(spark: SparkSession, sf: str) -> DataFrame:
    """Persistence errors per supplier from the stored panel: only the averages are exchanged (WIN-9, WIN-10)."""
    p = W.time_split(W.persistence(_stored_panel(spark, sf), fx.PANEL_MEASURES, KEY), KEY)
    err = F.abs(F.col("y_l_quantity") - F.col("p_l_quantity"))
    return p.where("split = 'test'").groupBy(*KEY).agg(
        F.count(F.lit(1)).cast("bigint").alias("test_examples"), F.round(F.avg(err), 6).alias("quantity_mae"))


# -- models ------------------------------------------------------------------------------------

def _sizes(s: DataFrame, window: int = 72, horizon: int = 24) -> int:
    return int((s.count() - window - horizon + 1) * 0.8)


def q_lag_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Mean products of every input row with the last input row and with the target row over the training windows (ML-2)."""
    s = fx.series(spark, sf)
    g, xy, x, _ = moments.window_moments(s, MEASURES, 0.0, _sizes(s), 72, 24, chunk=100)
    m, rows = _sizes(s), []
    for k in range(72):
        rows += [(k, a, b, round(float(g[k, 71, i, j]) / m, 6), round(float(xy[k, i, j]) / m, 6), round(float(x[k, i]) / m, 6))
                 for i, a in enumerate(MEASURES) for j, b in enumerate(MEASURES)]
    return spark.createDataFrame(rows, "place bigint, input string, other string, with_last double, with_target double, input_mean double")


def q_linear_moments(spark: SparkSession, sf: str) -> DataFrame:
    """The 216-input regression from lag moments: test-split predictions (ML-2, ML-3, ML-6)."""
    s = fx.series(spark, sf)
    p = moments.predict_linear(s, moments.fit_linear(s))
    return p.where(F.col("sample_idx") >= _sizes(s)).withColumns({f"p_{m}": F.round(f"p_{m}", 4) for m in MEASURES})


def q_linear_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """For each of the 216 inputs the mean product with each residual, in parts of their spread: all 0, as least squares has it (ML-2).

    The windows are built here as arrays, apart from the moments that the fit came from.
    """
    s = fx.series(spark, sf)
    p = moments.predict_linear(s, moments.fit_linear(s)).where(F.col("sample_idx") < _sizes(s))
    x = W.train_windows(s).where(F.col("sample_idx") < _sizes(s)).select("sample_idx", "x")
    joined = x.join(p, "sample_idx").select(F.posexplode("x").alias("place", "x"), *[(F.col(f"y_{m}") - F.col(f"p_{m}")).alias(f"r_{m}") for m in MEASURES],
                                            *[f"y_{m}" for m in MEASURES])
    part = lambda a, b: F.round(F.abs(F.sum(F.col(f"x.{a}") * F.col(f"r_{b}"))) / F.sqrt(F.sum(F.col(f"x.{a}") * F.col(f"x.{a}")) * F.sum(F.col(f"y_{b}") * F.col(f"y_{b}"))), 6)
    return joined.groupBy(F.col("place").cast("bigint").alias("place")).agg(
        F.count(F.lit(1)).cast("bigint").alias("samples"), *[part(a, b).alias(f"{a}_{b}") for a in MEASURES for b in MEASURES])


def q_forest_stump(spark: SparkSession, sf: str) -> DataFrame:
    """A forest of one tree with one split, found among all thresholds of the last two rows' six inputs (ML-1, ML-3)."""
    p = forecast.model_forecast(fx.series(spark, sf), kind="forest", window=2, numTrees=1, maxDepth=1, bootstrap=False, maxBins=1 << 15)
    return p.withColumns({f"p_{m}": F.round(f"p_{m}", 4) for m in MEASURES})


QUERIES = {
    "reports_by_name": q_reports_by_name, "stream_hourly": q_stream_hourly, "run_log": q_run_log, "time_range": q_time_range,
    "record_shapes": q_record_shapes, "lag_moments": q_lag_moments, "linear_moments": q_linear_moments, "linear_residuals": q_linear_residuals,
    "forest_stump": q_forest_stump, "stored_lookup": q_stored_lookup, "stored_history": q_stored_history, "stored_persistence": q_stored_persistence,
}

_PRODUCTS = "WITH " + O.SERIES + """,
long AS (SELECT idx, n, 'temperature' AS m, 0 AS o, temperature AS v FROM series UNION ALL SELECT idx, n, 'dew_point', 1, dew_point FROM series
  UNION ALL SELECT idx, n, 'wind_speed', 2, wind_speed FROM series),
size AS (SELECT CAST(floor((max(n) - 95) * 0.8) AS BIGINT) AS samples FROM series),
x AS (SELECT k AS place, l.idx - k AS sample, m, v FROM long l, range(72) r(k), size WHERE l.idx >= k AND l.idx - k < samples)
"""

_STUMP = "WITH " + O.SERIES + """,
s AS (SELECT idx, n, temperature AS t0, dew_point AS d0, wind_speed AS w0, lead(temperature) OVER o AS t1, lead(dew_point) OVER o AS d1, lead(wind_speed) OVER o AS w1,
        lead(date, 25) OVER o AS target_date, lead(temperature, 25) OVER o AS y_temperature, lead(dew_point, 25) OVER o AS y_dew_point,
        lead(wind_speed, 25) OVER o AS y_wind_speed FROM series WINDOW o AS (ORDER BY idx)),
rows AS (SELECT *, idx < floor((n - 25) * 0.8) AS train FROM s WHERE target_date IS NOT NULL),
inputs AS (SELECT idx, train, unnest(range(6)) AS f, unnest([t0, d0, w0, t1, d1, w1]) AS v FROM rows),
ys AS (SELECT idx, unnest(['temperature', 'dew_point', 'wind_speed']) AS m, unnest([y_temperature, y_dew_point, y_wind_speed]) AS y FROM rows),
steps AS (SELECT m, f, v, count(*) AS c, sum(y) AS sy FROM inputs JOIN ys USING (idx) WHERE train GROUP BY 1, 2, 3),
cuts AS (
  SELECT m, f, v, lead(v) OVER w AS next, sum(c) OVER w AS lc, sum(sy) OVER w AS ls, sum(c) OVER (PARTITION BY m, f) AS tc, sum(sy) OVER (PARTITION BY m, f) AS ts
  FROM steps WINDOW w AS (PARTITION BY m, f ORDER BY v)),
best AS (
  SELECT m, f, (v + next) / 2 AS cut, ls / lc AS below, (ts - ls) / (tc - lc) AS above FROM cuts WHERE next IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY m ORDER BY ls * ls / lc + (ts - ls) * (ts - ls) / (tc - lc) DESC, f, v) = 1),
guess AS (SELECT i.idx, b.m, CASE WHEN i.v <= b.cut THEN b.below ELSE b.above END AS p FROM inputs i JOIN best b USING (f) WHERE NOT i.train)
SELECT idx AS sample_idx, target_date, y_temperature, y_dew_point, y_wind_speed, """ + ", ".join(
    f"round((SELECT p FROM guess g WHERE g.idx = rows.idx AND g.m = '{m}'), 4) AS p_{m}" for m in MEASURES) + " FROM rows WHERE NOT train"

SQL = {
    "reports_by_name": O.SQL["clean_hourly"],
    "stream_hourly": O.SQL["clean_hourly"],
    "run_log": "WITH " + O.RESPONSES + """
SELECT case_id, system, forecast_target_time AS expected_time, p_t AS expected_temperature, p_d AS expected_dew_point,
  p_w AS expected_wind_speed, response FROM responses""",
    "time_range": "WITH " + O.SERIES + """
SELECT n_nationkey, count(*) AS history_rows, min(date) AS first, max(date) AS last, round(avg(temperature), 6) AS temperature
FROM nation JOIN series ON date BETWEEN TIMESTAMP '2024-01-03 06:00:00' + to_days(CAST(n_nationkey AS INTEGER))
  AND TIMESTAMP '2024-01-04 18:00:00' + to_days(CAST(n_nationkey AS INTEGER))
WHERE n_regionkey = 1 GROUP BY 1""",
    "record_shapes": "WITH " + O.CASES + "SELECT case_id, forecast_target_time AS expected_time, " + ", ".join(
        f"round(p_{y}, 4) AS expected_{m}, round(p_{y} + CASE WHEN case_id % 4 = 0 THEN 1 WHEN case_id % 4 = 2 THEN 3 ELSE 0 END, 4) AS predicted_{m}, "
        f"round(a_{y}, 4) AS actual_{m}" for y, m in zip("tdw", MEASURES)) + " FROM cases",
    "lag_moments": _PRODUCTS + """
SELECT a.place, a.m AS input, b.m AS other, round(sum(a.v * b.v) / count(*), 6) AS with_last, round(sum(a.v * t.v) / count(*), 6) AS with_target,
  round(avg(a.v), 6) AS input_mean
FROM x a JOIN x b ON b.sample = a.sample AND b.place = 71 JOIN long t ON t.idx = a.sample + 95 AND t.m = b.m GROUP BY 1, 2, 3""",
    "linear_residuals": "WITH " + O.SERIES + "SELECT place, CAST(floor((max(n) - 95) * 0.8) AS BIGINT) AS samples, " + ", ".join(
        f"CAST(0 AS DOUBLE) AS {a}_{b}" for a in MEASURES for b in MEASURES) + " FROM series, range(72) r(place) GROUP BY 1 HAVING max(n) > 96",
    "forest_stump": _STUMP,
    "stored_lookup": M.SQL["panel_lookup"],
    "stored_history": M.SQL["panel_history"],
    "stored_persistence": M.SQL["panel_persistence"],
}
