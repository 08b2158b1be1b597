"""Registered model queries.

The full-size fits have no SQL (tests hold them to rows and error bands).  The
small ones (window of one row: three inputs and an intercept) are solved in
SQL too: least squares by Cramer's rule on the covariances, and a forest of one tree
without splits as the training means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import forecast, requests, sampling
from ..session import scratch_path
from ..sources import fixtures as fx
from . import oracle as O

MEASURES = vocab.MEASURES
NUM_CASES = 1000


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in df.columns if c.startswith("p_")})


def q_linear_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-output linear regression on the 216 window features, test-split predictions (ML-2/3/6)."""
    return _rounded(forecast.model_forecast(fx.series(spark, sf), kind="linear"))


def q_forest_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Random forest per measure (100 trees, seed 42, all features per split), test-split predictions (ML-1/3/6)."""
    return _rounded(forecast.model_forecast(fx.series(spark, sf), kind="forest"))


def q_linear_small(spark: SparkSession, sf: str) -> DataFrame:
    """Linear regression on a window of one row, test-split predictions (ML-2, ML-3, ML-6)."""
    return _rounded(forecast.model_forecast(fx.series(spark, sf), kind="linear", window=1))


def q_forest_mean(spark: SparkSession, sf: str) -> DataFrame:
    """A forest of one tree without splits or resampling: the training means (ML-1, ML-3)."""
    return _rounded(forecast.model_forecast(fx.series(spark, sf), kind="forest", window=1, numTrees=1, maxDepth=0, bootstrap=False))


def _small_model(spark: SparkSession, series: DataFrame):
    """The one-row linear model, saved and loaded again (SNK-7)."""
    frame = forecast.training_frame(series, window=1)
    path = scratch_path(spark, "model")
    forecast.save(forecast.fit(frame.where("split = 'train'"), "linear"), path)
    return forecast.load(path)


def q_model_verify(spark: SparkSession, sf: str) -> DataFrame:
    """A saved model's errors on the verification alignment (ML-7, SNK-7)."""
    s = fx.series(spark, sf)
    v = forecast.verify_model(_small_model(spark, s), s, window=1)
    return v.select(*[F.round(f"{c}_mae", 4).alias(f"{c}_mae") for c in (*MEASURES, "average")],
                    F.col("test_examples").cast("bigint").alias("test_examples"))


def q_model_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation cases with a model's predictions (ML-5, PRJ-7)."""
    s = fx.series(spark, sf)
    at = sampling.even_positions(sampling.series_lengths(s), NUM_CASES, window=1)
    return requests.flatten_case(forecast.model_eval_cases(_small_model(spark, s), at, s, window=1))


def q_model_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every request answered by a model (ML-4, UDF-4)."""
    s = fx.series(spark, sf)
    return forecast.model_requests(_small_model(spark, s), fx.requests(spark, sf, s), s, window=1)


def q_single_check(spark: SparkSession, sf: str) -> DataFrame:
    """One forecast at 85 % of the series (ML-8)."""
    s = fx.series(spark, sf)
    c = forecast.single_forecast_check(_small_model(spark, s), s, window=1)
    return c.select("request_time", "forecast_target_time",
                    *[F.round(F.col(f"{k}.{m}"), 4).alias(f"{k}_{m}") for k in ("prediction", "actual", "absolute_error") for m in MEASURES])


MODEL_QUERIES = {
    "linear_forecast": q_linear_forecast,
    "forest_forecast": q_forest_forecast,
    "linear_small": q_linear_small,
    "forest_mean": q_forest_mean,
    "model_verify": q_model_verify,
    "model_cases": q_model_cases,
    "model_requests": q_model_requests,
    "single_check": q_single_check,
}

_TRAIN = "WITH " + O.SERIES + """,
s AS (SELECT idx, n, date, temperature AS t, dew_point AS d, wind_speed AS w, lead(date, 24) OVER o AS target_date,
        lead(temperature, 24) OVER o AS y_t, lead(dew_point, 24) OVER o AS y_d, lead(wind_speed, 24) OVER o AS y_w
      FROM series WINDOW o AS (ORDER BY idx)),
train AS (SELECT * FROM s WHERE target_date IS NOT NULL AND idx < floor((n - 24) * 0.8))"""


def _least_squares() -> str:
    """CTEs: moments of the training rows, then intercept and three slopes per measure."""
    pairs = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in ("tt", "td", "tw", "dd", "dw", "ww"))
    ys = ", ".join(f"avg(y_{y}) AS m_{y}, covar_pop(t, y_{y}) AS ty_{y}, covar_pop(d, y_{y}) AS dy_{y}, covar_pop(w, y_{y}) AS wy_{y}" for y in "tdw")
    slopes = ", ".join(
        f"(ty_{y} * (dd * ww - dw * dw) - td * (dy_{y} * ww - dw * wy_{y}) + tw * (dy_{y} * dw - dd * wy_{y})) / det AS t_{y}, "
        f"(tt * (dy_{y} * ww - dw * wy_{y}) - ty_{y} * (td * ww - dw * tw) + tw * (td * wy_{y} - dy_{y} * tw)) / det AS d_{y}, "
        f"(tt * (dd * wy_{y} - dw * dy_{y}) - td * (td * wy_{y} - dy_{y} * tw) + ty_{y} * (td * dw - dd * tw)) / det AS w_{y}"
        for y in "tdw")
    return f""",
moments AS (SELECT avg(t) AS mt, avg(d) AS md, avg(w) AS mw, {pairs}, {ys} FROM train),
dets AS (SELECT *, tt * (dd * ww - dw * dw) - td * (td * ww - dw * tw) + tw * (td * dw - dd * tw) AS det FROM moments),
line AS (SELECT *, {slopes} FROM dets)"""


def _at(x: str, y: str) -> str:
    """The line's value for measure ``y`` at the inputs of row alias ``x``."""
    return f"(m_{y} + t_{y} * ({x}.t - mt) + d_{y} * ({x}.d - md) + w_{y} * ({x}.w - mw))"


_NAMES = dict(zip("tdw", MEASURES))
_FIT = _TRAIN + _least_squares()
_CASE_ROWS = _FIT + ", rows AS (SELECT v.idx, v.n, v.date, v.target_date, v.y_t, v.y_d, v.y_w, " + ", ".join(
    f"{_at('b', y)} AS p_{y}" for y in "tdw") + " FROM s v JOIN s b ON b.idx = v.idx - 1, line WHERE v.target_date IS NOT NULL)"
_EVEN = O.EVEN[len(O.SERIES):].replace("72", "1")

SQL = {
    "linear_small": _FIT + "SELECT s.idx AS sample_idx, s.target_date, " + ", ".join(
        f"y_{y} AS y_{m}, round({_at('s', y)}, 4) AS p_{m}" for y, m in _NAMES.items())
    + " FROM s, line WHERE target_date IS NOT NULL AND idx >= floor((n - 24) * 0.8)",
    "forest_mean": _TRAIN + ", means AS (SELECT avg(y_t) AS m_t, avg(y_d) AS m_d, avg(y_w) AS m_w FROM train) "
    "SELECT s.idx AS sample_idx, s.target_date, " + ", ".join(f"y_{y} AS y_{m}, round(m_{y}, 4) AS p_{m}" for y, m in _NAMES.items())
    + " FROM s, means WHERE target_date IS NOT NULL AND idx >= floor((n - 24) * 0.8)",
    "model_verify": _CASE_ROWS + ", e AS (SELECT avg(abs(y_t - p_t)) AS t, avg(abs(y_d - p_d)) AS d, avg(abs(y_w - p_w)) AS w, count(*) AS c "
    "FROM rows WHERE idx - 1 >= floor((n - 25) * 0.8)) SELECT round(t, 4) AS temperature_mae, round(d, 4) AS dew_point_mae, "
    "round(w, 4) AS wind_speed_mae, round((t + d + w) / 3.0, 4) AS average_mae, CAST(c AS BIGINT) AS test_examples FROM e",
    "model_cases": _CASE_ROWS + _EVEN + " SELECT case_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS request_time, "
    "strftime(target_date, '%Y-%m-%d %H:%M:%S') AS forecast_target_time, " + ", ".join(
        f"round(p_{y}, 2) AS predicted_{m}, round(y_{y}, 2) AS actual_{m}, round(abs(p_{y} - y_{y}), 2) AS {m}_abs_error"
        for y, m in _NAMES.items()) + " FROM sample JOIN rows USING (idx)",
    "model_requests": _FIT + "," + O.REQS + ", scored AS (SELECT s.*, " + ", ".join(f"{_at('s', y)} AS p_{y}" for y in "tdw")
    + """ FROM s, line WHERE s.target_date IS NOT NULL)
SELECT strftime(r.request_time, '%Y-%m-%d %H:%M:%S') AS request_time,
  CASE WHEN f.idx IS NULL THEN 'not_found' WHEN f.target_date IS NULL THEN 'no_future' ELSE 'ok' END AS status,
  strftime(q.target_date, '%Y-%m-%d %H:%M:%S') AS forecast_target_time, """ + ", ".join(
        f"round(q.p_{y}, 2) AS predicted_{m}, round(q.y_{y}, 2) AS actual_{m}, round(abs(q.p_{y} - q.y_{y}), 2) AS {m}_abs_error"
        for y, m in _NAMES.items()) + """,
  round((abs(q.p_t - q.y_t) + abs(q.p_d - q.y_d) + abs(q.p_w - q.y_w)) / 3.0, 2) AS average_abs_error
FROM reqs r LEFT JOIN s f ON f.date = r.request_time LEFT JOIN scored q ON q.idx = f.idx""",
    "single_check": _CASE_ROWS + " SELECT strftime(date, '%Y-%m-%d %H:%M:%S') AS request_time, "
    "strftime(target_date, '%Y-%m-%d %H:%M:%S') AS forecast_target_time, " + ", ".join(
        f"round(p_{y}, 4) AS prediction_{m}, round(y_{y}, 4) AS actual_{m}, round(abs(p_{y} - y_{y}), 4) AS absolute_error_{m}"
        for y, m in _NAMES.items()) + " FROM rows WHERE idx = greatest(CAST(floor(n * 0.85) AS BIGINT), 1)",
}
