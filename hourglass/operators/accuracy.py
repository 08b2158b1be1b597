"""Forecast accuracy: per-case error rows, summaries, MAE / RMSE (FN-1..5, AGG-2/3/9/10/11).

Every summary is a single global aggregate (partial per task, one final
merge of a few numbers), so it scales with the data and never gathers rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from .records import actual_of, field, prediction_of

MEASURES = vocab.MEASURES


def case_scores(records: DataFrame, digits: int = 4) -> DataFrame:
    """One accuracy row per case (FN-5): predicted, actual, abs error per measure, mean error.

    Prediction / actual are read nested or flat (PRJ-10); outputs rounded to ``digits``.
    """
    x = records.select(
        field(records, "case_id", "bigint").alias("case_id"),
        field(records, "request_time", "string").alias("request_time"),
        field(records, "forecast_target_time", "string").alias("forecast_target_time"),
        prediction_of(records).alias("_p"), actual_of(records).alias("_a"),
    )
    err = {m: F.abs(F.col(f"_p.{m}") - F.col(f"_a.{m}")) for m in MEASURES}
    cols = []
    for m in MEASURES:
        cols += [F.round(F.col(f"_p.{m}"), digits).alias(f"predicted_{m}"),
                 F.round(F.col(f"_a.{m}"), digits).alias(f"actual_{m}"),
                 F.round(err[m], digits).alias(f"{m}_abs_error")]
    mean_err = (err["temperature"] + err["dew_point"] + err["wind_speed"]) / F.lit(3.0)
    return x.select("case_id", "request_time", "forecast_target_time", *cols,
                    F.round(mean_err, digits).alias("average_abs_error"))


def summarize_cases(scores: DataFrame, system: str = "ml_baseline", digits: int = 4) -> DataFrame:
    """Count, means and maxima of the already-rounded case errors (AGG-3, AGG-2: empty -> 0.0)."""
    names = [f"{m}_abs_error" for m in MEASURES] + ["average_abs_error"]
    mae_names = [f"{m}_mae" for m in MEASURES] + ["average_mae"]
    max_names = [f"max_{m}_abs_error" for m in MEASURES] + ["max_average_abs_error"]
    return scores.agg(
        F.count(F.lit(1)).alias("total_cases"),
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits).alias(n) for c, n in zip(names, mae_names)],
        *[F.round(F.max(c), digits).alias(n) for c, n in zip(names, max_names)],
    ).select(F.lit(system).alias("system"), "*")


def error_metrics(pred: DataFrame, y_prefix: str = "y_", p_prefix: str = "p_", value_cols=None) -> DataFrame:
    """MAE and RMSE per measure plus the plain average of each (AGG-9, AGG-10), one pass."""
    value_cols = list(value_cols or MEASURES)
    aggs = []
    for c in value_cols:
        d = F.col(f"{y_prefix}{c}") - F.col(f"{p_prefix}{c}")
        aggs += [F.avg(F.abs(d)).alias(f"{c}_mae"), F.sqrt(F.avg(d * d)).alias(f"{c}_rmse")]
    out = pred.agg(*aggs, F.count(F.lit(1)).alias("test_examples"))
    k = F.lit(float(len(value_cols)))
    return out.withColumns({
        "average_mae": sum((F.col(f"{c}_mae") for c in value_cols), F.lit(0.0)) / k,
        "average_rmse": sum((F.col(f"{c}_rmse") for c in value_cols), F.lit(0.0)) / k,
    })


def metrics_long(metrics: DataFrame, value_cols=None) -> DataFrame:
    """Wide metrics row -> (target, mae, rmse), one row per measure plus ``average`` (AGG-11)."""
    targets = list(value_cols or MEASURES) + ["average"]
    return metrics.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"{t}_mae").alias("mae"), F.col(f"{t}_rmse").alias("rmse"))
        for t in targets
    ])).alias("m")).select("m.*")
