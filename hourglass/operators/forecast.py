"""Forecast models on window features with Spark ML (ML-1..8, SNK-7).

Spark ML regressors are single-output, so the three measures are three
stages of one ``Pipeline`` (one saved ``PipelineModel``).  Features are the
72-row window flattened time-major into a 216-vector; arrays are built only
for the rows that are fitted or scored.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import StorageLevel

from ..functions import vocab
from . import windows as W

MEASURES = vocab.MEASURES
#: Training rows that one task of a tree fit reads at least.
ROWS_PER_TASK = 5_000


def features(samples: DataFrame, value_cols=None) -> DataFrame:
    """Window array ``x`` -> ``features`` vector (WIN-8)."""
    value_cols = list(value_cols or MEASURES)
    return samples.withColumn("features", array_to_vector(W.flatten_window(F.col("x"), value_cols))).drop("x")


def training_frame(series: DataFrame, keys=(), window: int = 72, horizon: int = 24, ratio: float = 0.8) -> DataFrame:
    """Training-alignment samples with features, labels ``y_*`` and ``split`` (WIN-3, WIN-8, WIN-9)."""
    w = W.train_windows(series, keys=keys, window=window, horizon=horizon)
    return features(W.time_split(w, keys=keys, ratio=ratio))


def estimator(kind: str, label: str, pred: str, **params):
    if kind == "forest":
        p = {"numTrees": 100, "seed": 42, "featureSubsetStrategy": "all", "maxDepth": 30, "maxBins": 32,
             "maxMemoryInMB": 256, "cacheNodeIds": True}
        p.update(params)
        return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol=pred, **p)
    if kind == "linear":
        p = {"regParam": 0.0, "elasticNetParam": 0.0, "solver": "normal"}
        p.update(params)
        return LinearRegression(featuresCol="features", labelCol=label, predictionCol=pred, **p)
    raise ValueError(f"unknown model kind {kind!r}")


def _dealt(train: DataFrame) -> tuple[DataFrame, int]:
    """Training rows in as many partitions as their number asks for, and how many those are.

    A tree fit holds and shuffles the split statistics of every open node for
    each partition, empty ones too, so they are dealt by rows, not by the
    session's shuffle partitions.  Ranges of the sample columns, sorted: the
    bootstrap depends on a row's partition and place, and so on nothing else.
    """
    place = [c for c in train.columns if c != "features"]
    n = -(-max(train.count(), 1) // ROWS_PER_TASK)
    return train.repartitionByRange(n, *place).sortWithinPartitions(*place), n


def fit(train: DataFrame, kind: str = "forest", value_cols=None, concurrent: bool | None = None, **params) -> PipelineModel:
    """Fit one regressor per measure (ML-1 forest, ML-2 linear) as one pipeline model.

    The training rows are persisted (memory and disk) for the passes the fits
    make and released afterwards.  The per-measure fits are independent; with
    ``concurrent`` they are submitted from separate threads so their jobs share
    the cluster.  Each tree fit holds ``maxMemoryInMB`` of split statistics per
    task, and concurrent fits multiply that: by default forests are fitted at
    once where all their tasks together do not fill the cluster's cores.
    """
    from concurrent.futures import ThreadPoolExecutor

    value_cols = list(value_cols or MEASURES)
    stages = [estimator(kind, f"y_{c}", f"p_{c}", **params) for c in value_cols]
    if kind == "forest":
        train, parts = _dealt(train)
        if concurrent is None:
            concurrent = parts * len(stages) <= train.sparkSession.sparkContext.defaultParallelism
    data = train.select("features", *[f"y_{c}" for c in value_cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if concurrent and len(stages) > 1:
            with ThreadPoolExecutor(max_workers=len(stages)) as pool:
                models = list(pool.map(lambda est: est.fit(data), stages))
        else:
            models = [est.fit(data) for est in stages]
    finally:
        data.unpersist()
    return PipelineModel(stages=models)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Batch prediction (ML-3)."""
    return model.transform(df)


def save(model: PipelineModel, path: str) -> None:
    """SNK-7 save (overwrite)."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """SNK-7 load."""
    return PipelineModel.load(path)


def model_forecast(series: DataFrame, kind: str = "forest", keys=(), window: int = 72, horizon: int = 24, **params) -> DataFrame:
    """Fit on the train split, predict the test split (ML-6 predictions table); ``params`` go to the regressor."""
    frame = training_frame(series, keys=keys, window=window, horizon=horizon)
    model = fit(frame.where(F.col("split") == "train"), kind, **params)
    pred = predict(model, frame.where(F.col("split") == "test"))
    return pred.select(*keys, "sample_idx", "target_date", *[f"y_{m}" for m in MEASURES], *[f"p_{m}" for m in MEASURES])


def model_cases(model: PipelineModel, samples: DataFrame, series: DataFrame, keys=(), window: int = 72,
                horizon: int = 24) -> DataFrame:
    """Cases scored by a fitted model at sampled rows (ML-5 / ML-8): inputs r-W .. r-1, target r+H."""
    keys = list(keys)
    w = W.verify_windows(series, keys=keys, window=window, horizon=horizon)
    j = samples.select(*keys, "idx", "case_id").join(w, on=keys + ["idx"], how="inner")
    return predict(model, features(j))


def model_eval_cases(model: PipelineModel, samples: DataFrame, series: DataFrame, keys=(), window: int = 72,
                     horizon: int = 24) -> DataFrame:
    """Nested evaluation cases with model predictions, values rounded to 2 (ML-5)."""
    from ..functions.text import fmt_ts

    s = model_cases(model, samples, series, keys, window, horizon)
    r2 = lambda c: F.round(c, 2)
    return s.select(
        *keys, "case_id", fmt_ts(F.col("date")).alias("request_time"),
        fmt_ts(F.col("target_date")).alias("forecast_target_time"),
        F.struct(*[r2(F.col(f"p_{m}")).alias(m) for m in MEASURES]).alias("prediction"),
        F.struct(*[r2(F.col(f"y_{m}")).alias(m) for m in MEASURES]).alias("actual"),
        F.struct(*[r2(F.abs(F.col(f"p_{m}") - F.col(f"y_{m}"))).alias(m) for m in MEASURES]).alias("absolute_error"),
    )


def verify_model(model: PipelineModel, series: DataFrame, keys=(), window: int = 72, horizon: int = 24,
                 ratio: float = 0.8) -> DataFrame:
    """Re-verify a saved model on the verification alignment (ML-7, WIN-4, AGG-9).

    Windows i-W .. i-1 with target i+H; the last ``1 - ratio`` of them (per
    key) are scored; returns one row of MAE per measure, their average and
    the test size.
    """
    from .accuracy import error_metrics

    keys = list(keys)
    w = W.verify_windows(series, keys=keys, window=window, horizon=horizon).withColumn("sample_idx", F.col("idx") - window)
    test = W.time_split(w, keys=keys, ratio=ratio).where(F.col("split") == "test")
    m = error_metrics(predict(model, features(test)))
    return m.select(*[f"{c}_mae" for c in MEASURES], "average_mae", "test_examples")


def single_forecast_check(model: PipelineModel, series: DataFrame, keys=(), window: int = 72, horizon: int = 24,
                          at: float = 0.85) -> DataFrame:
    """One known-safe forecast per key at ``max(int(n * at), W)`` (ML-8), unrounded values.

    Returns no row for a key whose target row would fall past the end.
    """
    keys = list(keys)
    pick = series.groupBy(*keys).agg(F.max("n").alias("n")).select(
        *keys, F.greatest(F.floor(F.col("n").cast("double") * F.lit(float(at))), F.lit(window)).cast("bigint").alias("idx"))
    samples = pick.withColumn("case_id", F.lit(1).cast("bigint"))
    scored = model_cases(model, samples, series, keys=keys, window=window, horizon=horizon)
    from ..functions.text import fmt_ts

    return scored.select(
        *keys, fmt_ts(F.col("date")).alias("request_time"), fmt_ts(F.col("target_date")).alias("forecast_target_time"),
        F.struct(*[F.col(f"p_{m}").alias(m) for m in MEASURES]).alias("prediction"),
        F.struct(*[F.col(f"y_{m}").alias(m) for m in MEASURES]).alias("actual"),
        F.struct(*[F.abs(F.col(f"p_{m}") - F.col(f"y_{m}")).alias(m) for m in MEASURES]).alias("absolute_error"),
    )


def model_requests(model: PipelineModel, requests: DataFrame, series: DataFrame, keys=(), window: int = 72,
                   horizon: int = 24, request_col: str = "request_time") -> DataFrame:
    """Batch of single-request predictions with a fitted model (ML-4, UDF-4).

    Like :func:`requests.request_lookup` (statuses not_found / no_history /
    no_future), but the prediction comes from the model on the window
    r-W+1 .. r ending at the request row.
    """
    from ..functions.text import fmt_ts

    keys = list(keys)
    w = W.window_samples(series, keys=keys, window=window, horizon=horizon, include_request_row=True)
    scored = predict(model, features(w))
    r = requests.select(*keys, F.col(request_col).cast("timestamp_ntz").alias("_rt"))
    s = series.select(*keys, F.col("date").alias("_rt"), "idx", "n")
    j = r.join(s, on=keys + ["_rt"], how="left").join(
        scored.select(*keys, "idx", "target_date", *[f"p_{m}" for m in MEASURES], *[f"y_{m}" for m in MEASURES]),
        on=keys + ["idx"], how="left")
    status = (F.when(F.col("idx").isNull(), F.lit("not_found"))
              .when(F.col("idx") < F.lit(window - 1), F.lit("no_history"))
              .when(F.col("idx") + F.lit(horizon) >= F.col("n"), F.lit("no_future"))
              .otherwise(F.lit("ok")))
    err = {m: F.abs(F.col(f"p_{m}") - F.col(f"y_{m}")) for m in MEASURES}
    return j.select(
        *keys, fmt_ts(F.col("_rt")).alias("request_time"), status.alias("status"),
        fmt_ts(F.col("target_date")).alias("forecast_target_time"),
        *[F.round(F.col(f"p_{m}"), 2).alias(f"predicted_{m}") for m in MEASURES],
        *[F.round(F.col(f"y_{m}"), 2).alias(f"actual_{m}") for m in MEASURES],
        *[F.round(err[m], 2).alias(f"{m}_abs_error") for m in MEASURES],
        F.round((err["temperature"] + err["dew_point"] + err["wind_speed"]) / F.lit(3.0), 2).alias("average_abs_error"),
    )
