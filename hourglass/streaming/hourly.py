"""Structured Streaming forms of the hourly collapse and of answer scoring.

* :func:`hourly_stream` -- AGG-1 on an unbounded report stream: event-time
  watermark, one-hour tumbling windows, ``max_by`` with a masked ordering key
  (last non-null per column).  Append mode emits an hour once the watermark
  passes its end; state is bounded by the watermark delay.
* :func:`score_stream` -- FN-20 on arriving response records: stateless, so
  each micro-batch is scored independently.

Both return streaming DataFrames; the caller picks sink, trigger and the
checkpoint location (a shared folder on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import vocab
from ..operators import clean, records


def hourly_stream(reports: DataFrame, time_col: str = "date", value_cols=None, tie_cols=(), keys=(),
                  delay: str = "2 hours") -> DataFrame:
    """Streaming hourly collapse; ``reports`` is a streaming frame of raw (text) reports.

    The watermark needs a TIMESTAMP column, so the naive time is read as UTC
    wall clock for event-time bookkeeping and the output is cast back.
    """
    value_cols = list(value_cols or vocab.MEASURES)
    c = clean.coerce_reports(reports, time_col, value_cols)
    c = c.withColumns({v: F.when(~F.isnan(F.col(v)), F.col(v)) for v in value_cols})
    c = c.withColumn("_ts", F.col(time_col).cast("timestamp")).withWatermark("_ts", delay)
    aggs = []
    for v in value_cols:
        key = F.when(F.col(v).isNotNull(), F.struct(F.col(time_col), *[F.col(t) for t in tie_cols], F.col(v)))
        aggs.append(F.max_by(F.col(v), key).alias(v))
    g = c.groupBy(*keys, F.window("_ts", "1 hour")).agg(*aggs)
    out = g.select(*keys, F.col("window.start").cast("timestamp_ntz").alias(time_col), *value_cols)
    return out.dropna(subset=value_cols)


def score_stream(responses: DataFrame, profile: str = "v2", fallback_system: str | None = None) -> DataFrame:
    """Streaming scorer: normalise each arriving record and score it with a profile."""
    norm = records.normalise(responses, fallback_system, profile="v1" if profile == "v1" else "v2")
    return S.score(norm, profile)


def run_available_now(stream_df: DataFrame, name: str = "stream", output_mode: str = "append",
                      timeout_s: float | None = None) -> DataFrame:
    """Run a streaming frame over everything available now into a parquet file sink.

    Output and checkpoint go to the session's shared checkpoint folder (the
    file sink is exactly-once and survives restarts); returns the written
    table as a batch DataFrame.  ``timeout_s`` stops a run that takes longer (no limit by default).
    """
    from ..session import scratch_path

    spark = stream_df.sparkSession
    base = scratch_path(spark, name)
    q = (stream_df.writeStream.outputMode(output_mode).format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination() if timeout_s is None else q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(stream_df.schema).parquet(f"{base}/out")
