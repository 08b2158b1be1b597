"""The hourly collapse of an unbounded report stream, exact for reports of any lateness (AGG-1).

The last non-null value of a column within an hour is a maximum of
(time, tie, value), so an hour can be collapsed bit by bit in any order.  A
micro-batch collapses its own reports (map-side first) and adds them to a run
log under the batch's number: a batch that is run again after a failure takes
its own place, and an hour that was long finished is opened again by a late
report simply because its maximum is taken over one more row.  There is no
watermark and no state to grow on the executors; the log is folded every
``fold_every`` batches, so that it holds one row an hour and the rows of the
latest batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import clean
from ..session import scratch_path
from ..sources.runlog import RunLog


class HourlyLog:
    """Collapsed hours under ``path``; ``tie_cols`` (of long type) order reports of one time and ``keys`` (strings) tell series apart."""

    def __init__(self, spark: SparkSession, path: str, time_col: str = "date", value_cols=None, tie_cols=(), keys=(), fold_every: int = 20):
        self.time, self.values, self.ties, self.keys = time_col, list(value_cols or vocab.MEASURES), list(tie_cols), list(keys)
        order = ", ".join(["at: timestamp_ntz", *[f"{t}: bigint" for t in self.ties], "value: double"])
        schema = ", ".join([*[f"{k} string" for k in self.keys], f"{time_col} timestamp_ntz", *[f"{v} struct<{order}>" for v in self.values]])
        self.log, self.fold_every = RunLog(spark, path, schema), fold_every

    def _merged(self, partial: DataFrame) -> DataFrame:
        return partial.groupBy(*self.keys, self.time).agg(*[F.max(v).alias(v) for v in self.values])

    def partial(self, reports: DataFrame) -> DataFrame:
        """One row an hour of some raw (text) reports: the greatest (time, tie, value) of each column."""
        c = clean.coerce_reports(reports, self.time, self.values)
        last = [F.when(F.col(v).isNotNull() & ~F.isnan(v), F.struct(
            F.col(self.time).alias("at"), *[F.col(t).cast("bigint").alias(t) for t in self.ties], F.col(v).alias("value"))).alias(v) for v in self.values]
        return self._merged(c.select(*self.keys, clean.floor_hour(F.col(self.time)).alias(self.time), *last))

    def upsert(self, reports: DataFrame, batch: int) -> None:
        """Add a micro-batch; repeating it changes nothing."""
        self.log.append(self.partial(reports), f"batch-{batch:012d}")
        if (batch + 1) % self.fold_every == 0:
            self.fold()

    def fold(self) -> None:
        """One row an hour.  A maximum taken twice is the same maximum, so a batch repeated after it was folded in does no harm."""
        self.log.fold("folded", self._merged)

    def table(self, drop_incomplete: bool = True) -> DataFrame:
        """The clean series as it stands now."""
        out = self._merged(self.log.read()).select(*self.keys, self.time, *[F.col(f"{v}.value").alias(v) for v in self.values])
        return out.dropna(subset=self.values) if drop_incomplete else out

    def run(self, stream: DataFrame, checkpoint: str | None = None, timeout_s: float | None = None) -> "HourlyLog":
        """Take in everything that is available now; a second run with the same checkpoint goes on where this one ended."""
        q = (stream.writeStream.foreachBatch(self.upsert)
             .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "hourly-log-checkpoint"))
             .trigger(availableNow=True).start())
        q.awaitTermination() if timeout_s is None else q.awaitTermination(timeout_s)
        if q.isActive:
            q.stop()
            raise TimeoutError(f"the stream did not finish in {timeout_s}s")
        if q.exception() is not None:
            raise q.exception()
        return self
