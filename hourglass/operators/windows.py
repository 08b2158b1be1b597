"""Row-position and time-range windows over one long series or many keyed ones.

All frame work goes through :func:`framed`: rows are partitioned by
(keys, chunk) where ``chunk = order div C``; rows near a chunk edge are
copied into the neighbouring chunk(s) as a halo so every frame is complete
inside one partition.  One shuffle, then every frame function of a stage is
evaluated in the same sorted partition.  With C much larger than the reach,
the copy overhead is ``reach / C``; a single series of any length and a
hot key are both split over many tasks.

Alignments (W = input rows, H = horizon):

======================  ==============  ===========  ================
use                     input rows      target row   rows after input
======================  ==============  ===========  ================
train (``gap=0``)       t-W-H+1 .. t-H  t            H
verify / cases          r-W .. r-1      r+H          H+1
predict                 r-W+1 .. r      r+H          H
======================  ==============  ===========  ================
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..session import scratch_path

DEFAULT_CHUNK = 1_000_000
#: Chunk where every row carries its window as an array (72 rows of three doubles: about 2 KB).
ARRAY_CHUNK = 50_000


@dataclass
class Framed:
    """A halo-expanded frame: use ``spec`` for windows, then ``home()`` to drop halo copies."""

    df: DataFrame
    spec: object
    order: str
    chunk: int
    keys: tuple = ()
    back: int = 0
    forward: int = 0

    def reaching(self, order: str, keys, back: int, forward: int) -> "Framed":
        """This frame, if it serves the keys, the order and the reach asked for."""
        if (order, tuple(keys)) != (self.order, self.keys) or back > self.back or forward > self.forward:
            raise ValueError(f"a frame by {self.keys}, {self.order} with {self.back} rows before and {self.forward} after does not serve "
                             f"{tuple(keys)}, {order} with {back} and {forward}")
        return self

    def home(self, df: DataFrame | None = None) -> DataFrame:
        d = self.df if df is None else df
        return d.where(F.col("_chunk") == F.floor(F.col(self.order) / F.lit(self.chunk))).drop("_chunk")


def framed(df: DataFrame | Framed, order: str, keys=(), back: int = 0, forward: int = 0, chunk: int = DEFAULT_CHUNK) -> Framed:
    """Halo expansion on a numeric ``order`` column (row position or epoch seconds).

    A row at ``p`` is needed by home rows ``q`` with ``q - back <= p <= q + forward``,
    so it is copied to chunks ``(p - forward) div C .. (p + back) div C`` (numbers below
    zero are chunks like any other: epoch seconds before 1970 have them).
    A series that :func:`laid_out` has stored is taken as it lies.
    """
    keys = list(keys)
    if isinstance(df, Framed):
        return df.reaching(order, keys, back, forward)
    if chunk <= max(back, forward):
        raise ValueError("chunk must be larger than the frame reach")
    p = F.col(order)
    lo = F.floor((p - F.lit(forward)) / F.lit(chunk))
    hi = F.floor((p + F.lit(back)) / F.lit(chunk))
    ex = df.withColumn("_chunk", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    spec = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return Framed(ex, spec, order, chunk, tuple(keys), back, forward)


def laid_out(series: DataFrame, keys=(), order: str = "idx", back: int = 96, forward: int = 25, chunk: int = DEFAULT_CHUNK,
             buckets: int | None = None) -> Framed:
    """A series stored for all its windows: halo chunks, bucketed by (keys, chunk) and sorted by ``order`` (JN-1, WIN-11).

    The rows are shuffled once, here.  Every window function, look-up frame and
    history count that takes the result in place of the series reads its
    buckets as they lie: no further exchange of rows.  A key's rows are dealt by
    chunk, so a hot key fills many buckets.  ``buckets`` (by default the session's
    shuffle partitions) is to be sized so that a bucket fits a task: one
    file each.  Null keys are a key of their own; an empty series gives an empty table.
    """
    fr = framed(series, order, keys, back, forward, chunk)
    spark, place = series.sparkSession, [*keys, "_chunk"]
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "layout")
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    (fr.df.repartition(n, *place).write.format("parquet").option("compression", "zstd").option("path", path)
     .bucketBy(n, place).sortBy([*place, order]).saveAsTable(table))
    return replace(fr, df=spark.table(table))


def _feature_struct(value_cols) -> Column:
    return F.struct(*[F.col(c).alias(c) for c in value_cols])


def flatten_window(arr: Column, value_cols) -> Column:
    """Array of per-row structs -> one time-major double array (WIN-8)."""
    return F.flatten(F.transform(arr, lambda s: F.array(*[s[c] for c in value_cols])))


def window_samples(
    series: DataFrame,
    value_cols=None,
    keys=(),
    window: int = 72,
    horizon: int = 24,
    include_request_row: bool = False,
    idx_col: str = "idx",
    date_col: str = "date",
    arrays: bool = True,
    chunk: int | None = None,
) -> DataFrame:
    """Windows anchored at the *request* row ``r`` (WIN-3..6).

    ``include_request_row=False``: inputs r-W .. r-1, target r+H (verify / cases);
    ``True``: inputs r-W+1 .. r, target r+H (predict / train, where the train
    sample index is ``r - W + 1``).  Rows without a full window or without a
    target are not emitted.  Output: keys, ``idx`` (request row), request time,
    ``x`` (array of structs, optional), ``x_size``, target time and values.
    ``chunk`` defaults to fewer rows where arrays are built, so that a task's output stays near 100 MB.
    """
    value_cols = list(value_cols or vocab.MEASURES)
    keys = list(keys)
    last = 0 if include_request_row else -1
    first = last - window + 1
    chunk = chunk or max(ARRAY_CHUNK if arrays else DEFAULT_CHUNK, window + horizon + 1)
    fr = framed(series, idx_col, keys, back=-first, forward=horizon, chunk=chunk)
    frame = fr.spec.rowsBetween(first, last)
    cols = [
        F.count(F.lit(1)).over(frame).alias("x_size"),
        F.lead(F.col(date_col), horizon).over(fr.spec).alias("target_date"),
        *[F.lead(F.col(c), horizon).over(fr.spec).alias(f"y_{c}") for c in value_cols],
    ]
    if arrays:
        cols.append(F.collect_list(_feature_struct(value_cols)).over(frame).alias("x"))
    carry = ["n"] if "n" in fr.df.columns else []
    out = fr.df.select(*keys, idx_col, date_col, *carry, "_chunk", *cols)
    out = fr.home(out)
    out = out.where((F.col("x_size") == window) & F.col("target_date").isNotNull())
    if carry:  # samples per key follow from the series length: no count pass needed
        out = out.withColumn("n_samples", F.col("n") - F.lit(window + horizon - (1 if include_request_row else 0)))
    return out


def train_windows(series: DataFrame, value_cols=None, keys=(), window: int = 72, horizon: int = 24, **kw) -> DataFrame:
    """Training alignment (WIN-3): sample s uses rows s .. s+W-1, target s+W+H-1.

    Adds ``sample_idx`` = s.  Same rows as ``len - W - H + 1`` samples per key.
    """
    out = window_samples(series, value_cols, keys, window, horizon, include_request_row=True, **kw)
    return out.withColumn("sample_idx", F.col("idx") - F.lit(window - 1))


def verify_windows(series: DataFrame, value_cols=None, keys=(), window: int = 72, horizon: int = 24, **kw) -> DataFrame:
    """Verification alignment (WIN-4): inputs i-W .. i-1, target i+H, i from W to n-H-1."""
    return window_samples(series, value_cols, keys, window, horizon, include_request_row=False, **kw)


def time_split(samples: DataFrame, keys=(), ratio: float = 0.8, sample_col: str = "sample_idx", n_col: str = "n_samples") -> DataFrame:
    """Chronological split at ``int(n_samples * ratio)`` per key (WIN-9).

    ``n_samples`` is taken from the column of that name when the samples carry
    it (windows over an indexed series do: it follows from the series length),
    else from a per-key count joined back.  No window sees a whole key.
    """
    keys = list(keys)
    if n_col in samples.columns:
        split_at = F.floor(F.col(n_col).cast("double") * F.lit(float(ratio)))
        return samples.withColumn("split", F.when(F.col(sample_col) < split_at, F.lit("train")).otherwise(F.lit("test")))
    if not keys:  # a single series: its sample count is one number (one count job)
        j = samples.withColumn(n_col, F.lit(samples.count()).cast("bigint"))
    else:
        j = samples.join(samples.groupBy(*keys).agg(F.count(F.lit(1)).alias(n_col)), on=keys, how="inner")
    split_at = F.floor(F.col(n_col).cast("double") * F.lit(float(ratio)))
    return j.withColumn("split", F.when(F.col(sample_col) < split_at, F.lit("train")).otherwise(F.lit("test")))


def persistence(series: DataFrame, value_cols=None, keys=(), window: int = 72, horizon: int = 24,
                idx_col: str = "idx", date_col: str = "date", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Persistence forecast in training alignment (WIN-10): the last input row predicts the target.

    At target row t: prediction = row t-H, actual = row t, sample index
    s = t - W - H + 1 (rows with s < 0 are dropped).  No arrays are built.
    """
    value_cols = list(value_cols or vocab.MEASURES)
    keys = list(keys)
    fr = framed(series, idx_col, keys, back=horizon, forward=0, chunk=chunk)
    carry = ["n"] if "n" in fr.df.columns else []
    out = fr.df.select(
        *keys, idx_col, date_col, *carry, "_chunk",
        *[F.col(c).alias(f"y_{c}") for c in value_cols],
        *[F.lag(F.col(c), horizon).over(fr.spec).alias(f"p_{c}") for c in value_cols],
    )
    out = fr.home(out).withColumn("sample_idx", F.col(idx_col) - F.lit(window + horizon - 1))
    if carry:
        out = out.withColumn("n_samples", F.col("n") - F.lit(window + horizon - 1))
    return out.where(F.col("sample_idx") >= 0).withColumnRenamed(date_col, "target_date")


def history_counts(series: DataFrame | Framed, keys=(), hours: int = 72, date_col: str = "date",
                   chunk_hours: int = 24 * 365, period_hours: int = 1) -> DataFrame:
    """Rows in the time range [t - hours h, t - 1 h] before each row (WIN-11).

    A RANGE frame on epoch seconds inside a time-chunked halo partition.
    Adds ``history_rows`` and ``history_complete`` (= exactly ``hours`` rows).
    A stored series has at most one row of a key in ``period_hours``, so the
    range lies within the ``hours / period_hours`` rows before.
    """
    keys = list(keys)
    seconds = F.unix_seconds(F.col(date_col).cast("timestamp"))
    if isinstance(series, Framed):
        fr = framed(series, series.order, keys, back=-(-hours // period_hours))
        fr = replace(fr, df=fr.df.withColumn("_sec", seconds), spec=Window.partitionBy(*keys, "_chunk").orderBy("_sec"))
    else:
        fr = framed(series.withColumn("_sec", seconds), "_sec", keys, back=hours * 3600, forward=0, chunk=chunk_hours * 3600)
    frame = fr.spec.rangeBetween(-hours * 3600, -3600)
    out = fr.df.withColumn("history_rows", F.count(F.lit(1)).over(frame).cast("bigint"))
    out = fr.home(out).drop("_sec")
    return out.withColumn("history_complete", F.col("history_rows") == F.lit(hours))


def step_sizes(series: DataFrame, keys=(), idx_col: str = "idx", date_col: str = "date", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Time step to the previous row in seconds (WIN-2); null on each key's first row."""
    keys = list(keys)
    fr = framed(series, idx_col, keys, back=1, forward=0, chunk=chunk)
    prev = F.lag(F.col(date_col), 1).over(fr.spec)
    step = F.unix_seconds(F.col(date_col).cast("timestamp")) - F.unix_seconds(prev.cast("timestamp"))
    out = fr.df.select(*keys, idx_col, date_col, "_chunk", step.cast("bigint").alias("step_seconds"))
    return fr.home(out)
