"""Linear regression on windows from lag moments (ML-2, ML-3): no window is ever built.

Sample i has the rows i .. i+W-1 of the series as its W x C inputs and row
i+W+H-1 as its target.  Entry (k, a), (l, b) of X'X is a sum of
s_a[i+k] * s_b[i+l] over the samples, that is a cross-product of the series
with itself at lag l-k over rows k .. k+M-1.  So one pass over the plain series
adds up the products of all lags below W+H for the first rows, and each further
entry is its upper left neighbour less the products that leave at the window's
start plus those that enter at its end (of the first and the last W+H rows).

The pass is one shuffle into chunks of rows with a halo of W+H rows; a chunk
gives (W+H) x C x C sums, which Spark adds.  The driver gets those sums and two
windows of rows, whatever the length of the series, and solves a C*W system.
Values are centred on the series' means first, which the intercept takes up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from . import windows as W

CHUNK = 50_000


@dataclass
class LinearWindow:
    """``coefficients[k, a, m]`` of input row k and column a for target column m, and the intercepts."""

    coefficients: np.ndarray
    intercept: np.ndarray
    columns: list
    horizon: int

    @property
    def window(self) -> int:
        return len(self.coefficients)


def lag_sums(series: DataFrame, columns, centre, count: int, lags: int, idx_col: str = "idx", chunk: int = CHUNK) -> np.ndarray:
    """sums[d, a, b] = sum over rows j < count of s_a[j] * s_b[j + d], and in sums[lags, 0] the columns' sums over those rows."""
    c, columns, chunk = len(columns), list(columns), max(chunk, lags)
    chunked = W.framed(series.where(F.col(idx_col) < count + lags - 1).select(idx_col, *columns), idx_col, forward=lags - 1, chunk=chunk).df

    def products(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(idx_col)
        at, s = rows[idx_col].to_numpy(), rows[columns].to_numpy(float) - centre
        home = int(((at // chunk == rows["_chunk"].iloc[0]) & (at < count)).sum())   # they come first: the halo lies behind
        out = np.zeros((lags + 1, c, c))
        for d in range(lags):
            n = max(0, min(home, len(s) - d))
            out[d] = s[:n].T @ s[d:d + n]
        out[lags, 0] = s[:home].sum(0)
        return pd.DataFrame({"place": np.arange(out.size), "value": out.reshape(-1)})

    sums = chunked.groupBy("_chunk").applyInPandas(products, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros((lags + 1) * c * c)
    for r in sums.collect():   # (lags + 1) x C x C numbers
        out[r.place] = r.value
    return out.reshape(lags + 1, c, c)


def rows_between(series: DataFrame, columns, centre, start: int, count: int, idx_col: str = "idx") -> np.ndarray:
    """``count`` rows of the series from a position on (a few windows of them at most)."""
    found = series.where(F.col(idx_col).between(start, start + count - 1)).select(idx_col, *columns).collect()
    return np.array([r[1:] for r in sorted(found)], float).reshape(-1, len(columns)) - centre


def window_moments(series: DataFrame, columns, centre, samples: int, window: int, horizon: int, idx_col: str = "idx", chunk: int = CHUNK):
    """(G[k, l, a, b], X'Y[k, a, m], sums of x [k, a], sums of y [m]) over the first ``samples`` windows, values less ``centre``."""
    span, c = window + horizon, len(columns)
    sums = lag_sums(series, columns, centre, samples, span, idx_col, chunk)
    head = rows_between(series, columns, centre, 0, span, idx_col)
    tail = rows_between(series, columns, centre, samples, span - 1, idx_col)
    change = [np.einsum("a,lb->lab", tail[k], tail) - np.einsum("a,lb->lab", head[k], head[:span - 1]) for k in range(window - 1)]
    g = np.zeros((span, span, c, c))
    g[0] = sums[:span]
    for k in range(1, window):
        g[k, k:] = g[k - 1, k - 1:span - 1] + change[k - 1][k - 1:]
    for k in range(window):
        for m in range(k):
            g[k, m] = g[m, k].T
    x = np.zeros((span, c))
    x[0] = sums[span, 0]
    for k in range(1, span):
        x[k] = x[k - 1] + tail[k - 1] - head[k - 1]
    return g[:window, :window], g[:window, span - 1], x[:window], x[span - 1]


def fit_linear(series: DataFrame, columns=None, window: int = 72, horizon: int = 24, ratio: float = 0.8, idx_col: str = "idx", chunk: int = CHUNK) -> LinearWindow:
    """Least squares with intercept on the first ``int(samples * ratio)`` windows of one series (WIN-9's train split).

    Collinear inputs (or fewer windows than inputs) get the smallest coefficients that fit best.
    """
    columns = list(columns or vocab.MEASURES)
    stats = series.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in columns]).first()
    samples = int((stats.n - window - horizon + 1) * ratio)
    if samples < 1:
        raise ValueError(f"{stats.n} rows hold no training window of {window} + {horizon} rows")
    centre = np.array([stats[v] for v in columns], float)
    g, xy, x, y = window_moments(series, columns, centre, samples, window, horizon, idx_col, chunk)
    p, c = window * len(columns), len(columns)
    flat = g.transpose(0, 2, 1, 3).reshape(p, p)
    mean_x, mean_y = x.reshape(p) / samples, y / samples
    cov = flat / samples - np.outer(mean_x, mean_x)
    both = xy.reshape(p, c) / samples - np.outer(mean_x, mean_y)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale <= 1e-12 * max(scale.max(), 1e-300)] = np.inf   # a constant input has no say
    w = np.linalg.lstsq(cov / np.outer(scale, scale), both / scale[:, None], rcond=1e-12)[0] / scale[:, None]
    intercept = centre + mean_y - (mean_x + np.tile(centre, window)) @ w
    return LinearWindow(w.reshape(window, c, c), intercept, columns, horizon)


def predict_linear(series: DataFrame, model: LinearWindow, idx_col: str = "idx", date_col: str = "date", chunk: int = CHUNK) -> DataFrame:
    """sample_idx, target_date, ``y_*`` and ``p_*`` of every window of the series: a running product over the plain rows."""
    columns, span = model.columns, model.window + model.horizon
    chunk = max(chunk, span)
    chunked = W.framed(series.select(idx_col, date_col, *columns), idx_col, forward=span - 1, chunk=chunk).df
    form = ", ".join(["sample_idx bigint", "target_date timestamp_ntz", *[f"y_{v} double" for v in columns], *[f"p_{v} double" for v in columns]])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(idx_col)
        at, s = rows[idx_col].to_numpy(), rows[columns].to_numpy(float)
        n = min(int((at // chunk == rows["_chunk"].iloc[0]).sum()), max(0, len(s) - span + 1))
        p = np.tile(model.intercept, (n, 1))
        for k in range(model.window):
            p += s[k:k + n] @ model.coefficients[k]
        y = s[span - 1:span - 1 + n]
        out = {"sample_idx": at[:n], "target_date": rows[date_col].to_numpy()[span - 1:span - 1 + n]}
        return pd.DataFrame({**out, **{f"y_{v}": y[:, j] for j, v in enumerate(columns)}, **{f"p_{v}": p[:, j] for j, v in enumerate(columns)}})

    return chunked.groupBy("_chunk").applyInPandas(run, form)
