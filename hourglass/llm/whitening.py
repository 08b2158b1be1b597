"""Operator 13 — whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers (``floor(scale * entry) + offset``); the model is
fitted on every distinct vector once.  Its rows, centred, form a tall matrix A
that is never moved: each pass runs over the fit table where it lies, adds up
the Gram matrix of the rows times the triangular factors found so far, and
sends d(d+1)/2 sums a task to an aggregate.  The first Cholesky factor is taken
with a shift, which holds for any condition number; the next passes work on
rows that a triangular solve has made almost orthogonal.  The product R of the
factors has A's singular values and right vectors, so one small SVD of R on the
driver gives the whitening components without ever squaring the condition.

Centring is exact: ``(n * x - S) / n`` with whole n, x and S.  What reaches the
driver is d sums and d(d+1)/2 Gram entries a pass, whatever the rows.

Rows whose vector is null, empty or holds null, infinite or NaN entries are
dropped, as are vectors of another length than the most common one (ties: the
longer).  A null id stays null, repeated rows and ids stay rows of the result
and count once in the fit, other columns are not read.  Components without
variance (as when a dimension is constant, or with fewer distinct vectors than
dimensions) are left out: one distinct vector or an empty table gives an empty
result.  A deviation beyond 64 bits ends the query with an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import clean_vectors, matrix, summed

#: Components returned, passes that orthogonalise, and the least singular value (of the largest) that is not rounding.
COMPONENTS, PASSES, LEAST = 16, 3, 1e-12
#: Rows that are projected at once.
ROWS = 4096


@dataclass
class Whitening:
    """A fitted model: number of distinct vectors, their sums, components (columns), eigenvalues, trace, largest identity error."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        off = self.n * x - self.sums
        most = int(max(-off.min(), off.max())) if off.size else 0
        if most ** 2 * x.shape[1] >= 2 ** 63:   # whole numbers of any size; what does not fit a long is an error later on
            return np.array([sum(int(v) ** 2 for v in row) for row in off], dtype=object)
        return (off * off).sum(1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def whole_vectors(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> tuple[DataFrame, int]:
    """(rows of vec_id and x: array<long>, length of x)."""
    rows, dim = clean_vectors(vectors.select("vec_id", "embedding"))
    return rows.select("vec_id", F.transform("vec", lambda v: F.floor(v * F.lit(scale)).cast("long") + F.lit(offset).cast("long")).alias("x")), dim


def gram(fit: DataFrame, dim: int, n: int, sums: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """A'A of the centred rows after a triangular solve with each factor in turn."""

    def part(x):
        a = centred(x, n, sums).T
        for r in factors:
            a = np.linalg.solve(r.T, a)   # rows times the inverse of r
        return a @ a.T

    return summed(fit, dim, part, (dim, dim), symmetric=True)


def shifted_cholesky(g: np.ndarray, rows: int, shift: bool) -> np.ndarray:
    """The upper factor of g; with a shift that outweighs rounding when asked for, or when g is not positive otherwise."""
    d, top = len(g), float(np.trace(g)) or 1.0
    step = 11 * (rows * d + d * (d + 1)) * np.finfo(float).eps / 2 * top
    step = min(step, 1e-6 * top)   # rows beyond 10^9 would make the proven bound useless; the later passes take this up
    for k in range(8):
        try:
            if k or shift:
                return np.linalg.cholesky(g + step * 10.0 ** max(0, k - 1) * np.eye(d)).T
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("the Gram matrix is not positive")


def fit_whitening(rows: DataFrame, dim: int, components: int = COMPONENTS, passes: int = PASSES) -> Whitening | None:
    """The model of the distinct vectors of ``rows`` (x: array<long>), or None where nothing varies."""
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    totals = summed(fit, dim, lambda x: np.concatenate(([len(x)], x.sum(0))), (dim + 1,), whole=True)
    n, sums = int(totals[0]), totals[1:]
    if not n:
        return None
    factors: list[np.ndarray] = []
    for k in range(passes):
        factors.append(shifted_cholesky(gram(fit, dim, n, sums, factors), n, shift=k == 0))
    r = np.eye(dim)
    for factor in factors:
        r = factor @ r
    _, singular, right = np.linalg.svd(r)
    keep = min(components, int((singular > LEAST * singular[0]).sum())) if singular[0] > 1e-9 * np.sqrt(n) else 0
    if not keep:
        return None
    right = right[:keep]
    right = right * np.where(np.take_along_axis(right, np.abs(right).argmax(1)[:, None], 1) < 0, -1, 1)
    model = Whitening(n, sums, right.T, singular[:keep] ** 2 / n, float((singular ** 2).sum()) / n)

    def part(x):
        w = model.whiten(x)
        return np.vstack([w.sum(0), w.T @ w])

    total = summed(fit, dim, part, (keep + 1, keep)) / n
    covariance = total[1:] - np.outer(total[0], total[0])   # the mean of centred rows is rounding
    model.identity_error = float(np.abs(covariance - np.eye(keep)).max())
    return model


FORM = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, dim: int, model: Whitening | None) -> DataFrame:
    """A row for each of ``rows`` and each component."""
    if model is None:
        return rows.sparkSession.createDataFrame([], FORM)

    def run(batches):
        k = len(model.values)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                x = matrix(part.column(1), dim)
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, model.n)), pa.array(np.repeat(model.deviation(x), k), pa.int64()), pa.array(model.whiten(x).reshape(-1)),
                     pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, model.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, FORM)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """Registered query: every vector's first 16 whitened components."""
    rows, dim = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = stored(rows, "whitening-rows")
    return whitened(rows, dim, fit_whitening(rows, dim))
