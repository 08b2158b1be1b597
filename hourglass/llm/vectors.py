"""Shared helpers of the vector operators: clean rows, matrices from Arrow columns, sums of small matrices over a table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that become one matrix at a time.
ROWS = 8192


def clean_vectors(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(rows with ``vec``: array<double> in place of ``column``, its length): without null vectors, null, infinite or NaN
    entries, and vectors of another length than the most common one (ties: the longer; empty vectors never)."""
    others = [c for c in vectors.columns if c != column]
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *(c for c in others if c != "vec_id"), F.col(column).cast("array<double>").alias("vec"))
    number = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec").isNotNull()).where((F.size("vec") > 0) & number)
    common = (v.select(F.size("vec").alias("dim")).groupBy("dim").agg(F.count("*").alias("rows"))
              .orderBy(F.col("rows").desc(), F.col("dim").desc()).limit(1).collect())
    dim = common[0].dim if common else 0
    return v.where(F.size("vec") == dim), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of an array column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def summed(table: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple, symmetric: bool = False, whole: bool = False) -> np.ndarray:
    """The sum over all rows' matrices (first column of ``table``) of what ``part`` gives for some rows.

    Each task adds up its own rows and sends one row an entry (of symmetric
    ones the upper half) to the aggregate; the driver gets the entries' sums.
    """
    at = np.flatnonzero(np.triu(np.ones(shape, bool)).reshape(-1)) if symmetric else np.arange(int(np.prod(shape)))
    kind = np.int64 if whole else np.float64

    def run(batches):
        total = None
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                got = part(matrix(batch.column(0).slice(lo, ROWS), dim)).reshape(-1)[at]
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.astype(kind))], ["entry", "value"])

    out = np.zeros(int(np.prod(shape)), kind)
    for r in table.mapInArrow(run, f"entry int, value {'long' if whole else 'double'}").groupBy("entry").agg(F.sum("value").alias("value")).collect():
        out[r.entry] = r.value
    out = out.reshape(shape)
    return np.triu(out) + np.triu(out, 1).T if symmetric else out
