"""Operator 11 — vector codes with Drake-Hamerly adaptive bounds.

Vectors of whole numbers are cut into parts; each part position has a codebook
that a fixed number of rounds refines (nearest entry, then the floor of the
mean of an entry's parts).  A round is one pass over a table that holds, beside
each vector, what is known of each part: its b closest entries, nearest first,
with lower bounds of their distances in order, and one outer bound below the
distance of every other entry.

When entries move, a bound sinks by what its entry moved and the outer bound by
the furthest move of all.  The distance to the part's own entry is computed
anew, exactly; listed entries whose bound lies above it are out.  What is left
is uncertain and is verified in whole numbers: only the listed entries whose
bound does not clear it, or, where the outer bound does not clear it either, all
entries, which also renews the list.  Bounds are rounded down and distances up,
so ties and near ties are always verified and go to the lower index.

b adapts for each part position: every round counts how deep into the lists the
parts had to look, and the next lists are as long as nearly all needed.

A round's pass writes two Parquet partitions: the rows with their bounds, and
each task's sums by entry (whole numbers, so the order of addition does not
matter) with the depths.  Spark aggregates the sums; only the codebooks (entries
x vector length) and depths reach the driver.  The table of the round before is
deleted once the next is complete, so disk holds two at most.

Rows whose vector is null, empty or holds null, infinite or NaN entries are
dropped, as are vectors of another length than the most common one (ties: the
longer); a length that the parts do not divide is filled up with zeros.  Null
ids stay and come last when codebooks start (ties by vector); repeated rows and
ids are rows of their own; with fewer rows than entries the codebooks are as
short; null labels are one group; other columns are not read; an empty table
gives an empty result.  Entries beyond 2^23 are compared as Python integers
(slow, but exact); sums beyond 64 bits end the query with an error.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.session import scratch_path

from .common import discard, small, stored
from .vectors import clean_vectors, matrix

#: Parts of a vector, entries of a codebook, rounds, the factor in front of the floor.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Length of the first lists, bounds of later ones, share of parts that a list is to settle.
FIRST, LEAST, MOST, SETTLED = 16, 4, 64, 0.98
#: Rows that are compared at once.
ROWS = 4096
#: Whole numbers up to this are exact in double products of parts up to 64 long.
EXACT = 1 << 23


@dataclass
class Round:
    """What a pass needs: codebooks (part, entry, position), how far each entry has just moved, lengths of the lists read and written."""

    books: np.ndarray
    moved: np.ndarray | None
    read: list[int] | None
    write: list[int]


def down(x: np.ndarray) -> np.ndarray:
    """Half-precision floats not above x (bounds are kept in two bytes)."""
    with np.errstate(over="ignore"):
        h = np.minimum(x, 60000).astype(np.float16)
    return np.where(h.astype(np.float64) > x, np.nextafter(h, np.float16(-np.inf)), h)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) <= EXACT and x.shape[1] <= 64:
        a, b = x.astype(float), book.astype(float)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    d = x.astype(object)[:, None, :] - book.astype(object)[None]
    return (d * d).sum(2)


def pair_squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) <= EXACT:
        d = x - entries
        return np.einsum("ij,ij->i", d, d)
    d = x.astype(object) - entries.astype(object)
    return (d * d).sum(1)


def root_down(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float)) * (1 - 1e-12)


def root_up(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float)) * (1 + 1e-12)


def fresh(x: np.ndarray, book: np.ndarray, b: int, unit: float):
    """(list, bounds, outer bound, squared distance of the first) of rows compared with all entries."""
    d = squares(x, book)
    k, n = len(book), len(x)
    b = min(b, k)
    best = d.argmin(1) if d.dtype != object else np.array([int(np.argmin(r)) for r in d], np.int64)
    f = root_down(d)
    if k > b:
        near = np.argpartition(f, b, axis=1)[:, :b + 1]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(f, near, 1), axis=1, kind="stable"), 1)
        outer = np.take_along_axis(f, near[:, b:], 1)[:, 0]
        near = near[:, :b]
    else:
        near, outer = np.argsort(f, axis=1, kind="stable")[:, :b], np.full(n, np.inf)
    # the exact nearest (lowest index of ties) leads; of ties cut off at the end, the outer bound is as low as the last bound
    at = (near == best[:, None])
    place = np.where(at.any(1), at.argmax(1), b - 1)
    lost = np.where(at.any(1), np.inf, np.take_along_axis(f, near[:, -1:], 1)[:, 0])
    near = near.copy()
    near[np.arange(n), place] = near[:, 0]
    near[:, 0] = best
    outer = np.minimum(outer, lost)
    bounds = np.take_along_axis(f, near, 1)
    return near, bounds * unit, outer * unit, d[np.arange(n), best]


def assign(x: np.ndarray, part: int, state, this: Round, unit: float):
    """(list, bounds, outer, squared distance, depth each row had to look) of one part position in a pass."""
    book, b = this.books[part], this.write[part]
    if state is None:
        near, bounds, outer, d = fresh(x, book, b, unit)
        return near, bounds, outer, d, None
    near, bounds, outer = state
    near, moved = near.astype(np.int64), this.moved[part]
    bounds = bounds.astype(float) - moved[near] * unit
    outer = outer.astype(float) - moved.max(initial=0) * unit
    own = pair_squares(x, book[near[:, 0]])
    upper = root_up(own) * unit
    open_ = bounds <= upper[:, None]
    open_[:, 0] = False
    everything = outer <= upper
    depth = np.where(everything, near.shape[1] + 1, np.where(open_.any(1), near.shape[1] - open_[:, ::-1].argmax(1), 1))
    bounds[:, 0] = root_down(own) * unit
    open_[everything] = False
    row, place = np.nonzero(open_)
    if len(row):   # listed entries that the bounds do not rule out, in whole numbers
        d = pair_squares(x[row], book[near[row, place]])
        bounds[row, place] = root_down(d) * unit
        rows, first = np.unique(row, return_index=True)
        order = np.lexsort((near[row, place], d, row)) if d.dtype != object else np.array(
            sorted(range(len(row)), key=lambda i: (row[i], d[i], near[row[i], place[i]])), np.int64)
        lead = order[first]   # of each row the nearest candidate, ties to the lower index
        better = (d[lead] < own[rows]) | ((d[lead] == own[rows]) & (near[rows, place[lead]] < near[rows, 0]))
        rows, at, d = rows[better], place[lead][better], d[lead][better]
        near[rows, 0], near[rows, at] = near[rows, at], near[rows, 0]
        bounds[rows, 0], bounds[rows, at] = bounds[rows, at], bounds[rows, 0]
        own[rows] = d
    # keep bounds in order behind the nearest entry, and cut or fill the list
    order = np.argsort(bounds[:, 1:], axis=1, kind="stable") + 1
    near[:, 1:], bounds[:, 1:] = np.take_along_axis(near, order, 1), np.take_along_axis(bounds, order, 1)
    b, have = min(b, len(book)), near.shape[1]
    if have > b:
        outer = np.minimum(outer, bounds[:, b])
        near, bounds = near[:, :b], bounds[:, :b]
    elif have < b:   # places without an entry never come into question
        near = np.hstack([near, np.zeros((len(near), b - have), np.int64)])
        bounds = np.hstack([bounds, np.full((len(near), b - have), np.inf)])
    if everything.any():
        near[everything], bounds[everything], outer[everything], own[everything] = fresh(x[everything], book, b, unit)
    return near, bounds, outer, own, depth


def unpack_state(raw: np.ndarray, widths: list[int]):
    """Per part (list, bounds, outer) from rows of bytes."""
    at = 0
    for b in widths:
        near = raw[:, at:at + b]
        halves = np.ascontiguousarray(raw[:, at + b:at + 3 * b + 2]).view(np.float16)
        at += 3 * b + 2
        yield near, halves[:, :b], halves[:, b]


def bytes_column(rows: np.ndarray) -> pa.Array:
    """A binary column of rows of equal width."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int64) * width),
                                                        pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def compared(column: pa.Array, states: pa.Array | None, dim: int, this: Round, unit: float):
    """For some rows: (vectors by part, per part the result of :func:`assign`)."""
    x = matrix(column, dim)
    if dim % len(this.books):
        x = np.hstack([x, np.zeros((len(x), -dim % len(this.books)), np.int64)])
    x = x.reshape(len(x), len(this.books), -1)
    state = [None] * len(this.books)
    if states is not None and len(x):
        raw = np.frombuffer(b"".join(states.to_pylist()), np.uint8).reshape(len(x), -1)
        state = list(unpack_state(raw, this.read))
    return x, [assign(np.ascontiguousarray(x[:, p]), p, state[p], this, unit) for p in range(len(this.books))]


FORM = "kind int, vec_id long, label string, x array<long>, state binary, entry int, sums array<long>"


def assigned(table: DataFrame, dim: int, this: Round, unit: float, name: str) -> tuple[DataFrame, DataFrame, str]:
    """One pass: (rows with their bounds, each task's sums by entry and depths, folder)."""

    def run(batches):
        parts, k, width = this.books.shape
        sums, depths = np.zeros((parts * k, width + 1), np.int64), np.zeros((parts, 2 * MOST), np.int64)
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                batch = whole.slice(lo, ROWS)
                x, got = compared(batch.column(2), batch.column(3) if this.read else None, dim, this, unit)
                n, state = len(x), []
                for p, (near, bounds, outer, _, depth) in enumerate(got):
                    at = near[:, 0] + p * k
                    order = np.argsort(at, kind="stable")
                    heads = np.flatnonzero(np.diff(at[order], prepend=-1))
                    if n:
                        sums[at[order][heads], :width] += np.add.reduceat(x[order, p], heads, axis=0)
                        sums[:, width] += np.bincount(at, minlength=parts * k)
                    if depth is not None:
                        depths[p] += np.bincount(depth, minlength=2 * MOST)
                    state += [near.astype(np.uint8), down(bounds).view(np.uint8).reshape(n, -1), down(outer).view(np.uint8).reshape(n, -1)]
                none = pa.nulls(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), batch.column(2), bytes_column(np.hstack(state)),
                     none.cast(pa.int32()), none.cast(pa.list_(pa.int64()))], ["kind", "vec_id", "label", "x", "state", "entry", "sums"])
        used = np.flatnonzero(sums[:, width])
        entry = np.concatenate([used, -1 - np.arange(parts)]).astype(np.int32)
        values = [r.tolist() for r in sums[used]] + depths.tolist()
        none = pa.nulls(len(entry))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(entry), np.int32)), none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.list_(pa.int64())), none.cast(pa.binary()),
             pa.array(entry), pa.array(values, pa.list_(pa.int64()))], ["kind", "vec_id", "label", "x", "state", "entry", "sums"])

    columns = ["vec_id", "label", "x"] + (["state"] if this.read else [])
    path = scratch_path(table.sparkSession, name)
    table.select(*columns).mapInArrow(run, FORM).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    spark = table.sparkSession
    rows = spark.read.schema("vec_id long, label string, x array<long>, state binary").parquet(f"{path}/kind=0")
    return rows, spark.read.schema("entry int, sums array<long>").parquet(f"{path}/kind=1"), path


def totals(sums: DataFrame) -> dict[int, np.ndarray]:
    """Each entry's sums (and, under negative numbers, each part's depths) over all tasks."""
    by_place = sums.select("entry", F.posexplode("sums").alias("place", "value")).groupBy("entry", "place").agg(F.sum("value").alias("value"))
    rows = by_place.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("values")).collect()
    return {r.entry: np.array([v.value for v in r["values"]]) for r in rows}   # entries x places of whole numbers, whatever the rows


def refined(books: np.ndarray, found: dict[int, np.ndarray]) -> np.ndarray:
    """Codebooks whose entries are the floors of the means; unused entries stay."""
    new = books.copy()
    parts, k, width = books.shape
    for entry, sums in found.items():
        if entry >= 0:
            new[entry // k, entry % k] = np.floor_divide(sums[:width], sums[width])
    return new


def list_lengths(found: dict[int, np.ndarray], read: list[int], k: int) -> list[int]:
    """The next lists: as many entries as nearly all parts had to look at."""
    out = []
    for p, old in enumerate(read):
        depths = found.get(-1 - p, np.zeros(1, int))
        total = depths.sum()
        if not total:
            out.append(old)
            continue
        settled = np.cumsum(depths[:old + 1]) >= SETTLED * total
        out.append(min(k, MOST, max(LEAST, int(settled.argmax()) + 1 if settled.any() else 2 * old)))
    return out


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(rows of vec_id, label and x: array<long>, length of x)."""
    rows, dim = clean_vectors(vectors.select("vec_id", "label", "embedding"))
    return rows.select("vec_id", F.col("label").cast("string").alias("label"),
                       F.transform("vec", lambda v: F.floor(v * F.lit(scale)).cast("long")).alias("x")), dim


def first_books(rows: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the rows with the smallest ids (part, entry, position)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    x = np.array([r.x for r in first], np.int64).reshape(len(first), dim)
    x = np.hstack([x, np.zeros((len(x), -dim % parts), np.int64)])
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list]:
    """(rows of vec_id, label, code, error; codebooks; what each round had to verify).

    Codes take two hex digits a part, so ``entries`` is 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes of two hex digits hold 1 to 256 entries")
    spark = vectors.sparkSession
    table, dim = whole_numbers(vectors, scale)
    form = "vec_id long, label string, code string, error long"
    if not dim:
        return spark.createDataFrame([], form), np.zeros((parts, 0, 0), np.int64), []
    books = first_books(table, dim, parts, entries)
    # bounds are kept as halves: distances are scaled into their range by the first codebooks' extent
    extent = max(1.0, float(np.sqrt((np.ptp(books, axis=1).astype(float) ** 2).sum(1)).max(initial=1.0)))
    unit = min(1.0, 8192 / extent)
    this = Round(books, None, None, [min(FIRST, books.shape[1])] * parts)
    path, log = None, []
    for k in range(rounds):
        rows, sums, new_path = assigned(table, dim, this, unit, f"codes-{k}")
        if path:
            discard(spark, path)
        table, path = rows, new_path
        found = totals(sums)
        new = refined(books, found)
        moved = np.stack([root_up(pair_squares(new[p], books[p])) for p in range(parts)])
        log.append({p: found[-1 - p].tolist() for p in range(parts) if -1 - p in found})
        books, this = new, Round(new, moved, this.write, list_lengths(found, this.write, books.shape[1]))

    def finish(batches):
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                batch = whole.slice(lo, ROWS)
                _, got = compared(batch.column(2), batch.column(3) if this.read else None, dim, this, unit)
                codes = np.stack([near[:, 0] for near, *_ in got], 1).astype(np.uint8)
                error = sum(d for *_, d, _ in got)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([row.tobytes().hex() for row in codes], pa.string()),
                     pa.array(error.tolist() if error.dtype == object else error.astype(np.int64), pa.int64())], ["vec_id", "label", "code", "error"])

    columns = ["vec_id", "label", "x"] + (["state"] if this.read else [])
    return table.select(*columns).mapInArrow(finish, form), books, log


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE, column: str = "code") -> DataFrame:
    """``codes`` with the vector (``decoded``: array<double>) that each code stands for."""

    def run(batches):
        for batch in batches:
            raw = np.frombuffer(bytes.fromhex("".join(batch.column(batch.schema.get_field_index(column)).to_pylist())), np.uint8).reshape(len(batch), len(books))
            x = np.concatenate([books[p][raw[:, p]] for p in range(len(books))], axis=1) / scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "decoded"])

    return codes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema) + ", decoded array<double>")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Registered query: every vector's code, its error, its label's error, and the digest of the codebooks."""
    rows, books, _ = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = stored(rows, "codes")
    by_label = small(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))   # labels are counted before a broadcast
    return (rows.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
            .select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB: every distance of every round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT row, part, min(struct_pack(d, entry)) AS best FROM (
    SELECT p.row, p.part, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT AS d
    FROM cut p JOIN book{k} b USING (part)) GROUP BY row, part)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
  SELECT part, entry, list(m ORDER BY i) AS x FROM (
    SELECT part, entry, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (
      SELECT n.part, n.best.entry AS entry, unnest(range(1, len(c.x) + 1)) AS i, unnest(c.x) AS v FROM near{k} n JOIN cut c USING (row, part))
    GROUP BY part, entry, i) GROUP BY part, entry),
book{k + 1} AS MATERIALIZED (SELECT part, entry, CASE WHEN m.x IS NULL THEN b.x ELSE m.x::BIGINT[] END AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))""")
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS row, vec_id, label, x FROM (
    SELECT vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)),
cut AS MATERIALIZED (SELECT row, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM kept, range({parts}) r(part)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM cut WHERE row <= {entries}),
{",".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (row)"""


OP11_SQL = _sql()
