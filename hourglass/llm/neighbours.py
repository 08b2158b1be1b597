"""Operator 8 — nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts (balanced
label moves: a row goes to the part that holds most of its neighbours, while
parts keep to a size limit).  A small softmax classifier learns to tell the
parts from vectors.  The number of parts grows with the rows, so that a part
holds about ``PART_ROWS`` of them: beyond ``ONE_LEVEL`` parts, each coarse part
is cut again on a sample of its own rows, with a classifier of its own, one
task a coarse part.  Every row is indexed under its most probable part; a query
looks into its most probable parts and is compared exactly there.

How many parts a query looks into is measured, not set: a few rows are compared
with the whole table once, and the least number of parts that holds
``TARGET`` of their true neighbours is taken.  Clustered vectors need a few
parts; vectors without any structure need most of them, whatever the index.

Within a part, rows are dealt to blocks of a bounded size, so a part with a
third of all rows (copies of one vector) is many blocks, each a key of its own
in the join.  A block meets a block of queries in one matrix product, which
finds the rows that may be among the best; those are scored anew in one fixed
order of addition and go, packed, to the bucket of their query, where one task
takes the final k.  A query whose
parts hold fewer than k rows looks into all parts.

Scores are inner products of the original vectors in double precision, added
in the same order for every pair; ties go to the smaller id.  Null vectors,
null, infinite or NaN components, zero vectors and vectors of another length
than the most common one take no part, as queries and as candidates; rows with
equal ids are candidates of their own, but a row of the query's id is never
its neighbour; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, sampled, small, stored
from .vectors import clean_vectors

#: Rows of a part; rows of the sample that a level is fitted on (by expectation); neighbours in the graph; rows of a block.
PART_ROWS, SAMPLE_ROWS, GRAPH, BLOCK_ROWS = 1_000, 12_000, 12, 2_000
#: Parts up to which there is one level; coarse parts, and parts of each, at most; rows measured; share of neighbours to find.
ONE_LEVEL, SIDE, MEASURED, TARGET = 16, 256, 100, 0.95
#: Entries of a matrix that is held at once.
CELLS = 1 << 22
#: What a block of rows gives a block of queries goes on packed; rows that one task merges, by expectation.
FOUND, BUCKET_ROWS = np.dtype([("query", np.int64), ("row", np.int64), ("score", np.float64)]), 1_000_000


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(rows vec_id, vec: array<double> without nulls, other values than numbers, and zero vectors; their length)."""
    v, dim = clean_vectors(vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull()
                                                                       & F.exists(F.col("embedding"), lambda x: x.isNotNull() & (x != 0))))
    return v, dim


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row by inner product, in blocks."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    if k < 1:
        return out
    for lo in range(0, len(x), 1024):
        score = (x[lo:lo + 1024] @ x.T).astype(np.float32)
        score[np.arange(len(score)), np.arange(lo, lo + len(score))] = -np.inf
        out[lo:lo + 1024] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, seed: int = 3, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """A partition of the graph: a start by balanced nearest centres, then rows move towards their neighbours under a size limit."""
    rng, n = np.random.default_rng(seed), len(x)
    limit = int(np.ceil(slack * n / parts))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres, part = unit[rng.choice(n, parts, replace=False)], np.zeros(n, np.int64)
    for _ in range(6):
        score = unit @ centres.T
        sizes, part = np.zeros(parts, np.int64), np.full(n, -1)
        choice = np.argsort(-score, axis=1)
        for row in np.argsort(-np.max(score, axis=1)):   # surest first; a full part passes a row on
            for p in choice[row]:
                if sizes[p] < limit:
                    part[row], sizes[p] = p, sizes[p] + 1
                    break
        for p in range(parts):
            if sizes[p]:
                mean = unit[part == p].mean(0)
                centres[p] = mean / max(np.linalg.norm(mean), 1e-12)
    # neighbours both ways
    source = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.reshape(-1)])
    target = np.concatenate([near.reshape(-1), np.repeat(np.arange(n), near.shape[1])])
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (source, part[target]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        moved = 0
        for row in np.argsort(-gain):
            if gain[row] <= 0:
                break
            if sizes[want[row]] < limit:
                sizes[part[row]] -= 1
                sizes[want[row]] += 1
                part[row], moved = want[row], moved + 1
        if not moved:
            break
    return part


class Router:
    """A softmax classifier with one hidden layer: vector -> probability of each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 4, rounds: int = 30, hidden: int = 128):
        rng, parts = np.random.default_rng(seed), target.shape[1]
        self.scale = 1 / max(float(np.sqrt((x * x).mean())), 1e-12)
        z = x * self.scale
        self.w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(rounds):
            for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
                h = np.maximum(z[at] @ self.w[0] + self.w[1], 0)
                d = (self._softmax(h @ self.w[2] + self.w[3]) - target[at]) / len(at)
                back = (d @ self.w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate([z[at].T @ back, back.sum(0), h.T @ d, d.sum(0)]):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 2e-3 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)

    @staticmethod
    def _softmax(a):
        e = np.exp(a - a.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the parts."""
        logits = np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def fit_parts(x: np.ndarray, parts: int) -> Router | None:
    """A classifier of about ``parts`` balanced parts of the sample's graph (None: one part)."""
    x = np.unique(x, axis=0)   # copies teach nothing
    parts = min(parts, len(x) // (2 * GRAPH))
    if parts < 2:
        return None
    near = graph(x, GRAPH)
    part = balanced_parts(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].reshape(-1)), 1 / near.shape[1])
    return Router(x, 0.5 * target + 0.5 * np.eye(parts)[part])


class Partition:
    """One or two levels of classifiers over numbered parts."""

    def __init__(self, coarse: Router | None, fine: dict[int, Router | None]):
        self.coarse, self.fine = coarse, fine
        counts = [fine[c].w[3].size if fine.get(c) else 1 for c in range(coarse.w[3].size if coarse else 1)]
        self.first = np.concatenate(([0], np.cumsum(counts)))

    @property
    def parts(self) -> int:
        return int(self.first[-1])

    def coarse_of(self, x: np.ndarray) -> np.ndarray:
        return self.coarse.logs(x).argmax(1) if self.coarse else np.zeros(len(x), np.int64)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that each row is indexed under."""
        out = self.coarse_of(x)
        at = self.first[out]
        for c in np.unique(out).tolist():
            if self.fine.get(c):
                mine = out == c
                at[mine] += self.fine[c].logs(x[mine]).argmax(1)
        return at

    def order(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k most probable parts of each row, best first; of the coarse parts, only as many as may hold them are opened."""
        k = min(k, self.parts)
        if not self.coarse:
            return np.zeros((len(x), 1), np.int64)
        out = np.zeros((len(x), k), np.int64)
        sizes, step = np.diff(self.first), max(1, CELLS // self.parts)
        opened = min(len(sizes), 4 + int(np.ceil(2 * k / sizes.mean())))
        while np.sort(sizes)[:opened].sum() < k:
            opened += 1
        for lo in range(0, len(x), step):
            part = x[lo:lo + step]
            logs = self.coarse.logs(part)
            joint = np.full((len(part), self.parts), -np.inf)
            top = np.argsort(-logs, axis=1, kind="stable")[:, :opened]
            for c in np.unique(top).tolist():
                mine = np.flatnonzero((top == c).any(1))
                fine = self.fine.get(c)
                joint[mine, self.first[c]:self.first[c + 1]] = logs[mine, c, None] + (fine.logs(part[mine]) if fine else 0.0)
            out[lo:lo + step] = np.argsort(-joint, axis=1, kind="stable")[:, :k]
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), dim)


def fit_partition(rows: DataFrame, dim: int, n: int, part_rows: int = PART_ROWS, sample_rows: int = SAMPLE_ROWS) -> Partition:
    """Levels of parts for ``n`` rows (vec_id, vec), each level fitted on about ``sample_rows`` rows at most."""
    parts = -(-n // part_rows)
    chosen = sampled(rows, "vec_id", min(1.0, sample_rows / max(n, 1))).groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy("vec_id").collect()
    x = np.array([r.vec for r in chosen], float).reshape(-1, dim)
    coarse = fit_parts(x, parts if parts <= ONE_LEVEL else min(SIDE, int(np.ceil(np.sqrt(parts)))))
    if coarse is None or parts <= ONE_LEVEL:
        return Partition(coarse, {})
    top = Partition(coarse, {})
    model = rows.sparkSession.sparkContext.broadcast(top)

    def route(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.coarse_of(_matrix(batch.column(1), dim)), pa.int64()), batch.column(1)],
                                             ["vec_id", "coarse", "vec"])

    routed = rows.mapInArrow(route, "vec_id long, coarse long, vec array<double>")
    sizes = {r.coarse: r.n for r in routed.groupBy("coarse").agg(F.count("*").alias("n")).collect()}   # a row for each coarse part
    limits = rows.sparkSession.createDataFrame([(c, int(min(1.0, sample_rows / 4 / m) * (2.0 ** 63 - 1024))) for c, m in sizes.items()], "coarse long, most long")
    samples = (routed.join(F.broadcast(limits), "coarse").where(F.xxhash64("vec_id").bitwiseAND(F.lit(2 ** 63 - 1)) <= F.col("most"))
               .groupBy("coarse", "vec_id").agg(F.min("vec").alias("vec")))

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group.sort_values("vec_id").vec.tolist(), float)
        return pd.DataFrame({"coarse": [key[0]], "model": [pickle.dumps(fit_parts(x, min(SIDE, -(-sizes[key[0]] // part_rows))))]})

    fitted = samples.groupBy("coarse").applyInPandas(fit, "coarse long, model binary").collect()   # a small network for each coarse part
    return Partition(coarse, {r.coarse: pickle.loads(bytes(r.model)) for r in fitted})


def measured_probes(placed: DataFrame, index: Partition, dim: int, n: int, k: int, target: float = TARGET) -> int:
    """The least number of parts that hold ``target`` of the true neighbours of about ``MEASURED`` rows, compared with all rows."""
    if index.parts == 1:
        return 1
    chosen = sampled(placed, "vec_id", min(1.0, MEASURED / max(n, 1))).groupBy("vec_id").agg(F.min("vec").alias("vec")).collect()
    if not chosen:
        return index.parts
    own, q = np.array([r.vec_id for r in chosen]), np.array([np.frombuffer(bytes(r.vec)) for r in chosen])

    def best(batches):
        scores, parts = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            ids, at = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            new = q @ np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, dim).T
            new[own[:, None] == ids[None]] = -np.inf
            scores, parts = np.hstack([scores, new]), np.hstack([parts, np.broadcast_to(at, new.shape)])
            keep = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            scores, parts = np.take_along_axis(scores, keep, 1), np.take_along_axis(parts, keep, 1)
        row = np.repeat(np.arange(len(q)), scores.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(parts.reshape(-1)), pa.array(scores.reshape(-1))], ["query", "part", "score"])

    found = placed.select("vec_id", "part", "vec").mapInArrow(best, "query long, part long, score double").where(F.col("score") > float("-inf"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "part"))
    true = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "part").collect()   # k rows for each of a few queries
    if not true:
        return index.parts
    place = np.argsort(index.order(q, index.parts), axis=1)
    places = np.sort([place[r.query, r.part] for r in true])
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1


FORM, BLOCK_FORM = "vec_id long, part long, vec binary", "part long, block long, ids binary, vecs binary"


def nearest(vectors: DataFrame, query, k: int = 20, probes: int | None = None, part_rows: int = PART_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row where the column expression ``query`` (of vec_id) holds.

    ``probes`` sets the number of parts to look into; measured if not given.
    """
    rows, dim = usable(vectors)
    spark = rows.sparkSession
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stored(rows, "ann-vectors")
    n = rows.count()
    index = fit_partition(rows, dim, n, part_rows, sample_rows)
    model = spark.sparkContext.broadcast(index)   # at most SIDE small networks

    def route(count):
        def run(batches):
            for batch in batches:
                x = _matrix(batch.column(1), dim)
                best = model.value.order(x, count) if count else model.value.home(x)[:, None]
                at = np.repeat(np.arange(len(batch)), best.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(best.reshape(-1)),
                                                  pa.array([x[i].tobytes() for i in at], pa.binary())], ["vec_id", "part", "vec"])
        return run

    placed = stored(rows.mapInArrow(route(0), FORM), "ann-rows")
    probes = min(probes or measured_probes(placed, index, dim, n, k), index.parts)

    def blocked(table: DataFrame) -> DataFrame:
        """Rows of a part in blocks of about BLOCK_ROWS."""
        sizes = table.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))   # a row for each part
        dealt = (table.join(F.broadcast(sizes), "part")
                 .withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("blocks"))))

        def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [key[0]], "block": [key[1]], "ids": [rows.vec_id.to_numpy(np.int64).tobytes()], "vecs": [b"".join(rows.vec)]})

        return stored(dealt.groupBy("part", "block").applyInPandas(block, BLOCK_FORM), "ann-blocks")

    candidates = blocked(placed)
    blocks = candidates.groupBy("part").agg(F.collect_set("block").alias("blocks"))

    def search(asking: DataFrame, probes: int) -> DataFrame:
        asked = asking.mapInArrow(route(probes), FORM)
        buckets = max(1, -(-asking.count() * probes * k // BUCKET_ROWS))

        def compare(batches):
            for batch in batches:
                for q_ids, q_vecs, c_ids, c_vecs in zip(*(c.to_pylist() for c in batch.columns)):
                    q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                    found = np.concatenate([*best_pairs(q_ids, np.frombuffer(q_vecs).reshape(-1, dim), c_ids, np.frombuffer(c_vecs).reshape(-1, dim), k),
                                            np.zeros(0, FOUND)])
                    bucket = (mixed(found["query"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(bucket[order][edges]), pa.array([x.tobytes() for x in np.split(found[order], edges[1:])][:len(edges)], pa.binary())], ["bucket", "found"])

        def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            found = np.concatenate([np.frombuffer(x, FOUND) for x in rows.found])
            found = found[np.lexsort((found["row"], -found["score"], found["query"]))]
            rank = np.arange(len(found)) - np.searchsorted(found["query"], found["query"]) + 1
            found, rank = found[rank <= k], rank[rank <= k]
            return pd.DataFrame({"query_id": found["query"], "rank": rank.astype(np.int32), "vec_id": found["row"], "score": found["score"]})

        questions = blocked(asked).select("part", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
        # a key for each block of rows: a large part is no large key
        each = questions.join(F.broadcast(blocks), "part").select("part", F.explode("blocks").alias("block"), "q_ids", "q_vecs")
        return (each.join(candidates, ["part", "block"]).select("q_ids", "q_vecs", "ids", "vecs").mapInArrow(compare, "bucket long, found binary")
                .groupBy("bucket").applyInPandas(merge, "query_id long, rank int, vec_id long, score double"))

    asking = rows.where(query).select("vec_id", "vec")
    found = search(asking, probes)
    if probes == index.parts:
        return found
    found = stored(found, "ann-found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asking.join(full, "vec_id", "left_anti")
    if short.isEmpty():
        return found
    again = stored(short, "ann-short")
    return (found.join(small(again.select(F.col("vec_id").alias("query_id")).distinct()), "query_id", "left_anti").select(*found.columns)
            .unionByName(search(again, index.parts)))


def best_pairs(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """Arrays (query, row, score) with each query's best k of the candidates."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    most = float(np.sqrt((c * c).sum(1).max(initial=0)))
    step = max(1, CELLS // max(1, len(c)))
    for lo in range(0, len(q), step):
        part, own = q[lo:lo + step], q_ids[lo:lo + step]
        score = part @ c.T
        score[own[:, None] == c_ids[None]] = -np.inf
        if len(c) > k:   # a product of matrices rounds in its own way: what may belong to the best is added up anew
            least = np.partition(score, len(c) - k, axis=1)[:, len(c) - k]
            least = least - 1e-12 * (1 + most * np.sqrt((part * part).sum(1)))
            row, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        else:
            row, at = np.nonzero(score > -np.inf)
        value = np.concatenate([np.einsum("ij,ij->i", part[row[s:s + 65536]], c[at[s:s + 65536]]) for s in range(0, len(row), 65536)] or [np.zeros(0)])
        best = np.lexsort((at, -value, row))
        row, at, value = row[best], at[best], value[best]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out = np.zeros(int(keep.sum()), FOUND)
        out["query"], out["row"], out["score"] = own[row[keep]], c_ids[at[keep]], value[keep]
        yield out


def op8_learned_partitions(spark, sf_dir: str) -> DataFrame:
    """Registered query: the 20 nearest of every row whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
