"""Operator 7 — quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Words (lower-cased, hashed to a fixed number of slots) and their shapes
(letters, capitals, digits and marks as runs) have sparse random index
vectors; a slot's word vector is the sum of the index vectors of its
neighbours, scaled to unit length.  A document is the mean of its word
vectors, the mean of its shapes' index vectors, and eight measures (length,
share of capitals, marks, digits, repeated neighbours, ...).  A network with
one hidden layer of ReLU units and a sigmoid is fitted by Adam on standardised
features; a temperature chosen on a fifth of the fitted rows calibrates it.

Word vectors are summed over the whole texts of all documents (no labels go
in).  The network is fitted on a bounded sample of labelled rows: at most
``fit_rows`` by expectation, chosen by a hash of the id, repeated ids once
(their smallest text).  All rows and whole texts are scored.

Null and empty texts are scored like any other (no words: zero vectors);
conflicting labels of an id count by their mean; without labelled rows, or
with one class alone, every score is the labelled share (0.5 without any);
rows with equal or null ids are rows of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, hashed, pack, pieces, randoms, release, remainder, sampled, small, stored, text_bytes, unpack, word_spans

#: Rows fitted on at most (by expectation); word slots; dimensions; nonzeros of an index vector; hidden units.
FIT_ROWS, SLOTS, DIM, NONZERO, HIDDEN = 20_000, 1 << 14, 64, 4, 32
#: Shape classes of bytes: blank, lower, capital, digit, beyond ASCII, then each ASCII mark for itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = ord("x"), ord("X"), ord("d"), ord("x")
SHAPE_SLOTS = 512
#: Words whose vectors are gathered at once; rows whose shapes are counted at once.
POOLED, SHAPE_ROWS = 4096, 1024
#: Blocks of slots whose sums are added in one task; tasks a core that the word vectors are summed in at most.
BLOCKS, TASKS = 16, 8


def _index_places(slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of the NONZERO entries of each slot's index vector; entries of one dimension add up."""
    values = randoms(seed, slots * NONZERO).reshape(slots, NONZERO)
    return (values % np.uint64(DIM)).astype(np.int64), np.where(values >> np.uint64(63), 1.0, -1.0)


def _index_vectors(places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), DIM), np.float32)
    for at, sign in zip(places.T, signs.T):
        out[np.arange(len(places)), at] += sign
    return out


PLACES, SIGNS = _index_places(SLOTS, 11)
INDEX, SHAPE_INDEX = _index_vectors(PLACES, SIGNS), _index_vectors(*_index_places(SHAPE_SLOTS, 12))


def _read(data: np.ndarray, offsets: np.ndarray):
    """(word slots, shape slots, first word of each row, word hashes)."""
    starts, ends, first = word_spans(data, offsets)
    words = hashed(LOWERED[data], starts, ends)
    kind = SHAPE[data]
    # runs of one class count once: a byte equal to the one before it in its word drops out
    again = np.zeros(len(kind), bool)
    again[1:] = kind[1:] == kind[:-1]
    again[starts] = False
    place = np.concatenate(([0], np.cumsum(~again)))
    shapes = hashed(kind[~again], place[starts], place[ends])
    return (words % np.uint64(SLOTS)).astype(np.int64), (shapes % np.uint64(SHAPE_SLOTS)).astype(np.int64), first, words


def _means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of each row's values (zero for rows without any)."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=float)])
    return ((total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]).astype(np.float32)


def _pooled(vectors: np.ndarray, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the vectors of each row's slots (zero for rows without any)."""
    out, bounds = np.zeros((len(first) - 1, vectors.shape[1]), np.float32), first.tolist()
    for row, (a, b) in enumerate(zip(bounds, bounds[1:])):
        for lo in range(a, b, POOLED):
            near = vectors.take(slots[lo:min(lo + POOLED, b)], axis=0)
            out[row] += np.ones(len(near), np.float32) @ near
    return out / np.maximum(np.diff(first), 1)[:, None].astype(np.float32)


def _shape_means(shapes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the index vectors of each row's shapes: counts of shapes by row, times the vectors."""
    out = np.zeros((len(first) - 1, DIM), np.float32)
    for lo in range(0, len(out), SHAPE_ROWS):
        hi = min(lo + SHAPE_ROWS, len(out))
        count = np.diff(first[lo:hi + 1])
        counts = np.bincount(np.repeat(np.arange(hi - lo), count) * SHAPE_SLOTS + shapes[first[lo]:first[hi]], minlength=(hi - lo) * SHAPE_SLOTS)
        out[lo:hi] = counts.reshape(hi - lo, SHAPE_SLOTS).astype(np.float32) @ SHAPE_INDEX / np.maximum(count, 1)[:, None]
    return out


def features(column: pa.Array, vectors: np.ndarray):
    """Feature rows of a text column, piece by piece."""
    data, offsets = text_bytes(column)
    for lo, hi in pieces(offsets):
        part, bounds = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        slots, shapes, first, words = _read(part, bounds)
        pooled = [_pooled(vectors, slots, first), _shape_means(shapes, first)]
        kind, size = SHAPE[part], np.maximum(np.diff(bounds), 1)

        def share(mask):
            total = np.concatenate(([0], np.cumsum(mask)))
            return (total[bounds[1:]] - total[bounds[:-1]]) / size

        count = np.diff(first)
        same = np.zeros((len(words), 2), np.float32)
        if len(words) > 1:
            same[1:, 0] = words[1:] == words[:-1]
        if len(words) > 2:
            same[2:, 1] = words[2:] == words[:-2]
        row = np.repeat(np.arange(hi - lo), count)
        # rows and words in one number (a batch has fewer rows than 2^20; 44 bits tell the words of one text apart)
        key = np.sort(row.astype(np.uint64) << np.uint64(44) | words >> np.uint64(20))
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        distinct = np.bincount((key[fresh] >> np.uint64(44)).astype(np.int64), minlength=hi - lo) / np.maximum(count, 1)
        measures = np.stack([np.log1p(count), share(kind == ord("X")), share(kind == ord("d")), share((part < 128) & (kind == part) & (part > 32)),
                             share(part == 10), distinct, size / np.maximum(count, 1)], 1)
        yield lo, hi, np.concatenate([*pooled, _means(same, first), np.minimum(measures, 50)], 1).astype(np.float32)


class Network:
    """Two layers in numpy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, rounds: int = 60, batch: int = 256):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        n, check = len(x), np.zeros(len(x), bool)
        check[rng.permutation(n)[:n // 5]] = True
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        fit, held = np.flatnonzero(~check), np.flatnonzero(check)
        self.w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        first, second, t, best = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0, (np.inf, None)
        for _ in range(rounds):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
                grads, t = self._gradient(z[at], y[at]), t + 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 2e-3 * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
            if len(held):
                loss = self._loss(self._logit(z[held]), y[held])
                if loss < best[0]:
                    best = (loss, [w.copy() for w in self.w])
        if best[1] is not None:
            self.w = best[1]
            logits = self._logit(z[held])
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            self.temperature = float(min(grid, key=lambda s: self._loss(logits / s, y[held])))

    @staticmethod
    def _loss(logit, y):
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    def _logit(self, z):
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3][0]

    def _gradient(self, z, y):
        h = np.maximum(z @ self.w[0] + self.w[1], 0)
        d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3][0]))) - y) / len(y)
        back = np.outer(d, self.w[2]) * (h > 0)
        return [z.T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ d, np.array([d.sum()])]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self._logit(z) / self.temperature, -40, 40)))


class QualityModel:
    def __init__(self, vectors: np.ndarray, network: Network | None, share: float):
        self.vectors, self.network, self.share = vectors, network, share

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(column), self.share)
        out = np.zeros(len(column))
        for lo, hi, x in features(column, self.vectors):
            out[lo:hi] = self.network.probability(x)
        return out


def _slots(part: np.ndarray, bounds: np.ndarray):
    """(word slots, first word of each row)."""
    starts, ends, first = word_spans(part, bounds)
    return (hashed(LOWERED[part], starts, ends) % np.uint64(SLOTS)).astype(np.int64), first


def neighbour_sums(batches) -> np.ndarray:
    """Each slot's sum of its neighbours' index vectors, over the texts of the batches (whole numbers)."""
    sums = np.zeros(SLOTS * DIM)
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for lo, hi in pieces(offsets):
            slots, first = _slots(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            near = np.ones(len(slots), bool)
            near[first[:-1][np.diff(first) > 0]] = False   # a row's first word has no left neighbour
            right = np.flatnonzero(near)
            a, b = np.concatenate([slots[right], slots[right - 1]]), np.concatenate([slots[right - 1], slots[right]])
            for at, sign in zip(PLACES.T, SIGNS.T):
                sums += np.bincount(a * DIM + at[b], weights=sign[b], minlength=SLOTS * DIM)
    release()
    return sums.reshape(SLOTS, DIM).astype(np.int64)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit word vectors of all slots from all texts (slots without neighbours: their index vector).

    Each task sends its sums once, in blocks of slots; there are at most
    ``TASKS`` tasks a core, whatever the input, so a block's sums are added in
    one task as they arrive.  The driver gets SLOTS x DIM numbers.
    """
    sc = texts.sparkSession.sparkContext
    blocks = np.array_split(np.arange(SLOTS), BLOCKS)

    def learn(batches):
        sums = neighbour_sums(batches)
        used = [k for k, block in enumerate(blocks) if sums[block].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pack(sums[blocks[k]].reshape(-1)) for k in used], pa.binary())], ["block", "sums"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = unpack(value.as_py())[0]
                total[k] = total[k] + got if k in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(v) for v in total.values()], pa.binary())], ["block", "sums"])

    parts = texts.coalesce(TASKS * sc.defaultParallelism).mapInArrow(learn, "block int, sums binary")
    vectors = np.zeros((SLOTS, DIM))
    for r in parts.repartition(BLOCKS, "block").mapInArrow(add, "block int, sums binary").collect():   # SLOTS x DIM numbers
        vectors[blocks[r.block]] = unpack(bytes(r.sums))[0].reshape(-1, DIM)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.where(norms > 0, vectors / np.maximum(norms, 1e-9), INDEX / 2).astype(np.float32)


def fit_quality(docs: DataFrame, labels: DataFrame, train, label: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    spark = docs.sparkSession
    marks = (labels.where(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
             .where(train).groupBy("doc_id").agg(F.avg("y").alias("y")))
    n = marks.count()
    share = min(1.0, fit_rows / max(n, 1))
    chosen = sampled(marks, "doc_id", share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # about fit_rows ids; of several texts of an id the smallest
    rows = stored(texts.join(small(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
                  .repartition(16, "doc_id").select("text", "y"), "quality-sample")
    vectors = word_vectors(texts.select("text"))
    table = spark.sparkContext.broadcast(vectors)   # SLOTS x DIM, whatever the input

    def describe(batches):
        for batch in batches:
            y = np.asarray(batch.column(1), float)
            for lo, hi, x in features(batch.column(0), table.value):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y[lo:hi].tobytes()], pa.binary())], ["x", "y"])

    parts = rows.mapInArrow(describe, "x binary, y binary").collect()   # about fit_rows rows of numbers
    y = np.concatenate([np.frombuffer(p.y) for p in parts]) if parts else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return QualityModel(vectors, None, float(y.mean()) if len(y) else 0.5)
    x = np.concatenate([np.frombuffer(p.x, np.float32).reshape(-1, 2 * DIM + 9) for p in parts])
    order = np.lexsort((x[:, 0], x[:, 1], y))   # the same network whichever order the parts came in
    return QualityModel(vectors, Network(x[order].astype(float), y[order]), float(y.mean()))


def quality_scores(docs: DataFrame, labels: DataFrame, train, least: float = 0.7, label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= least) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, train, label, fit_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~train).alias("held_out"), F.col("text").cast("string").alias("text"))

    def predict(batches):
        for batch in batches:
            scores = model.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= least).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents, learned from labels of those whose crc32 remainder modulo 4 is not 2."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 4) != 2)
