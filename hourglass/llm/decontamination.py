"""Operator 9 — benchmark decontamination by edit distance.

A benchmark item of n words is in a document if some stretch of it, of n - K to
n + K words, is within K = ``ratio`` times n word edits (insert, delete,
replace).  Words are lower-cased runs of ASCII letters, digits and bytes beyond
ASCII.

Windows of every item length are looked at, from K words before a document's
first word to its last word; places outside the document are padding:

1. q-gram lemma: if a stretch from the window's start on is within K edits of
   an item of n words, the window's n words hold at least n - 1 - 2K word pairs
   (n - K words, for items under 8 words) of the item: an insertion breaks one
   pair and moves at most one out of the window, other edits break two.
   Counting hits in a table of hashed pairs, with a bit for each item length,
   leaves out, without loss, nearly all windows.
2. CGK embedding: a random walk through a window's words writes 3n symbols; it
   repeats a symbol or goes on by a random bit of (step, word).  Small edit
   distance becomes small Hamming distance.
3. Bit sampling: a key is a few sampled places of one walk; windows and items
   that share one of ``WALKS * SAMPLES`` keys are compared (tests measure the
   recall at the largest distance: at least 0.95).
4. The exact edit distance to the best stretch that begins up to K words before
   or after the window does decides, by a banded table over all pairs at once.

The documents are read in one pass for each ``ITEM_BLOCK`` items, whose index
is broadcast; there is no shuffle, and a passage that a third of all rows
share is found in each where it stands.

Items without a word match nothing; null and empty texts hold nothing; items
with equal texts or ids are found each for itself; rows with equal or null ids
are rows of their own; empty tables give an empty result; other columns are
passed over (``contaminated``) or kept (``keep_uncontaminated``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mixed, randoms

RATIO, WALKS, SAMPLES, PLACES, ITEM_BLOCK = 0.2, 4, 12, 2, 20_000
#: Windows that are embedded together at most, and words of windows (and of edit tables) held at once.
TOGETHER, CELLS = 16_384, 1 << 21
#: The bitmap's size as a power of two; items under SHORT words count words instead of pairs.
BITS, SHORT = 20, 8

SEPARATORS = np.arange(256) < 128
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    SEPARATORS[_a:_b] = False
PAD = np.uint64(0x9D0F00D5EED5ED5E)


def _pairs(words: np.ndarray) -> np.ndarray:
    """A hash for each word and its follower (the last one's is of no use)."""
    with np.errstate(over="ignore"):
        return mixed(words * np.uint64(0x9E3779B97F4A7C15) + np.roll(words, -1))


def embed(windows: np.ndarray, walk: int, steps: int | None = None) -> np.ndarray:
    """CGK embeddings of equally long rows of word hashes: rows of 3n symbols (or the first ``steps``)."""
    rows, n = windows.shape
    steps = steps or 3 * n
    padded = np.concatenate([windows, np.full((rows, 1), PAD)], 1)
    turns = randoms(100 + walk, 3 * n) | np.uint64(1)
    out, at, line = np.empty((steps, rows), np.uint64), np.zeros(rows, np.int64), np.arange(rows) * (n + 1)
    flat = padded.reshape(-1)
    for step in range(steps):
        symbol = out[step] = flat[line + at]
        with np.errstate(over="ignore"):
            at += ((symbol * turns[step]) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, n, out=at)
    return out.T


def keys(windows: np.ndarray) -> np.ndarray:
    """One column for each walk and sampling."""
    n = windows.shape[1]
    out = []
    for walk in range(WALKS):
        symbols = embed(windows, walk, 2 * n)   # sampled places: the walk's end is mostly padding
        for sampling in range(SAMPLES):
            number = np.uint64(walk * SAMPLES + sampling + 1)
            at = (randoms(500 + int(number), PLACES) % np.uint64(2 * n)).astype(np.int64)
            with np.errstate(over="ignore"):
                key = np.full(len(windows), number)
                for place in at:
                    key = mixed(key * np.uint64(0xD1342543DE82EF95) + symbols[:, place])
            out.append(key)
    return np.stack(out, 1)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of paired rows, the edit distance of a row of ``a`` to the nearest stretch of the row of ``b``, and where that begins.

    Stretches begin at one of the first ``slack + 1`` words (of equally near
    ones the first) and end anywhere.  Exact up to ``most``, above it some
    larger distance.  One banded table for all beginnings: an entry is the
    distance times a unit plus the beginning, so a minimum takes both along; a
    row of it is four array operations.
    """
    (rows, n), long = a.shape, b.shape[1]
    width, unit = 2 * most + 1 + slack, slack + 2
    far = (most + 1) * unit
    shift = np.arange(width) * unit
    # band[:, d]: the first i words of a against the words of b up to i + d - most
    j = np.arange(width) - most
    band = np.where(j < 0, far, np.maximum(j - slack, 0) * unit + np.minimum(j, slack))[None].repeat(rows, 0)
    padded = np.concatenate([np.full((rows, most + 1), PAD), b, np.full((rows, max(0, n + width - most - long)), PAD)], 1)
    for i in range(1, n + 1):
        j = i + np.arange(width) - most
        cost = (a[:, i - 1, None] != padded[:, i:i + width]) * unit   # (its column i + d is word i + d - most of b)
        new = band + cost
        new[:, :-1] = np.minimum(new[:, :-1], band[:, 1:] + unit)
        new[:, (j < 0) | (j > long)] = far
        if i <= most:
            new[:, most - i] = i * unit
        new = np.minimum.accumulate(new - shift, axis=1) + shift
        new[:, (j < 0) | (j > long)] = far
        band = np.minimum(new, far)
    best = band.min(1)
    return best // unit, best % unit


class ItemIndex:
    """A block of items, ready to be looked up."""

    def __init__(self, item_ids: list, words: list[np.ndarray], ratio: float):
        self.by_length: dict = {}
        # for each hash slot, a bit for each item length that has such a pair (or word, for short items)
        self.slots = {True: np.zeros(1 << BITS, np.uint64), False: np.zeros(1 << BITS, np.uint64)}
        shift = np.uint64(64 - BITS)
        for number, n in enumerate(sorted({len(w) for w in words if len(w)})):
            at = [k for k, w in enumerate(words) if len(w) == n]
            own = np.stack([words[k] for k in at])
            most, bit, long = int(ratio * n), np.uint64(1) << np.uint64(number % 64), n >= SHORT
            grams = np.concatenate([_pairs(w)[:-1] for w in own]) if long else own.reshape(-1)
            np.bitwise_or.at(self.slots[long], (grams >> shift).astype(np.int64), bit)
            key = keys(own)
            order = np.argsort(key, axis=0, kind="stable")
            self.by_length[n] = ([item_ids[k] for k in at], own, most, np.take_along_axis(key, order, 0), order, bit,
                                 n - 1 - 2 * most if long else n - most)

    def windows(self, words: np.ndarray, first: np.ndarray):
        """(n, rows, starts) of the windows that may hold an item of n words; a start may be before its row's first word."""
        if not len(words) or not self.by_length:
            return
        shift = np.uint64(64 - BITS)
        filled = np.diff(first) > 0
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pair = self.slots[True][_pairs(words) >> shift]
        pair[first[1:][filled] - 1] = 0                           # a row's last word has no follower
        hits = {}
        for long, mask in ((True, pair), (False, self.slots[False][words >> shift])):
            at = np.flatnonzero(mask)
            hits[long] = (at, mask[at])
        for n, (_, _, most, _, _, bit, need) in self.by_length.items():
            at, mask = hits[n >= SHORT]
            at = at[(mask & bit) != 0]
            reach = n - 2 if n >= SHORT else n - 1
            if len(at) < need:
                continue
            # runs of ``need`` hits of a row that one window can hold, and the windows that hold them
            begin, last = at[:len(at) - need + 1], at[need - 1:]
            tight = np.flatnonzero((last - begin <= reach) & (rows[begin] == rows[last]))
            if not len(tight):
                continue
            row, hi = rows[begin[tight]], begin[tight]
            lo = np.maximum(last[tight] - reach, first[row] - most)
            # each row's starts have a range of numbers of their own
            lo, hi = lo + (row + 1) * most, hi + (row + 1) * most
            count = hi - lo + 1
            start = np.unique(np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - lo, count))
            row = np.searchsorted(first + np.arange(len(first)) * most, start, "right") - 1
            yield n, row, start - (row + 1) * most

    def search(self, column: pa.Array) -> dict:
        """(row, length, item) -> (distance, start word): for each row and item the window of least distance, the first of those."""
        found: dict = {}
        waiting: dict = {}
        for lo, _, words, first in hashed_words(column, True, SEPARATORS):
            for n, row, start in self.windows(words, first):
                most, held = self.by_length[n][2], waiting.setdefault(n, [])
                together = max(16, min(TOGETHER, CELLS // (n + 3 * most)))
                for k in range(0, len(start), together):
                    part = start[k:k + together]
                    own = row[k:k + together]
                    at = part[:, None] + np.arange(-most, n + 2 * most)
                    inside = (at >= first[own][:, None]) & (at < first[own + 1][:, None])
                    held.append((np.where(inside, words[np.where(inside, at, 0)], PAD), own + lo, part - first[own]))
                    if sum(len(x[1]) for x in held) >= together:
                        self._look(n, held, found)
                        held.clear()
        for n, held in waiting.items():
            if held:
                self._look(n, held, found)
        return found

    def _look(self, n: int, held: list, found: dict) -> None:
        stretches, row, start = (np.concatenate(x) for x in zip(*held))
        _, own, most, key, order, _, _ = self.by_length[n]
        windows = stretches[:, most:most + n]
        mine = keys(windows)
        pairs = []
        for c in range(mine.shape[1]):
            lo, hi = np.searchsorted(key[:, c], mine[:, c], "left"), np.searchsorted(key[:, c], mine[:, c], "right")
            count = hi - lo
            if count.any():
                w = np.repeat(np.arange(len(windows)), count)
                pairs.append(w * len(own) + order[np.arange(len(w)) - np.repeat(np.cumsum(count) - count - lo, count), c])
        if not pairs:
            return
        w, k = np.divmod(np.unique(np.concatenate(pairs)), len(own))
        same = (windows[w] == own[k]).all(1)
        finds = [(row[w[same]], k[same], start[w[same]], np.zeros(int(same.sum()), np.int32))]
        # a row's item that stands there unchanged needs no distances
        of = row[w] * len(own) + k
        rest = np.flatnonzero(~np.isin(of, of[same]))
        # of the windows that begin within most + 1 words, one: all starts up to most words off are looked at
        rest = rest[np.unique(np.stack([of[rest], start[w[rest]] // (most + 1)]), axis=1, return_index=True)[1]]
        step = max(16, CELLS // (5 * most + n + 1))
        for part in (rest[k:k + step] for k in range(0, len(rest), step)):
            d, off = edit_distances(own[k[part]], stretches[w[part]], most, 2 * most)
            near = d <= most
            finds.append((row[w[part]][near], k[part][near], np.maximum(start[w[part]][near] - most + off[near], 0), d[near].astype(np.int32)))
        for r, item, s, d in zip(*(np.concatenate(x).tolist() for x in zip(*finds))):
            if (d, s) < found.get((r, n, item), (most + 1, 0)):
                found[r, n, item] = (d, s)

    def name(self, n: int, item: int):
        return self.by_length[n][0][item]


def item_indexes(benchmark: DataFrame, ratio: float = RATIO):
    """Broadcast indexes of at most about ITEM_BLOCK items each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        parts = [words[first[k]:first[k + 1]] for _, _, words, first in hashed_words(pa.array([r.text for r in rows], pa.string()), True, SEPARATORS)
                 for k in range(len(first) - 1)]
        yield spark.sparkContext.broadcast(ItemIndex([r.item_id for r in rows], parts, ratio))


def contaminated(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO) -> DataFrame:
    """doc_id, item_id, start_word, distance of every document and item that it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in item_indexes(benchmark, ratio):
        def look(batches, index=index):
            for batch in batches:
                found = index.value.search(batch.column(1))
                if found:
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array([r for r, _, _ in found])), pa.array([index.value.name(n, i) for _, n, i in found], pa.int64()),
                        pa.array([s for _, s in found.values()], pa.int64()), pa.array([d for d, _ in found.values()], pa.int32())],
                        ["doc_id", "item_id", "start_word", "distance"])

        part = rows.mapInArrow(look, "doc_id long, item_id long, start_word long, distance int")
        out = part if out is None else out.unionByName(part)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Filter: the rows, all columns as they are, that hold no item."""
    place = docs.columns.index("text")
    for index in item_indexes(benchmark, ratio):
        def keep(batches, index=index):
            for batch in batches:
                stay = np.ones(len(batch), bool)
                stay[[r for r, _, _ in index.value.search(batch.column(place))]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents against all items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
