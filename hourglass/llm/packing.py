"""Operator 3 — variable-capacity best-fit packing.

Global best-fit decreasing over all documents, computed on the histogram of
lengths.  Bins with the same free space are one group, so the plan handles
whole runs of equal items and equal bins: its size depends on the largest
permitted length alone, not on the number of documents.  Documents then get a
rank within their length and find their bin by searching the plan.

An item goes to the open bin with the least free space that holds it (ties:
the bin opened first).  If none does, a bin of the permitted size is opened
that costs least for each token when filled with items of this length (ties:
the larger).  At the end each bin is downsized to the smallest permitted size
that holds its contents.  Documents longer than the largest size are cut into
pieces of that size and a rest; nothing is dropped.

Null and empty texts are packed with their end token alone (length 1); rows
with equal or null ids are rows of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored

#: Permitted sequence lengths and the cost of a bin of each: its tokens and a share that grows with their square.
SIZES = (512, 1024, 2048, 4096)
#: Rows that one (length, salt) group holds on average at most.
GROUP_ROWS = 10_000


def cost(size: int) -> float:
    return size * (1 + size / 65536)


def opening_size(length: int, sizes, cost=cost) -> int:
    """The size to open for items of ``length``: least cost per token filled with them, ties to the larger."""
    return min((s for s in sizes if s >= length), key=lambda s: (cost(s) / (s // length * length), -s))


def plan_bins(histogram: dict[int, int], sizes=SIZES, cost=cost):
    """Best-fit decreasing on runs.

    Returns (placements, bins): placements (length, first rank, items, items a
    bin, first bin, offset of the first item), bins (first bin, bins, size
    opened, tokens used).
    """
    free: list[int] = []                       # sorted free spaces that have open bins
    groups: dict[int, list] = defaultdict(list)  # free space -> heap of (first bin, bins, size, used)
    placements, next_bin = [], 0

    def put(run):
        space = run[2] - run[3]
        if not groups[space]:
            bisect.insort(free, space)
        heapq.heappush(groups[space], run)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, bins, size, used = heapq.heappop(groups[space])
                if not groups[space]:
                    free.pop(at)
            else:
                size = opening_size(length, sizes, cost)
                first, bins, used, space = next_bin, -(-left // (size // length)), 0, size
                next_bin += bins
            each = space // length
            full = min(bins, left // each)
            if full:
                placements.append((length, rank, full * each, each, first, used))
                put((first, full, size, used + each * length))
                rank, left = rank + full * each, left - full * each
            if full < bins and left:   # fewer than a full bin's items are left
                placements.append((length, rank, left, left, first + full, used))
                put((first + full, 1, size, used + left * length))
                rank, left, full = rank + left, 0, full + 1
            if full < bins:
                put((first + full, bins - full, size, used))
    return placements, sorted(run for heap in groups.values() for run in heap)


def pack_lengths(rows: DataFrame, sizes=SIZES, cost=cost) -> DataFrame:
    """Pack rows (doc_id, length >= 1): doc_id, piece, start, length, bin_id, bin_offset, bin_capacity, bin_used."""
    largest, sizes = max(sizes), sorted(sizes)
    n = rows.count()
    salts = max(1, -(-n // GROUP_ROWS))
    parts = (rows.select("doc_id", F.col("length").alias("whole"),
                         F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / largest).cast("int"))).alias("piece"))
             .select("doc_id", "piece", (F.col("piece") * largest).cast("long").alias("start"),
                     F.least(F.lit(largest).cast("long"), F.col("whole") - F.col("piece") * largest).cast("long").alias("length"),
                     (F.monotonically_increasing_id() % salts).alias("salt")))
    parts = stored(parts, "packing-pieces")
    sizes_of = parts.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # lengths x salts rows: the ranks that a group starts from
    from pyspark.sql import Window
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes_of.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}   # at most max(sizes) rows
    placements, bins = plan_bins(histogram, sizes, cost)
    by_length: dict[int, list] = defaultdict(list)
    for p in placements:
        by_length[p[0]].append(p[1:])
    table = {k: np.array(v, np.int64) for k, v in by_length.items()}
    runs = np.array(bins, np.int64).reshape(-1, 4)
    steps = np.array(sizes)

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), np.int64) for c in ("length", "rank"))
            bin_id, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(order)]):
                at = order[lo:hi]
                plan = table[int(length[at[0]])]
                row = plan[np.searchsorted(plan[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                bin_id[at], offset[at] = row[:, 3] + k // row[:, 2], row[:, 4] + k % row[:, 2] * length[at]
            run = runs[np.searchsorted(runs[:, 0], bin_id, "right") - 1] if len(bin_id) else runs
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length")]
            capacity = steps[np.searchsorted(steps, run[:, 3])].astype(np.int64)
            yield pa.RecordBatch.from_arrays([*keep, pa.array(bin_id), pa.array(offset), pa.array(capacity), pa.array(run[:, 3])],
                                             ["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_capacity", "bin_used"])

    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = (parts.withColumn("number", F.row_number().over(within)).join(starts, ["length", "salt"])
              .select("doc_id", "piece", "start", "length", (F.col("from") + F.col("number") - 1).alias("rank")))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, bin_id long, bin_offset long, "
                                    "bin_capacity long, bin_used long")


def word_lengths(docs: DataFrame) -> DataFrame:
    """Words of each text and one end token."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (words + 1).cast("long").alias("length"))


def bin_texts(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The packed sequences as texts: bin_id, bin_capacity, text (pieces in order, words joined by blanks).

    Needs ids that are not repeated.  A bin holds at most its capacity of words.
    """
    words = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    cut = packed.join(words, "doc_id").select("bin_id", "bin_capacity", "bin_offset", F.array_join(
        F.slice("words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ").alias("part"))
    return (cut.groupBy("bin_id", "bin_capacity").agg(F.sort_array(F.collect_list(F.struct("bin_offset", "part"))).alias("parts"))
            .select("bin_id", "bin_capacity", F.array_join(F.col("parts.part"), " ").alias("text")))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents, each as its words and an end token."""
    return pack_lengths(word_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
