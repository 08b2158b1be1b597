"""Operator 6 — similarity join of documents on word shingles, and its components.

Two documents link when 100 |A & B| >= percent |A | B| for their sets of
distinct shingles.  Exact, in five steps:

1. Every document becomes its set (sorted 64-bit hashes); equal sets are one
   class from here on (a 128-bit digest names it).
2. A linked set shares all but D = n - ceil(percent n / 100) of its shingles.
   Blocks of documents ask, for the shingles in a fixed part of the hash
   range, which occur in one class only; a set with more than D of those can
   have no link and goes.  A shingle is asked once per block.
3. The sets that stay ask for the frequencies of all their shingles.  In
   the order (frequency, hash), a set's first D + 1 shingles are its index
   entries (prefix filter); sets whose entries are theirs alone go.
4. Answers by set relations: each set is compared with one hub, the set that
   most often leads its index lists.  Sets that link to the same hub are in one
   component, and their overlaps with the hub bound (and often settle) the
   overlap between two sets of that hub without reading them.
5. What is left: pairs in an index list, between components, by size and
   position.  A list is sorted by size and cut into blocks; a block whose
   largest rest cannot reach the overlap that the sizes need is skipped whole,
   pairs are tested by the same bound.  Survivors are compared exactly.

Lists longer than ``RUN_ROWS`` are cut into parts and compared part by part.
Components of the links come from star steps on tables.

Null and empty texts have an empty set, no link, and their own id as
component; a document with fewer words than a shingle has its whole sequence
as the one shingle; repeated rows and ids are rows of their own; rows with a null
id take part like all others (their component is null if no row of it has an id); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import secrets

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, hashed_words, mixed, pack, randoms, small, stored, unpack
from .components import components

#: Shingles of a block; shingles of a bucket; rows of an index list that one task compares; rows skipped together.
BLOCK_SHINGLES, BUCKET_SHINGLES, RUN_ROWS, SKIP = 1_500_000, 1_000_000, 20_000, 64

FACTORS = randoms(7, 64) | np.uint64(1)


def _sets(words: np.ndarray, first: np.ndarray, width: int):
    """(sorted distinct shingles of all rows, first of each row and the total)."""
    rows = len(first) - 1
    count = np.diff(first)
    with np.errstate(over="ignore"):
        if len(words) >= width:
            n = len(words) - width + 1
            rolled = sum((words[k:k + n] * FACTORS[k] for k in range(width)), np.zeros(n, np.uint64))
            row = np.repeat(np.arange(rows), count)
            whole = row[:n] == row[width - 1:]
            shingles, owner = mixed(rolled[whole]), row[:n][whole]
        else:
            shingles, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = np.flatnonzero((count > 0) & (count < width))
        if len(few):   # the whole sequence, with its length so that it equals no shingle
            short = [sum((int(w) * int(FACTORS[k]) for k, w in enumerate(words[first[i]:first[i + 1]])), 0) + int(count[i]) * 0x9E3779B97F4A7C15 for i in few]
            shingles = np.concatenate([shingles, mixed(np.array([x & 0xFFFFFFFFFFFFFFFF for x in short], np.uint64) ^ np.uint64(0x5555555555555555))])
            owner = np.concatenate([owner, few])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(owner) != 0) | (shingles[1:] != shingles[:-1])
    return shingles[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=rows)))).astype(np.int64)


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _sliced(block_id: int, sorted_tokens: np.ndarray, shift: int, bits: int, *columns):
    """Asked rows by bucket; the bucket is the token's highest bits below ``shift``."""
    bucket = ((sorted_tokens << np.uint64(shift)) >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = [(int(bucket[lo]), block_id, pack(np.diff(sorted_tokens[lo:hi], prepend=np.uint64(0)), *(c[lo:hi] for c in columns)))
            for lo, hi in zip(edges, [*edges[1:], len(bucket)])]
    return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["bucket", "block_id", "payload"]), preserve_index=False,
                                      schema=pa.schema([("bucket", pa.int64()), ("block_id", pa.int64()), ("payload", pa.binary())]))


ASKED = "bucket long, block_id long, payload binary"


def _frequencies(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answer: for each asked token, in how many sets it is over all blocks."""
    parts = [unpack(x) for x in rows.payload]
    with np.errstate(over="ignore"):
        tokens = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    _, which = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([p[1] for p in parts])).astype(np.uint32)[which]
    ends = np.cumsum([len(t) for t in tokens])
    return pd.DataFrame({"bucket": rows.bucket, "block_id": rows.block_id,
                         "payload": [pack(x) for x in np.split(total, ends[:-1])]})


def _ask(blocks: DataFrame, shift: int, bits: int) -> DataFrame:
    """Each block asks in how many sets its shingles are."""
    def ask(batches):
        for batch in batches:
            for block_id, payload in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, count = np.unique(unpack(payload)[2], return_counts=True)
                if len(tokens):
                    yield _sliced(block_id, tokens, shift, bits, count.astype(np.uint32))

    return blocks.select("block_id", "payload").mapInArrow(ask, ASKED).groupBy("bucket").applyInPandas(_frequencies, ASKED)


def _heard(tokens: np.ndarray, told: pd.DataFrame) -> np.ndarray:
    """The frequency of each of ``tokens`` from the answers to their block."""
    if not len(tokens):
        return np.zeros(0, np.uint32)
    which = np.unique(tokens, return_inverse=True)[1]
    return np.concatenate([unpack(x)[0] for x in told.sort_values("bucket").payload])[which]


def may_differ(n, percent: int):
    """D: the shingles of a set of n that a linked set may lack."""
    return n - -(-n * percent // 100)


def _need(a, b, percent: int):
    """The least overlap of linked sets of a and b shingles."""
    return -(-(a + b) * percent // (100 + percent))


BLOCK_FORM = "block_id long, n_shingles long, docs binary, digests binary, payload binary"


def _blocks(width: int, shift: int):
    """Blocks of documents: ids, text hashes, sizes and digests of all, and of each distinct set its shingles below the
    ``shift``-th halving of the hash range."""
    limit = np.uint64((1 << (64 - shift)) - 1)

    def run(batches):
        ids, texts, sizes, digests, seen, rows, counts, tokens, size = [], [], [], [], set(), [], [], [], 0

        def block():
            known = pa.concat_arrays(ids)
            docs = pack(np.asarray(known.fill_null(0), np.int64), np.asarray(known.is_null()), np.concatenate(sizes).astype(np.int32),
                        np.concatenate(texts))
            payload = pack(np.array(rows, np.uint32), np.array(counts, np.uint32), np.concatenate([np.zeros(0, np.uint64), *tokens]))
            return pa.RecordBatch.from_arrays([
                pa.array([secrets.randbits(62)], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([docs], pa.binary()),
                pa.array([b"".join(digests)], pa.binary()), pa.array([payload], pa.binary())], ["block_id", "n_shingles", "docs", "digests", "payload"])

        for batch in batches:
            for lo, hi, words, first in hashed_words(batch.column(1)):
                sets, bounds = _sets(words, first, width)
                ids.append(batch.column(0).slice(lo, hi - lo))
                texts.append(np.asarray(batch.column(2).slice(lo, hi - lo), np.int64))
                sizes.append(np.diff(bounds))
                size += len(sets) + 50 * (hi - lo)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = sets[a:b]
                    digests.append(_digest(own))
                    if b > a and digests[-1] not in seen:
                        seen.add(digests[-1])
                        rows.append(len(digests) - 1)
                        tokens.append(own if not shift else own[:np.searchsorted(own, limit, "right")])
                        counts.append(len(tokens[-1]))
                if size >= BLOCK_SHINGLES:
                    yield block()
                    ids, texts, sizes, digests, seen, rows, counts, tokens, size = [], [], [], [], set(), [], [], [], 0
        if ids:
            yield block()
    return run


def _digests(block) -> list[bytes]:
    return [block.digests[k:k + 16] for k in range(0, len(block.digests), 16)]


INFO = "doc_id long, n int, text_hash long, digest binary"


def _info(batches):
    for batch in batches:
        for docs, digests in zip(*(c.to_pylist() for c in batch.columns)):
            ids, nulls, sizes, texts = unpack(docs)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=nulls), pa.array(sizes), pa.array(texts),
                                              pa.array([digests[k:k + 16] for k in range(0, len(digests), 16)], pa.binary())], ["doc_id", "n", "text_hash", "digest"])


def _staying(percent: int):
    """Step 2: the sets of a block that may have a link."""
    def run(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples())
        ids, nulls, sizes, texts = unpack(row.docs)
        rows, counts, tokens = unpack(row.payload)
        lonely = np.bincount(np.repeat(np.arange(len(rows)), counts), weights=_heard(tokens, told) == 1, minlength=len(rows))
        keep = rows[lonely <= may_differ(sizes[rows].astype(np.int64), percent)]
        digests = _digests(row)
        return pd.DataFrame({"doc_id": pd.array([None if nulls[k] else ids[k] for k in keep], "Int64"), "text_hash": texts[keep], "digest": [digests[k] for k in keep]})
    return run


SETS = "digest binary, n int, tokens binary, entries array<struct<token: long, pos: int>>"


def _entries(percent: int):
    """Step 3: the sets of a block that share an index entry, with their entries."""
    def run(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples())
        rows, counts, tokens = unpack(row.payload)
        often, digests, out = _heard(tokens, told), _digests(row), []
        bounds = np.concatenate(([0], np.cumsum(counts.astype(np.int64)))).tolist()
        for k, a, b in zip(rows.tolist(), bounds, bounds[1:]):
            own, f = tokens[a:b], often[a:b]
            first = np.lexsort((own, f))[:may_differ(b - a, percent) + 1]
            shared = np.flatnonzero(f[first] > 1)
            if len(shared):
                out.append((digests[k], b - a, own.tobytes(),
                            [{"token": t, "pos": p} for t, p in zip(own[first[shared]].view(np.int64).tolist(), shared.tolist())]))
        return pd.DataFrame(out, columns=["digest", "n", "tokens", "entries"])
    return run


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with na, nb and the size of the sets' intersection."""
    both = (pairs.join(sets.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
            .join(sets.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b"))

    def count(batches):
        for batch in batches:
            a, b, na, nb, ta, tb = batch.columns
            common = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
                      for x, y in zip(ta, tb)]
            yield pa.RecordBatch.from_arrays([a, b, na, nb, pa.array(common, pa.int32())], ["a", "b", "na", "nb", "overlap"])

    return both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(count, "a binary, b binary, na int, nb int, overlap int")


RUN = ["token", "part_a", "part_b", "part", "n", "pos", "group", "hub", "hub_n", "overlap", "digest"]


def _compare(n, pos, part, inner, group, hub, hub_n, overlap, percent: int):
    """Pairs (x, y, settled) of one index list, sorted by n."""
    rest = n - pos
    edges = range(0, len(n), SKIP)
    most = np.maximum.reduceat(rest, list(edges))
    for bx in edges:
        x = slice(bx, min(bx + SKIP, len(n)))
        last = int(np.searchsorted(n, n[x][-1] * 100 // percent, "right"))
        for by in range(bx, last, SKIP):
            if min(most[bx // SKIP], most[by // SKIP]) < _need(n[bx], n[by], percent):
                continue   # no pair of these blocks can reach the overlap it needs
            y = slice(by, min(by + SKIP, last))
            need = _need(n[x, None], n[None, y], percent)
            fit = (np.minimum(rest[x, None], rest[None, y]) >= need) & (group[x, None] != group[None, y])
            fit &= n[None, y] * percent <= n[x, None] * 100
            if bx == by:
                fit &= np.arange(y.stop - y.start)[None] > np.arange(x.stop - x.start)[:, None]
            if not inner:
                fit &= part[x, None] != part[None, y]
            if not fit.any():
                continue
            # what the sets' hub tells: upper and lower bounds of the overlap
            same = (hub[x, None] == hub[None, y]) & (overlap[x, None] >= 0) & (overlap[None, y] >= 0)
            upper = np.minimum(overlap[x, None], overlap[None, y]) + np.minimum((n - overlap)[x, None], (n - overlap)[None, y])
            fit &= ~same | (upper >= need)
            settled = same & (overlap[x, None] + overlap[None, y] - hub_n[x, None] >= need)
            i, j = np.nonzero(fit)
            yield i + bx, j + by, settled[i, j]


def _candidates(percent: int):
    def run(batches):
        held = None

        def lists(table: pa.Table):
            key = np.stack([np.asarray(table.column(c), np.int64) for c in RUN[:3]], 1)
            cols = {c: np.asarray(table.column(c), np.int64) for c in RUN[3:-1]}
            edges = np.flatnonzero(np.concatenate(([True], (np.diff(key, axis=0) != 0).any(1))))
            mixed_groups = np.minimum.reduceat(cols["group"], edges) != np.maximum.reduceat(cols["group"], edges)
            digests = table.column("digest").combine_chunks()
            for k in np.flatnonzero(mixed_groups):
                lo, hi = edges[k], edges[k + 1] if k + 1 < len(edges) else len(key)
                own = {c: v[lo:hi] for c, v in cols.items()}
                for i, j, settled in _compare(own["n"], own["pos"], own["part"], key[lo, 1] == key[lo, 2], own["group"], own["hub"],
                                              own["hub_n"], own["overlap"], percent):
                    if len(i):
                        yield pa.RecordBatch.from_arrays([digests.take(pa.array(i + lo)), digests.take(pa.array(j + lo)), pa.array(settled)], ["a", "b", "settled"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.stack([np.asarray(table.column(c), np.int64) for c in RUN[:3]], 1)
            last = np.flatnonzero((key != key[-1]).any(1)) if len(key) else []
            done = int(last[-1]) + 1 if len(last) else 0   # the last list may go on in the next batch
            if done:
                yield from lists(table.slice(0, done))
            held = table.slice(done)
        if held is not None and len(held):
            yield from lists(held)
    return run


def text_hash():
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def similarity_links(docs: DataFrame, width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n, text_hash, digest of every row; links (a, b) between digests, enough to connect all linked classes."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash())
    shift = max(0, int(np.floor(np.log2(100 / (2 * (100 - percent))))) if percent < 100 else 6)
    blocks = bucketed(chosen.mapInArrow(_blocks(width, shift), BLOCK_FORM), "block_id", "jaccard-blocks")
    info = blocks.select("docs", "digests").mapInArrow(_info, INFO)

    def bits(blocks):
        return max(1, round(np.log2((blocks.agg(F.sum("n_shingles")).first()[0] or 0) / BUCKET_SHINGLES + 1)))

    stay = (blocks.groupBy("block_id").cogroup(_ask(blocks, shift, bits(blocks)).groupBy("block_id"))
            .applyInPandas(_staying(percent), "doc_id long, text_hash long, digest binary"))
    # each set that stays is known by one row of it, told by id and text: rows without an id, and rows that share one, count as well
    own = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("own")
    known = stored(stay.groupBy("digest").agg(own).select(F.col("own.doc_id").alias("_id"), F.col("own.text_hash").alias("_hash")), "jaccard-rows")
    whole = bucketed(chosen.join(small(known), chosen.doc_id.eqNullSafe(F.col("_id")) & (chosen.text_hash == F.col("_hash")), "left_semi").mapInArrow(_blocks(width, 0), BLOCK_FORM), "block_id", "jaccard-sets")
    sets = stored(whole.groupBy("block_id").cogroup(_ask(whole, 0, bits(whole)).groupBy("block_id"))
                  .applyInPandas(_entries(percent), SETS), "jaccard-index")
    sizes = sets.agg(F.count("*").alias("rows"), F.count_distinct("digest").alias("sets")).first()
    if sizes["rows"] > sizes["sets"]:   # rows alike in id and text, in several blocks
        sets = stored(sets.dropDuplicates(["digest"]), "jaccard-index")

    # 4: one hub for each set, the set that most often leads its lists
    entries = sets.select("digest", "n", F.explode("entries").alias("e")).select("digest", "n", "e.token", "e.pos")
    heads = (entries.groupBy("token").agg(F.min(F.struct("pos", "digest", "n")).alias("head"), F.count("*").alias("rows"))
             .where("rows > 1").select("token", "rows", F.col("head.digest").alias("hub"), F.col("head.n").alias("hub_n")))
    leads = (entries.join(heads, "token").where("digest != hub")
             .where(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent).groupBy("digest", "hub").agg(F.count("*").alias("times")))
    choice = leads.groupBy("digest").agg(F.max(F.struct("times", "hub")).alias("c")).select(F.col("digest").alias("a"), F.col("c.hub").alias("b"))
    compared = stored(_overlaps(choice, sets), "jaccard-hubs")
    linked = F.col("overlap") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    hubs = compared.where(linked).select("a", "b")

    # 5: the pairs that are left between groups
    up = hubs.select(F.col("a").alias("b"), F.col("b").alias("c"))
    groups = hubs.join(up, "b", "left").select(F.col("a").alias("digest"), F.xxhash64(F.coalesce("c", "b")).alias("group"))
    known = compared.select(F.col("a").alias("digest"), F.xxhash64("b").alias("hub"), F.col("nb").alias("hub_n"), "overlap")
    rows = (entries.join(heads.select("token", "rows"), "token").join(groups, "digest", "left").join(known, "digest", "left")
            .select("token", "rows", "n", "pos", "digest", F.coalesce("group", F.xxhash64("digest")).alias("group"),
                    F.coalesce("hub", F.lit(0)).alias("hub"), F.coalesce("hub_n", F.lit(0)).alias("hub_n"), F.coalesce("overlap", F.lit(-1)).alias("overlap")))
    parts = F.ceil(F.col("rows") / RUN_ROWS).cast("int")
    rows = (rows.withColumn("part", F.pmod(F.hash("digest"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .withColumn("part_a", F.least("part", "other")).withColumn("part_b", F.greatest("part", "other")).select(*RUN))
    pairs = (rows.repartition(*RUN[:3]).sortWithinPartitions(*RUN[:3], "n", "digest")
             .mapInArrow(_candidates(percent), "a binary, b binary, settled boolean")
             .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("settled").alias("settled")))
    pairs = stored(pairs, "jaccard-pairs")
    links = hubs.unionByName(pairs.where("settled").select("a", "b")).unionByName(
        _overlaps(pairs.where("not settled").select("a", "b"), sets).where(linked).select("a", "b"))
    return info, links


def _rooted(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, text_hash, digest of every row; digest and root -- the least digest of its component -- of every set)."""
    info, links = similarity_links(docs, width, percent)
    roots = components(links)
    classes = info.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    return info, classes.join(roots, classes.digest == roots.node, "left").select("digest", "first", F.coalesce("root", "digest").alias("root"))


def similarity_groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links) of every row."""
    info, rooted = _rooted(docs, width, percent)
    least = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = rooted.select("digest", "root").join(least, "root").select("digest", "component_id")
    return (info.join(named, "digest", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Filter: of each group of linked documents the row with the least id stays (then the least hash of its text), with all its columns.

    Rows are told apart by id and text, so a text never goes because another
    one shares its id; a null id comes after all others.  Rows equal in both
    are one document, of which one row stays.  Texts without words are groups
    of their own.
    """
    info, rooted = _rooted(docs, width, percent)
    rooted = stored(rooted, "jaccard-roots")
    best = rooted.groupBy("root").agg(F.min("first").alias("best")).withColumnRenamed("root", "of")
    kept = rooted.join(best, rooted.root == best.of).select("digest", "best")
    rows = stored(info.join(kept, "digest", "left").select(
        "doc_id", "text_hash", (F.col("best").isNull() | (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_hash") == F.col("text_hash")))).alias("stays"))
        .groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("rows")), "jaccard-decisions")
    mark = "_text_hash"
    marked = docs.withColumn(mark, text_hash())

    def among(decisions: DataFrame, how: str, of: DataFrame) -> DataFrame:
        d = small(decisions.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
        return of.join(d, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col(mark) == F.col("_hash")), how)

    left = among(rows.where("not stays"), "left_anti", marked)
    again = rows.where("stays and rows > 1")
    if not again.isEmpty():
        one = among(again, "left_semi", left).dropDuplicates(["doc_id", mark])
        left = among(again, "left_anti", left).unionByName(one)
    return left.select(*docs.columns)


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents, 3-word shingles, 100 |A & B| >= 90 |A | B|."""
    return similarity_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by brute force; DuckDB counts the shared shingles of all pairs.
OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM words),
classes AS (SELECT s, min(doc_id) AS c FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT c, len(s) AS n, unnest(s) AS t FROM classes),
pairs AS (
  SELECT a.c AS x, b.c AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(x, y) AS (SELECT c, c FROM classes UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(root, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s AND len(sets.s) > 0 LEFT JOIN roots ON roots.x = classes.c
"""
