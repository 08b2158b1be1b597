"""Operator 2 — language-model scoring with a Katz back-off n-gram model.

Counting and scoring never hold the model in one place.  The corpus is turned
once into *blocks* of documents (word hashes as block-local numbers, packed);
each level k of the model is then one exchange:

  blocks -> (bucket, block, the block's distinct k-grams with their counts)
         -> per bucket: totals of every k-gram, count-of-counts, back-off sums
         -> (block, answers) back to the block that asked.

The blocks are a table bucketed by block, so that each exchange moves only
questions and answers.  A k-gram is sent once per block however often it occurs there, so a hot word
costs a bucket one entry per block.  Buckets are dealt by the context, and a
context with more than a bucket's share of the corpus is dealt by (context,
word) instead; its partial sums (at most one context per bucket) are added up
by SQL.  The merged buckets are the model's partitioned tables, one folder for
each level.

P_k(w | c) = d_r r / count(c) for a k-gram seen r times, otherwise
alpha(c) P_{k-1}(w | shorter c); alpha makes the sum over the training
vocabulary and one unknown word exactly 1.  d_r is Katz's Good-Turing discount
for r <= 5 where count-of-counts allow it, otherwise the absolute discount
n1 / (n1 + 2 n2).  A context without discounted mass (all its words seen more
than 5 times) counts one unseen event more.  The unknown word has the mass
that discounting leaves at level 1.

Words are told apart by a 64-bit hash.  Null texts are empty (their end token
remains); repeated rows and ids are rows of their own; a null id belongs to
the training part; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import secrets

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, hashed_words, mixed, pack, remainder, stored, unpack

END = np.uint64(0x5EED0E4D0F7E8715)
#: Counts up to this one are discounted.
LARGEST = 5
#: Tokens of a block, and of a bucket on average.
BLOCK_TOKENS, BUCKET_TOKENS = 1_500_000, 2_000_000

BLOCKS = "block_id long, n_tokens long, docs binary, nulls binary, payload binary"
ASKED = "bucket long, block_id long, payload binary"
MERGED = "bucket long, block_id long, payload binary, hist array<long>, hot binary"


def _blocks(batches):
    ids, train, lens, tokens, held = [], [], [], [], 0

    def block():
        words, local = np.unique(np.concatenate([*tokens, np.array([END])]), return_inverse=True)
        doc_ids = pa.concat_arrays(ids)
        values = np.asarray(doc_ids.fill_null(0), np.int64)
        local = local[:-1]
        often = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")   # frequent words get small numbers
        number = np.empty(len(often), np.uint32)
        number[often] = np.arange(len(often))
        payload = pack(np.concatenate(lens).astype(np.int32), np.concatenate(train), words, often.astype(np.uint32), number[local])
        return pa.RecordBatch.from_pydict({
            "block_id": pa.array([secrets.randbits(62)], pa.int64()), "n_tokens": pa.array([held], pa.int64()),
            "docs": [pack(values)], "nulls": [pack(np.asarray(doc_ids.is_null()))], "payload": [payload]})

    for batch in batches:
        learn = np.asarray(batch.column(2)).astype(bool)
        for lo, hi, words, first in hashed_words(batch.column(1)):
            n = np.diff(first) + 1   # every document has its end token
            all_words = np.insert(words, first[1:], END)
            ids.append(batch.column(0).slice(lo, hi - lo).cast(pa.int64()))
            train.append(learn[lo:hi])
            lens.append(n)
            tokens.append(all_words)
            held += len(all_words)
            if held >= BLOCK_TOKENS:
                yield block()
                ids, train, lens, tokens, held = [], [], [], [], 0
    if ids:
        yield block()


def _slices(block_id, bucket: np.ndarray, *columns) -> pd.DataFrame:
    """One asked row for each bucket; ``bucket`` is sorted."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    rows = [(int(bucket[lo]), block_id, pack(*(c[lo:hi] for c in columns)))
            for lo, hi in zip(edges, [*edges[1:], len(bucket)])]
    return pd.DataFrame(rows, columns=["bucket", "block_id", "payload"])


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class Discounts:
    """d_1 .. d_LARGEST of one level, from its count-of-counts."""

    def __init__(self, hist):
        n, self.total, self.distinct = np.asarray(hist[:LARGEST + 1], float), int(hist[LARGEST + 1]), int(hist[LARGEST + 2])
        r = np.arange(1, LARGEST + 1)
        with np.errstate(all="ignore"):
            star, spread = (r + 1) * n[1:] / n[:-1], (LARGEST + 1) * n[LARGEST] / n[0]
            d = (star / r - spread) / (1 - spread)
        absolute = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] > 0 else 0.5
        fallback = (r - min(max(absolute, 0.05), 0.95)) / r
        self.d = np.where(np.isfinite(d) & (d > 0) & (d < 1), d, fallback)

    def mass(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * np.append(self.d, 1.0)[np.minimum(counts, LARGEST + 1).astype(np.int64) - 1]


class Block:
    """A block's grams, level by level, with what the buckets answered."""

    def __init__(self, row, params: dict):
        self.id, self.p = int(row.block_id), params
        self.lens, self.train, self.words, often, numbers = unpack(row.payload)
        self.tokens = often.astype(np.int64)[numbers]
        self.first = np.concatenate(([0], np.cumsum(self.lens)))[:-1].astype(np.int64)
        self.learn = np.repeat(self.train, self.lens)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.first, self.lens)

    def ask_words(self) -> pd.DataFrame:
        counts = np.bincount(self.tokens[self.learn], minlength=len(self.words)).astype(np.int64)
        return _slices(self.id, _top(self.words, self.p["bits"]), self.words, counts)

    def hear_words(self, answers) -> None:
        parts = [(bucket, *unpack(x)) for bucket, x in answers]
        self.count = np.concatenate([c for _, c, _ in parts])
        self.gram_id = np.concatenate([(np.uint64(b) << np.uint64(40)) + rank.astype(np.uint64) for b, _, rank in parts])
        self.word_count, self.word_id = self.count, self.gram_id
        self.prob = _word_prob(self.count, self.p)
        self.gram = self.tokens

    def grams(self, level: int) -> None:
        """The next level's distinct grams, in the order of bucket, context, word."""
        before = np.empty(len(self.tokens), np.int64)
        if level == 2:
            before[1:], before[self.first] = self.gram[:-1], int(np.searchsorted(self.words, END))
            self.valid = np.ones(len(self.tokens), bool)
        else:
            before[1:] = self.gram[:-1]
            self.valid = self.valid & (self.place >= level - 2)
        key = (before * len(self.words) + self.tokens)[self.valid]
        distinct, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        context, word = distinct // len(self.words), distinct % len(self.words)
        lower = self.gram[self.valid][at]
        ids, words = self.gram_id[context], self.word_id[word]
        hot = self.count[context] * (1 << self.p["bits"]) > self.p["discounts"][0].total
        mix = mixed(ids)
        bucket = _top(np.where(hot, mixed(mix + words), mix), self.p["bits"])
        order = np.lexsort((words, ids, bucket))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.next = np.full(len(self.tokens), -1, np.int64)
        self.next[self.valid] = back[inverse]
        self.bucket, self.context, self.ids, self.word, self.hot = bucket[order], context[order], ids[order], words[order], hot[order]
        self.lower_prob, self.lower_count = self.prob[lower[order]], self.count[lower[order]] if level == 2 else None
        self.asked = np.bincount(self.next[self.valid & self.learn], minlength=len(order)).astype(np.int64)

    def ask_grams(self) -> pd.DataFrame:
        """Questions by bucket.  The lower order's probability goes as the word's count where that determines it
        (level 2), otherwise as a table of the distinct values and a number for each gram."""
        plain = self.lower_count is not None
        table, code = (None, None) if plain else np.unique(self.lower_prob, return_inverse=True)
        rows = []
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(self.bucket)]):
            used, own = (None, None) if plain else np.unique(code[lo:hi], return_inverse=True)
            lower = (np.zeros(0), self.lower_count[lo:hi].astype(np.uint64)) if plain else (table[used], own.astype(np.uint32))
            payload = pack(np.diff(self.ids[lo:hi], prepend=np.uint64(0)), self.word[lo:hi], self.asked[lo:hi].astype(np.uint32),
                           self.count[self.context[lo:hi]].astype(np.uint32 if self.count.max(initial=0) < 1 << 32 else np.int64), *lower, self.hot[lo:hi])
            rows.append((int(self.bucket[lo]), self.id, payload))
        return pd.DataFrame(rows, columns=["bucket", "block_id", "payload"])

    def hear_grams(self, level: int, answers) -> None:
        parts = [(bucket, *unpack(x)) for bucket, x in answers]
        total = np.concatenate([p[1] for p in parts]).astype(np.int64)
        rank = np.concatenate([p[2] for p in parts]).astype(np.uint64)
        which = np.concatenate([p[3] + shift for p, shift in
                                zip(parts, np.cumsum([0, *(len(p[4]) for p in parts[:-1])]))]).astype(np.int64)
        lower_sum = np.concatenate([p[4] for p in parts])
        masses = np.stack([np.concatenate([p[5 + r] for p in parts]) for r in range(LARGEST + 1)]).astype(float)
        lower_sum, masses = lower_sum[which], masses[:, which]
        hot = self.p["hot"].get(level)
        if hot is not None and self.hot.any():
            at = np.searchsorted(hot[0], self.ids[self.hot])
            lower_sum[self.hot], masses[:, self.hot] = hot[1][at, 0], hot[1][at, 1:].T
        rule = self.p["discounts"][level - 1]
        known = self.count[self.context].astype(float)
        held = (rule.d * np.arange(1, LARGEST + 1)) @ masses[:LARGEST] + masses[LARGEST]
        extra = np.where(known - held < 1e-9 * np.maximum(known, 1), 1.0, 0.0)
        base = np.maximum(known + extra, 1)
        alpha = np.where(known > 0, (known + extra - held) / base / np.maximum(1 - lower_sum, 1e-300), 1.0)
        seen = total > 0
        prob = np.where(seen, rule.mass(np.maximum(total, 1)) / base, alpha * self.lower_prob)
        self.place_prob = np.where(self.valid, prob[self.next], self.prob[self.gram] if level == 2 else self.place_prob)
        self.gram, self.count, self.prob = self.next, total, prob
        if level < self.p["order"]:
            bucket = np.concatenate([np.full(len(p[1]), p[0], np.uint64) for p in parts])
            self.gram_id = (bucket << np.uint64(40)) + rank

    def scores(self, row) -> pd.DataFrame:
        prob = self.place_prob if self.p["order"] > 1 else self.prob[self.tokens]
        n, v = self.p["discounts"][0].total, self.p["discounts"][0].distinct
        base = np.log10((self.word_count + 1) / (n + (v + 1)))[self.tokens]
        out = pd.DataFrame({
            "doc_id": pd.array(unpack(row.docs)[0], "Int64"), "held_out": ~self.train, "n_tokens": self.lens.astype(np.int64),
            "n_known": np.add.reduceat((self.word_count > 0)[self.tokens].astype(np.int64), self.first),
            "train_tokens": n, "base_score": np.add.reduceat(base, self.first),
            "score": np.add.reduceat(np.log10(prob), self.first)})
        out.loc[unpack(row.nulls)[0], "doc_id"] = pd.NA
        return out


def _word_prob(count: np.ndarray, params: dict) -> np.ndarray:
    """Level 1: a word's probability is a function of its count alone."""
    rule = params["discounts"][0]
    return np.where(count > 0, rule.mass(np.maximum(count, 1)) / max(rule.total + params["extra"], 1), params["unknown"])


def _hist(total: np.ndarray) -> list[int]:
    counts = np.bincount(np.minimum(total[total > 0], LARGEST + 2), minlength=LARGEST + 3)
    return [*map(int, counts[1:LARGEST + 2]), int(total.sum()), int((total > 0).sum())]


def _merge_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    parts = [unpack(x) for x in rows.payload]
    words, rank = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(rank, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
    often = np.argsort(-total, kind="stable")   # a word's number is its rank by count: small numbers pack well
    number = np.empty(len(often), np.int64)
    number[often] = np.arange(len(often))
    words, total, rank = words[often], total[often], number[rank]
    out, at = [], 0
    for block_id, p in zip(rows.block_id, parts):
        own = rank[at:at + len(p[0])]
        at += len(p[0])
        out.append((key[0], block_id, pack(total[own], own.astype(np.uint32)), None, None))
    out.append((key[0], -1, pack(words, total), _hist(total), None))
    return pd.DataFrame(out, columns=["bucket", "block_id", "payload", "hist", "hot"])


def _merge_grams(key: tuple, rows: pd.DataFrame, last: bool, params: dict) -> pd.DataFrame:
    """Totals of a bucket's grams; their numbers go back only if a further level builds on them."""
    parts = [unpack(x) for x in rows.payload]
    with np.errstate(over="ignore"):
        ids = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    words, asked, known = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    sizes = [len(p[0]) for p in parts]
    lower, hot = np.concatenate([p[4][p[5]] if len(p[4]) else _word_prob(p[5].astype(np.int64), params) for p in parts]), np.concatenate([p[6] for p in parts])
    blocks = list(rows.block_id)
    del parts, rows
    order = np.lexsort((words, ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(words[order]) != 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    total = np.bincount(rank, weights=asked).astype(np.int64)
    head = order[new]
    # by context: sums over its seen words
    contexts, of = np.unique(ids[head], return_inverse=True)
    seen = total > 0
    lower_sum = np.bincount(of, weights=np.where(seen, lower[head], 0.0), minlength=len(contexts))
    masses = [np.bincount(of[total == r], minlength=len(contexts)) for r in range(1, LARGEST + 1)]
    masses.append(np.bincount(of, weights=np.where(total > LARGEST, total, 0), minlength=len(contexts)))
    out, at = [], 0
    for block_id, n in zip(blocks, sizes):
        own = rank[at:at + n]
        used, which = np.unique(of[own], return_inverse=True)
        out.append((key[0], block_id, pack(total[own].astype(np.uint32), own[:0 if last else n].astype(np.uint32), which.astype(np.uint32), lower_sum[used],
                                           *(m[used].astype(np.uint32) for m in masses[:-1]), masses[-1][used]), None, None))
        at += n
    shared = np.unique(of[rank[hot]])
    extra = pack(contexts[shared], lower_sum[shared], *(m[shared].astype(float) for m in masses)) if len(shared) else None
    out.append((key[0], -1, pack(np.diff(ids[head], prepend=np.uint64(0)), words[head], total.astype(np.uint32), known[head]), _hist(total), extra))
    return pd.DataFrame(out, columns=["bucket", "block_id", "payload", "hist", "hot"])


def _advance(block: Block, answers: pd.DataFrame, upto: int) -> Block:
    """Hear all levels below ``upto`` and lay out the grams of ``upto``."""
    answers = answers.sort_values(["level", "bucket"])
    for level, rows in answers.groupby("level"):
        pairs = list(zip(rows.bucket, rows.payload))
        if level == 1:
            block.hear_words(pairs)
        else:
            block.grams(level)
            block.hear_grams(level, pairs)
    if upto > 1 and upto <= block.p["order"]:
        block.grams(upto)
    return block


def _discounts(merged: DataFrame) -> Discounts:
    sums = merged.where("block_id < 0").agg(*(F.sum(F.col("hist")[i]) for i in range(LARGEST + 3))).first()
    return Discounts([x or 0 for x in sums])


def _hot_sums(merged: DataFrame):
    """Sums of the contexts that are dealt over all buckets: one context a bucket at most."""
    def rows(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                ids, *sums = unpack(x)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids.view(np.int64)), "sums": list(np.stack(sums, 1))})

    found = (merged.where("block_id < 0 and hot is not null").select("hot").mapInArrow(rows, "id long, sums array<double>")
             .groupBy("id").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(LARGEST + 2))).collect())
    if not found:
        return None
    ids = np.array([r.id for r in found], np.int64).view(np.uint64)
    order = np.argsort(ids)
    return ids[order], np.array([list(r)[1:] for r in found], float)[order]


def _merging(last: bool, params: dict):
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _merge_grams(key, rows, last, params)

    return merge


def _asking(level: int, params: dict):
    def ask(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return _advance(Block(next(block.itertuples()), params), told, level).ask_grams()

    return ask


def katz_scores(docs: DataFrame, train, order: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score every row with a model of the rows where the column expression ``train`` holds.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"),
                         F.coalesce(train, F.lit(True)).alias("train"))
    blocks = bucketed(chosen.mapInArrow(_blocks, BLOCKS), "block_id", "katz-blocks")
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    params = {"order": order, "bits": max(3, round(np.log2(max(tokens, 1) / BUCKET_TOKENS + 1))), "discounts": [], "hot": {}}

    def ask_words(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                yield pa.RecordBatch.from_pandas(Block(row, params).ask_words(), preserve_index=False)

    answers = None
    for level in range(1, order + 1):
        if level == 1:
            asked, merge = blocks.mapInArrow(ask_words, ASKED), _merge_words
        else:
            asked, merge = blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInPandas(
                _asking(level, dict(params)), ASKED), _merging(level == order, dict(params))
        merged = stored(asked.groupBy("bucket").applyInPandas(merge, MERGED), f"katz-model/level={level}")
        params["discounts"] = [*params["discounts"], _discounts(merged)]
        if level == 1:
            params |= _unknown(merged, params["discounts"][0])
        else:
            params["hot"] = params["hot"] | {level: _hot_sums(merged)}
        told = merged.where("block_id >= 0").select("block_id", "bucket", "payload", F.lit(level).alias("level"))
        answers = told if answers is None else answers.unionByName(told)

    def score(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples())
        return _advance(Block(row, params), told, order + 1).scores(row)

    return blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInPandas(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _unknown(merged: DataFrame, rule: Discounts) -> dict:
    """The unknown word's probability: what discounting leaves, or one event more if it leaves nothing."""
    sums = merged.where("block_id < 0").agg(*(F.sum(F.col("hist")[i]) for i in range(LARGEST))).first()
    freed = sum((1 - d) * (r + 1) * (n or 0) for r, (d, n) in enumerate(zip(rule.d, sums)))
    extra = 0 if freed > 1e-9 * max(rule.total, 1) else 1
    return {"extra": extra, "unknown": (freed + extra) / max(rule.total + extra, 1)}


def op2_katz_backoff(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents, learned from those whose crc32 remainder modulo 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return katz_scores(docs, remainder("doc_id", 7) != 2)


OP2_SQL = None
