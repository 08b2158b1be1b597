"""Operator 5 — language identification of mixed-language texts.

A word (a run of letters and the marks between them) has a score for each learned language: the sum of
the log probabilities of its byte trigrams, blanks at its edges included.  The
scripts of its letters narrow the candidates first: a language takes part only
if at least one letter in a hundred of its training texts is in each of them
(if none has them all, any that has one; else all).  Viterbi over the words of
a text with a penalty for each switch labels the spans; the text's language
is the one with most letters (ties: the first by name), its score their share.

The trigram table is fitted on a bounded sample of labelled rows: at most
``fit_rows`` by expectation, dealt evenly over the languages (a rare one gives
all its rows), chosen by a hash of the id, repeated ids once (the smallest
language and text).  Everything else covers all rows and whole texts.

Null texts and texts without a letter are ``und`` with score 0; without any
training row all are ``und``; rows with equal or null ids are rows of their
own; other columns are passed over (``identify``) or kept (``keep_languages``).
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, pack, pieces, quota, release, remainder, text_bytes, unpack, word_spans
from .sequences import viterbi

#: Rows that the table is fitted on at most (by expectation); trigram slots; words decoded together; switching penalty.
FIT_ROWS, SLOTS, DECODE_WORDS, PENALTY = 20_000, 1 << 16, 600_000, 8.0

# Unicode ranges of scripts (letters elsewhere are one script more).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "syriac": [(0x700, 0x74F)], "thaana": [(0x780, 0x7BF)], "nko": [(0x7C0, 0x7FF)], "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)], "gurmukhi": [(0xA00, 0xA7F)], "gujarati": [(0xA80, 0xAFF)], "oriya": [(0xB00, 0xB7F)], "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)], "kannada": [(0xC80, 0xCFF)], "malayalam": [(0xD00, 0xD7F)], "sinhala": [(0xD80, 0xDFF)], "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)], "tibetan": [(0xF00, 0xFFF)], "myanmar": [(0x1000, 0x109F)], "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)], "ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF)],
    "cherokee": [(0x13A0, 0x13FF)], "canadian": [(0x1400, 0x167F)], "khmer": [(0x1780, 0x17FF)], "mongolian": [(0x1800, 0x18AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)], "bopomofo": [(0x3100, 0x312F)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
N_SCRIPTS = len(SCRIPTS) + 1
#: ASCII bytes that are no letters.
NO_LETTER = np.arange(256) < 128
NO_LETTER[65:91] = NO_LETTER[97:123] = False


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: 1 of letters, 2 of marks that go with letters, 0 of others; and the number of its script."""
    kind = np.array([1 if (c := chr(k)).isalpha() else 2 if unicodedata.category(c)[0] == "M" else 0 for k in range(0x110000)], np.uint8)
    script = np.full(0x110000, len(SCRIPTS), np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a:b + 1] = k
    return kind, script


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of UTF-8: whether it is part of a word, and at the first byte of a letter the bit of its script (0 elsewhere)."""
    word = ~NO_LETTER[data]
    script = np.where(word, np.int64(1), np.int64(0))   # ASCII letters are Latin
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return word & (data < 128), script * (data < 128)
    word &= data < 128
    script[data >= 128] = 0
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    b0, b1, b2, b3 = (wide[lead + k] for k in range(4))
    size = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
    point = np.where(size == 2, (b0 & 31) << 6 | b1 & 63, np.where(size == 3, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63,
                                                                    (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
    kinds, scripts = _characters()
    point = np.minimum(point, 0x10FFFF)
    kind = kinds[point]
    for k in range(4):
        at = lead[(kind > 0) & (size > k)] + k
        word[at[at < len(data)]] = True
    script[lead] = np.where(kind == 1, np.int64(1) << scripts[point].astype(np.int64), 0)
    return word, script


def _words(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, word spans and first words, and for each byte its trigram's slot and script bit)."""
    word, script = _letters(data)
    low = np.where(word, LOWERED[data], np.uint8(32))
    starts, ends, first = word_spans(low, offsets, NO_LETTER)
    if not len(low):
        return script, starts, ends, first, np.zeros(0, np.int64)
    wide = low.astype(np.uint32)
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before, after = np.empty_like(wide), np.empty_like(wide)
    before[0], before[1:], after[-1], after[:-1] = 32, wide[:-1], 32, wide[1:]
    before[edge[:-1]], after[edge[1:]] = 32, 32
    slot = ((before << 16 | wide << 8 | after) * np.uint32(2654435761)) >> np.uint32(16)
    return script, starts, ends, first, slot


def _runs(starts: np.ndarray, ends: np.ndarray):
    """(indices of the words' bytes, where each word begins among them)."""
    size = ends - starts
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    return np.arange(int(size.sum())) - np.repeat(begin - starts, size), begin


class LanguageModel:
    """Log probabilities of trigram slots and the scripts of each language."""

    def __init__(self, counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        table = np.stack([counts[k] for k in self.names], 1).astype(np.float64) + 0.1 if counts else np.zeros((SLOTS, 0))
        self.table = np.log(table / table.sum(0)).astype(np.float32)
        shares = [scripts[k] / max(scripts[k].sum(), 1) for k in self.names]
        self.masks = np.array([sum(1 << i for i, x in enumerate(s) if x >= 0.01) for s in shares], np.int64)
        self.transition = np.where(np.eye(len(self.names), dtype=bool), 0.0, -PENALTY)

    def allowed(self, mask: int) -> np.ndarray:
        every, some = (self.masks & mask) == mask, (self.masks & mask) > 0
        return every if every.any() else some if some.any() else np.ones(len(self.masks), bool)

    def word_scores(self, slot, script, starts, ends) -> np.ndarray:
        at, begin = _runs(starts, ends)
        scores = np.add.reduceat(self.table[slot[at]], begin, axis=0)
        word_mask = np.bitwise_or.reduceat(script[at], begin)
        masks = np.sort(word_mask)
        for mask in masks[np.flatnonzero(np.diff(masks, prepend=-1))]:
            allowed = self.allowed(int(mask))
            if not allowed.all():
                scores[np.ix_(word_mask == mask, ~allowed)] -= 1e4
        return scores

    def label(self, column: pa.Array):
        """For groups of rows: (lo, hi, labels, bytes [start, end) and letters of each word, first word of each row)."""
        data, offsets = text_bytes(column)
        held, words = [], 0
        parts = list(pieces(offsets))
        for k, (lo, hi) in enumerate(parts):
            base = int(offsets[lo])
            script, starts, ends, first, slot = _words(data[base:offsets[hi]], offsets[lo:hi + 1] - base)
            scores = self.word_scores(slot, script, starts, ends) if len(starts) else np.zeros((0, len(self.names)), np.float32)
            letters = np.concatenate(([0], np.cumsum(script > 0)))
            held.append((lo, hi, scores, starts + base, ends + base, np.diff(first), letters[ends] - letters[starts]))
            words += len(starts)
            if words >= DECODE_WORDS or k == len(parts) - 1:
                first = np.concatenate(([0], np.cumsum(np.concatenate([h[5] for h in held]))))
                labels = viterbi(np.concatenate([h[2] for h in held]), first, self.transition)
                yield (held[0][0], held[-1][1], labels, np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]),
                       np.concatenate([h[6] for h in held]), first)
                held, words = [], 0
                release()

    def predict(self, column: pa.Array, spans: bool = False):
        """(language, score, list of spans or None) of each row."""
        names, scores, found = [], [], [] if spans else None
        data, offsets = text_bytes(column)
        if not self.names:
            n = len(column)
            return ["und"] * n, [0.0] * n, [[] for _ in range(n)] if spans else None
        for lo, hi, labels, starts, ends, size, first in self.label(column):
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            letters = np.bincount(row * len(self.names) + labels, weights=size, minlength=(hi - lo) * len(self.names))
            letters = letters.reshape(hi - lo, len(self.names))
            total, best = letters.sum(1), letters.argmax(1)
            seen = total > 0
            names += [self.names[b] if s else "und" for b, s in zip(best, seen)]
            scores += np.where(seen, letters.max(1) / np.maximum(total, 1), 0.0).tolist()
            if spans:
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    text = data[offsets[lo + i]:offsets[lo + i + 1]].tobytes()
                    cuts = [a, *(np.flatnonzero(np.diff(labels[a:b])) + a + 1), b] if b > a and seen[i] else []
                    found.append([{"start": len(text[:starts[x] - offsets[lo + i]].decode()), "end": len(text[:ends[y - 1] - offsets[lo + i]].decode()),
                                   "lang": self.names[labels[x]]} for x, y in zip(cuts, cuts[1:])])
        return names, scores, found


def fit_languages(docs: DataFrame, train, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Count trigrams by language on at most about ``fit_rows`` of the rows where ``train`` holds."""
    rows = (docs.where(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
            .select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}   # a row a language, as in the model
    most = quota(list(counts.values()), fit_rows)
    limits = docs.sparkSession.createDataFrame([(k, int(min(1.0, most / n) * (2.0 ** 63 - 1024))) for k, n in counts.items()], "lang string, most long")
    chosen = (rows.join(F.broadcast(limits), "lang").where(F.xxhash64("doc_id").bitwiseAND(F.lit(2 ** 63 - 1)) <= F.col("most"))
              .groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text"))

    def count(batches):
        sums: dict = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in pieces(offsets):
                script, starts, ends, first, slot = _words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                if not len(starts):
                    continue
                for lang in set(langs[lo:hi]):
                    mine = np.repeat(langs[lo:hi] == lang, np.diff(first))
                    if mine.any():
                        at, _ = _runs(starts[mine], ends[mine])
                        c, s = sums.setdefault(lang, (np.zeros(SLOTS, np.int64), np.zeros(N_SCRIPTS, np.int64)))
                        c += np.bincount(slot[at], minlength=SLOTS)
                        bits = script[at]
                        s += np.bincount(np.log2(bits[bits > 0]).astype(np.int64), minlength=N_SCRIPTS)
        for lang, (c, s) in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [pack(c, s)]})

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        c, s = (sum(x) for x in zip(*(unpack(v) for v in rows.counts)))
        return pd.DataFrame({"lang": [key[0]], "counts": [pack(c, s)]})

    # the sample is bounded, so is the number of its parts
    sums = (chosen.repartition(16, "doc_id").select("lang", "text").mapInArrow(count, "lang string, counts binary")
            .groupBy("lang").applyInPandas(total, "lang string, counts binary").collect())
    found = {r.lang: unpack(bytes(r.counts)) for r in sums}
    return LanguageModel({k: v[0] for k, v in found.items()}, {k: v[1] for k, v in found.items()})


def identify(docs: DataFrame, train, fit_rows: int = FIT_ROWS, spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row (and, if asked, its spans: start, end, lang in characters)."""
    model = docs.sparkSession.sparkContext.broadcast(fit_languages(docs, train, fit_rows))   # a fixed number of slots by languages
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~train).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, held_out boolean, lang_pred string, score double" + (", spans array<struct<start: int, end: int, lang: string>>" if spans else "")

    def predict(batches):
        for batch in batches:
            names, scores, found = model.value.predict(batch.column(2), spans)
            columns = {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}
            if spans:
                columns["spans"] = pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(predict, kind)


def keep_languages(docs: DataFrame, train, least: float = 0.4, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Filter: the rows, all columns as they are, whose language is known and holds at least ``least`` of the letters."""
    model = docs.sparkSession.sparkContext.broadcast(fit_languages(docs, train, fit_rows))
    place = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            names, scores, _ = model.value.predict(batch.column(place).cast(pa.string()))
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op5_language_spans(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents, learned from those whose crc32 remainder modulo 4 is not 2."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder("doc_id", 4) != 2)
