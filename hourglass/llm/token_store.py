"""Operator 4 — token-id output with Elias-Fano document boundaries.

A *token file* is a Parquet data set written by Spark's own committer (so a
lost executor's half-written rows are never seen); each row holds one block,
whose bytes are in this format (little-endian):

  "EFT1", width of an id in bytes, number of documents, of ids, of null ids
  Elias-Fano sequence of the document ends (within the block)
  Elias-Fano sequence of the document ids (less their minimum)
  the ids, one after the other

An Elias-Fano sequence of n values below u takes about 2 + log2(u / n) bits a
value: the low bits packed, the high bits in unary, and every 256th one's
place for select.  Blocks are in ascending order of doc_id: rows are dealt to
shards by quantiles of doc_id, a shard is sorted and cut into blocks by one
task, and an id so frequent that it fills several shards is dealt over them
(its rows have no order among themselves).

Null texts are empty and hold the end id alone; null ids come first; repeated
rows are documents of their own; a document longer than a block is a block;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.session import scratch_path

from .common import LOWERED, SEPARATORS, hashed, pieces, text_bytes, word_spans

#: Ids after which a block is closed.
BLOCK_IDS = 2_000_000
#: Runs and words whose ids a Python worker remembers.
CACHED_WORDS = 1_000_000
SAMPLE = 256
#: Runs of a line that is encoded at once; documents whose places are selected at once.
LINE_RUNS, READ_DOCS = 100, 4096

BLOCK_FORM = "shard int, seq int, first_id long, n_docs long, shard_start long, n_ids long, block binary"


class EliasFano:
    """A non-decreasing sequence of values >= 0."""

    def __init__(self, n, low_bits, low, high, samples):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values, n = np.asarray(values).astype(np.uint64), len(values)
        if not n:
            return cls(0, 0, *(np.zeros(0, np.uint8),) * 2, np.zeros(0, np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).reshape(-1), bitorder="little"),
                   np.packbits(high, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return (struct.pack("<qbqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
                + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes())

    @classmethod
    def from_bytes(cls, data, at: int = 0) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<qbqqq", data, at)
        at += struct.calcsize("<qbqqq")
        parts = (np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a),
                 np.frombuffer(data, np.uint32, c, at + a + b))
        return cls(n, low_bits, *parts), at + a + b + 4 * c

    def _low(self, start: int, count: int) -> np.ndarray:
        if not self.low_bits or not count:
            return np.zeros(count, np.uint64)
        first, last = start * self.low_bits, (start + count) * self.low_bits
        bits = np.unpackbits(self.low[first // 8:-(-last // 8)], bitorder="little")[first % 8:first % 8 + last - first]
        return bits.reshape(count, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th value, from the sampled places and one stretch of the unary bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, place // 8
        bits = np.unpackbits(self.high[byte:byte + 64], bitorder="little")
        bits[:place % 8] = 0
        while bits.sum() <= left:
            left, byte = left - int(bits.sum()), byte + len(bits) // 8
            bits = np.unpackbits(self.high[byte:byte + 64], bitorder="little")
        at = byte * 8 + int(np.flatnonzero(bits)[left])
        return (at - i) << self.low_bits | int(self._low(i, 1)[0])

    def select_range(self, start: int, stop: int) -> np.ndarray:
        """The values of the ranks start .. stop-1, from the unary bits between the sampled places around them."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, np.uint64)
        sample = start // SAMPLE
        place, after = int(self.samples[sample]), -(-stop // SAMPLE)
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[place // 8:-(-end // 8)], bitorder="little")
        bits[:place % 8] = 0
        ranks = np.arange(start, stop)
        places = np.flatnonzero(bits)[ranks - sample * SAMPLE] + 8 * (place // 8) - ranks
        return places.astype(np.uint64) << np.uint64(self.low_bits) | self._low(start, stop - start)

    def all(self) -> np.ndarray:
        return self.select_range(0, self.n)


def write_block(doc_ids: list, lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """One block; ``doc_ids`` ascend, nulls first."""
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = EliasFano.of(np.cumsum(lengths)).to_bytes()
    names = EliasFano.of((known - least).astype(np.uint64) if len(known) else known).to_bytes()
    return (b"EFT1" + struct.pack("<bqqqq", width, len(lengths), int(np.sum(lengths)), len(doc_ids) - len(known), least)
            + ends + names + ids)


class TokenBlock:
    """Read access to a block's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != b"EFT1":
            raise ValueError("not a token block")
        self.width, self.n_docs, self.n_ids, self.nulls, self.least = struct.unpack_from("<bqqqq", data, 4)
        self.ends, at = EliasFano.from_bytes(data, 4 + struct.calcsize("<bqqqq"))
        self.names, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]

    def offsets(self, start: int, stop: int) -> np.ndarray:
        """Where the documents start .. stop-1 begin, and where the last of them ends."""
        first = [self.ends.select(start - 1)] if start else [0]
        return np.concatenate([first, self.ends.select_range(start, stop).astype(np.int64)])

    def doc_ids(self, start: int, stop: int) -> list:
        known = self.names.select_range(max(0, start - self.nulls), max(0, stop - self.nulls)).astype(np.int64) + self.least
        return [None] * (min(stop, self.nulls) - min(start, self.nulls)) + known.tolist()


class Numbers:
    """64-bit hashes and the number of each, by open addressing in numpy arrays."""

    def __init__(self, room: int = 1 << 16):
        self.keys, self.numbers, self.used = np.zeros(room, np.uint64), np.full(room, -1, np.int32), 0

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 of those not there."""
        mask, out = np.uint64(len(self.keys) - 1), np.full(len(hashes), -1, np.int32)
        slot, open_ = hashes & mask, np.arange(len(hashes))
        while len(open_):
            number = self.numbers[slot]
            hit = self.keys[slot] == hashes[open_]
            out[open_[hit]] = number[hit]   # (an empty slot's number is -1 too)
            further = ~hit & (number >= 0)
            open_, slot = open_[further], (slot[further] + np.uint64(1)) & mask
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number new distinct hashes on from the last number."""
        numbers = np.arange(self.used, self.used + len(hashes), dtype=np.int32)
        self.used += len(hashes)
        if 2 * self.used > len(self.keys):
            old = np.flatnonzero(self.numbers >= 0)
            hashes, numbers = np.concatenate([self.keys[old], hashes]), np.concatenate([self.numbers[old], numbers])
            room = 1 << int(4 * self.used).bit_length()
            self.keys, self.numbers = np.zeros(room, np.uint64), np.full(room, -1, np.int32)
        mask = np.uint64(len(self.keys) - 1)
        slot = hashes & mask
        while len(hashes):
            free = np.flatnonzero(self.numbers[slot] < 0)
            self.keys[slot[free]], self.numbers[slot[free]] = hashes[free], numbers[free]   # of several for a slot the last stays
            lost = (self.keys[slot] != hashes) | (self.numbers[slot] != numbers)
            hashes, numbers, slot = hashes[lost], numbers[lost], (slot[lost] + np.uint64(1)) & mask


#: Byte classes: blanks, letters (all beyond ASCII for now), digits, the rest.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[SEPARATORS] = 0
_CLASS[97:123] = _CLASS[65:91] = _CLASS[128:] = 1
_CLASS[48:58] = 2


class WordEncoder:
    """Encodes texts with a tokenizer that parts them at blanks and between letters, digits and marks, and remembers what it has seen.

    For such a tokenizer a run of letters, a digit and a run of marks are each
    encoded for themselves, whatever stands beside them.  Runs repeat far more
    than words with their marks; each is encoded once (in lines of many, which
    is faster) and its ids are looked up from then on.  Words where that is not
    sure -- with signs beyond ASCII that are no letters, or an apostrophe -- are
    encoded as they stand.  A tokenizer of another kind gets whole words.
    """

    def __init__(self, text: str):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(text)
        model = json.loads(text)["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends_piece = None
        if suffix:
            self.ends_piece = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends_piece[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        added = [t["content"] for t in json.loads(text).get("added_tokens") or []]
        # a run that holds the beginning of an added token: its word may hold all of it
        self.leads = {re.match(r"[A-Za-z\x80-\U0010ffff]+|[0-9]|[^A-Za-z0-9\x80-\U0010ffff]+", t).group().lower() for t in added if t}
        parted = [[self._plain(x) for x in ("naïveté", "7", "4", ",.!", "été", "***", "z", "8")], self._plain("NAÏVETé74,.!été***z8")]
        self.by_run = bool(suffix) and sum(parted[0], []) == parted[1]
        self.forget()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        """Numbers of runs and words; a number's ids stand at ids[bounds[number]:bounds[number + 1]] (none: a run whose word decides)."""
        self.runs, self.words = Numbers(), Numbers()
        self.place = {"runs": np.zeros(0, np.int64), "words": np.zeros(0, np.int64)}   # number -> place in bounds, -1 for odd runs
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _keep(self, coded: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.ids = np.concatenate([self.ids, *coded])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(counts))])

    def _encode_runs(self, runs: list[str]) -> np.ndarray:
        """Place of each run's ids, -1 of odd ones."""
        sure = [(r.isascii() and "'" not in r or r.lower().isalpha()) and not any(x in r for x in self.leads) for r in runs]
        place, plain = np.full(len(runs), -1, np.int64), [i for i, ok in enumerate(sure) if ok]
        found, coded, counts = [], [], []
        for k in range(0, len(plain), LINE_RUNS):
            at = plain[k:k + LINE_RUNS]
            ids = np.array(self._plain(" ".join([runs[i] for i in at])), np.uint32)
            ends = np.flatnonzero(self.ends_piece[ids])
            if len(ends) == len(at) and ends[-1] == len(ids) - 1:
                found += at
                coded.append(ids)
                counts.append(np.diff(ends, prepend=-1))
                continue
            for i in at:   # not one piece each: leave those to their words
                ids = np.array(self._plain(runs[i]), np.uint32)
                if len(ids) and self.ends_piece[ids].sum() == 1 and self.ends_piece[ids[-1]]:
                    found.append(i)
                    coded.append(ids)
                    counts.append(np.array([len(ids)]))
        place[found] = len(self.bounds) - 1 + np.arange(len(found))
        if found:
            self._keep(coded, counts)
        return place

    def _encode_words(self, words: list[str]) -> np.ndarray:
        coded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        place = len(self.bounds) - 1 + np.arange(len(words))
        self._keep(coded, [np.array([len(x) for x in coded], np.int64)])
        return place

    def _places(self, kind: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place in bounds of each run (or word) data[start:end]; a 64-bit hash tells them apart."""
        numbers = getattr(self, kind)
        hashes = hashed(data, starts, ends)
        number = numbers.get(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            raw, at = data.tobytes(), new[at]
            texts = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            numbers.add(fresh)
            self.place[kind] = np.concatenate([self.place[kind], self._encode_runs(texts) if kind == "runs" else self._encode_words(texts)])
            number[new] = numbers.get(hashes[new])
        return self.place[kind][number]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each word) of the words data[start:end]."""
        if len(self.bounds) > CACHED_WORDS:
            self.forget()
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.by_run:
            low = LOWERED[data]   # such a tokenizer lower-cases
            kind = _CLASS[data]
            change = np.ones(len(data) + 1, bool)
            change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)   # a digit is a run for itself
            change[starts] = change[ends] = True
            first, last = np.flatnonzero(change[:-1] & (kind > 0)), np.flatnonzero(change[1:] & (kind > 0)) + 1
            word = np.cumsum(np.bincount(starts, minlength=len(data)))[first] - 1
            place = self._places("runs", low, first, last)
            odd = np.zeros(len(starts), bool)
            odd[word[place < 0]] = True
            if odd.any():   # their words instead of their runs
                at = np.flatnonzero(odd)
                keep = ~odd[word]
                place = np.concatenate([place[keep], self._places("words", data, starts[at], ends[at])])
                word = np.concatenate([word[keep], at])
                order = np.argsort(word, kind="stable")
                place, word = place[order], word[order]
        else:
            place, word = self._places("words", data, starts, ends), np.arange(len(starts))
        first = self.bounds[place]
        count = self.bounds[place + 1] - first
        start = np.concatenate(([0], np.cumsum(count)))
        shift = np.repeat(first - start[:-1], count)
        shift += np.arange(start[-1])
        return self.ids[shift], np.diff(start[np.searchsorted(word, np.arange(len(starts) + 1))])


_WORKER: dict = {}   # per Python worker: its encoder


def _encoder(text: str) -> WordEncoder:
    key = zlib.crc32(text.encode())
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = WordEncoder(text)
    return _WORKER[key]


def write_tokens(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the token files to ``path`` in ascending order of the id."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = chosen.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 1 / (20 * shards)) if shards > 1 else []
    cuts = np.array(cuts, np.float64)
    model = spark.sparkContext.broadcast(tokenizer_json)   # one vocabulary file

    def encode(batches):
        encoder, dealt = _encoder(model.value), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in pieces(offsets, 2 << 20):
                part, ids = data[offsets[lo]:offsets[hi]], batch.column(0).slice(lo, hi - lo)
                starts, ends, first = word_spans(part, offsets[lo:hi + 1] - offsets[lo])
                coded, count = encoder(part, starts, ends)
                bound = np.concatenate(([0], np.cumsum(count)))[first]
                number = np.asarray(ids.fill_null(0), np.int64)
                least, most = np.searchsorted(cuts, number, "left"), np.searchsorted(cuts, number, "right")
                shard = np.where(np.asarray(ids.is_null()), 0, np.where(most > least + 1, least + (dealt + np.arange(len(least))) % (most - least + 1), least))
                dealt += len(least)
                kind = "<u2" if max(int(coded.max(initial=0)), end_id) < 65536 else "<u4"
                end = np.array([end_id], kind).tobytes()
                coded = coded.astype(kind)
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.astype(np.int32)), ids, pa.array(np.full(hi - lo, int(kind[-1]), np.int8)),
                    pa.array([coded[a:b].tobytes() + end for a, b in zip(bound, bound[1:])], pa.binary())], ["shard", "doc_id", "width", "ids"])

    def to_blocks(batches):
        shard, seq, start, names, parts, held = None, 0, 0, [], [], 0

        def block():
            width = max(w for w, _ in parts)
            lengths = np.array([len(x) // w for w, x in parts], np.int64)
            ids = b"".join(x if w == width else np.frombuffer(x, f"<u{w}").astype(f"<u{width}").tobytes() for w, x in parts)
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([names[0]], pa.int64()), pa.array([len(names)], pa.int64()),
                pa.array([start], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([write_block(names, lengths, ids, width)], pa.binary())],
                ["shard", "seq", "first_id", "n_docs", "shard_start", "n_ids", "block"])

        for batch in batches:
            for s, name, width, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and (s != shard or held >= BLOCK_IDS):
                    yield block()
                    seq, start = seq + 1, start + held
                    names, parts, held = [], [], 0
                if s != shard:
                    shard, seq, start = s, 0, 0
                names.append(name)
                parts.append((width, ids))
                held += len(ids) // width
        if parts:
            yield block()

    coded = chosen.mapInArrow(encode, "shard int, doc_id long, width byte, ids binary")
    blocks = (coded.repartition(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first())
              .mapInArrow(to_blocks, BLOCK_FORM))
    blocks.write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The documents of token files: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCK_FORM).parquet(path)
    sizes = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}   # one row a shard
    before, total = {}, 0
    for shard in sorted(sizes):
        before[shard], total = total, total + sizes[shard]

    def read(batches):
        for batch in batches:
            for shard, start, data in zip(*(c.to_pylist() for c in batch.columns)):
                block = TokenBlock(data)
                for lo in range(0, block.n_docs, READ_DOCS):
                    hi = min(lo + READ_DOCS, block.n_docs)
                    at = block.offsets(lo, hi)
                    crc = [zlib.crc32(block.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(block.doc_ids(lo, hi), pa.int64()), pa.array(before[shard] + start + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("shard", "shard_start", "block").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_store(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Registered query: all documents, written to token files and read back."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    path = scratch_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), model, path)
    return read_tokens(spark, path)
