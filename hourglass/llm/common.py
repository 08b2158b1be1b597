"""Shared helpers: row selection, byte-level word splitting in numpy, packed arrays, size-checked joins.

Words are the maximal runs of bytes other than blank, tab and the four line
breaks (0x20, 0x09-0x0D), with A-Z lower-cased where asked.  UTF-8 never uses
those bytes inside a character, so bytes and characters split alike.
"""

from __future__ import annotations

import ctypes
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 9, 10, 11, 12, 13]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Bytes of text that are handled at once (a longer document is a piece of its own).
PIECE_BYTES = 1 << 20


def remainder(column: str, modulus: int):
    """crc32 of the id as text modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def sampled(df: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose key's hash lies in the first ``share`` of its 63 bits: rows of a key go together, and no share rounds to nothing."""
    return df if share >= 1 else df.where(F.xxhash64(key).bitwiseAND(F.lit(2 ** 63 - 1)) < F.lit(int(share * 2.0 ** 63)))


def quota(counts: list[int], total: int) -> float:
    """The most rows each group may give so that all together give ``total`` at most (groups below it give all they have)."""
    left, groups = total, len(counts)
    for n in sorted(counts):
        if n * groups > left:
            return left / groups
        left, groups = left - n, groups - 1
    return float(max(counts, default=0))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder (zstd parquet) and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark, path: str) -> None:
    """Delete a scratch table that a later one has replaced (through the Hadoop file system)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like :func:`stored`, as a table bucketed by ``key``: joins and groups by it read without a shuffle."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table))
    return spark.table(table)


#: Rows of ids (8 bytes each) that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` of ids marked for broadcast if it is counted to be small, otherwise as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def randoms(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C55)
                     + np.uint64(seed) * np.uint64(0xD1342543DE82EF95))


BYTE_VALUES = randoms(1, 256)
_PLACES = randoms(2, 1024) | np.uint64(1)


def places(n: int) -> np.ndarray:
    """Odd multipliers for the first n byte places of a word."""
    global _PLACES
    if n > len(_PLACES):
        _PLACES = randoms(2, 2 * n) | np.uint64(1)
    return _PLACES


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, 8 * column.offset) if buffers[1] else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """Row ranges [lo, hi) of about ``limit`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS):
    """(starts, ends, first word of each row and the total) of all words in consecutive rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs: a sum of byte values times place multipliers, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        value = BYTE_VALUES[data[place + np.repeat(starts, lengths)]] * places(int(lengths.max()))[place]
        return mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def hashed_words(column: pa.Array, lower: bool = True, separators: np.ndarray = SEPARATORS):
    """For pieces of a text column: (lo, hi, word hashes, first word of each row and the total)."""
    data, offsets = text_bytes(column)
    for lo, hi in pieces(offsets):
        part = data[offsets[lo]:offsets[hi]]
        part = LOWERED[part] if lower else part
        starts, ends, first = word_spans(part, offsets[lo:hi + 1] - offsets[lo], separators)
        yield lo, hi, hashed(part, starts, ends), first
    release()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one value, each byte plane compressed for itself (like bytes stand together); see :func:`unpack`."""
    zip_, head, body = zstandard.ZstdCompressor(level=3, write_content_size=True), [struct.pack("<i", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else []
        zipped = [zip_.compress(x.tobytes()) if x.any() else b"" for x in planes]   # a plane of zeros takes no bytes
        head.append(struct.pack(f"<3sq{a.dtype.itemsize}i", a.dtype.str[1:].encode().ljust(3, b"\0"), len(a),
                                *(len(x) for x in zipped or [b""] * a.dtype.itemsize)))
        body += zipped
    return b"".join(head + body)


def unpack(value: bytes) -> list[np.ndarray]:
    value = memoryview(value)
    (n,), at, heads = struct.unpack_from("<i", value), 4, []
    for _ in range(n):
        kind, rows = struct.unpack_from("<3sq", value, at)
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        heads.append((dtype, rows, struct.unpack_from(f"<{dtype.itemsize}i", value, at + 11)))
        at += 11 + 4 * dtype.itemsize
    unzip, out = zstandard.ZstdDecompressor(), []
    for dtype, rows, sizes in heads:
        planes = np.zeros((rows, dtype.itemsize), np.uint8)
        for k, size in enumerate(sizes):
            if size:
                planes[:, k] = np.frombuffer(unzip.decompress(value[at:at + size]), np.uint8)
                at += size
        out.append(planes.reshape(-1).view(dtype) if rows else np.zeros(0, dtype))
    return out
