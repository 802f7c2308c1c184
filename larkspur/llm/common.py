"""Helpers shared by the training-data operators: names of rows, fixed-size sketches built on
Spark, and byte-level text hashing for use inside Arrow tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir, workers_find_package  # noqa: F401


# ---------------------------------------------------------------- names of rows, shares


ROW = "struct<a:long,b:long>"


def row_name(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A row's name: 128 bits from its id and text. Rows that repeat share it."""
    i, t = F.col(doc_id).cast("long"), F.col(text).cast("string")
    return F.struct(F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), t, i).alias("b"))


#: Hashes are compared with shares of this many values, so that a share of billions of rows is not 0.
WHOLE_SHARE = 1 << 53


def in_share(share: Column | float, *key) -> Column:
    """Whether a row is in a share (0 to 1) of all, by a hash of its key."""
    at = F.pmod(F.xxhash64(*key), F.lit(WHOLE_SHARE))
    return at < (share * float(WHOLE_SHARE) if isinstance(share, Column) else F.lit(float(share) * float(WHOLE_SHARE)))


# ---------------------------------------------------------------- fixed-size sketches


CHUNK = 1 << 16


def partials(arrays: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One task's arrays as rows (part, chunk, body), the chunks without content left out."""
    for part, array in arrays.items():
        kind = array.dtype.str
        for at in range(0, len(array), CHUNK):
            piece = array[at : at + CHUNK]
            if piece.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([at // CHUNK], pa.int32()), "kind": [kind], "body": pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())})


PARTIALS = "part int, chunk int, kind string, body binary"


def merged(rows: DataFrame, size: int, dtype, how: str = "add") -> dict[int, np.ndarray]:
    """Add (or OR) the tasks' partial arrays on the executors, a chunk at a time, and bring the sums
    here. Their size is fixed by the sketch, whatever the number of rows or tasks."""
    dtype = np.dtype(dtype)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, chunk, kind, body in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(zlib.decompress(body), kind).astype(dtype)
                if (part, chunk) not in held:
                    held[part, chunk] = x.copy()
                elif how == "or":
                    held[part, chunk] |= x
                else:
                    held[part, chunk] += x
        for (part, chunk), x in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "kind": [dtype.str], "body": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})

    out: dict[int, np.ndarray] = {}
    for row in rows.repartition("part", "chunk").mapInArrow(fold, PARTIALS).collect():
        array = out.setdefault(row["part"], np.zeros(size, dtype))
        x = np.frombuffer(zlib.decompress(bytes(row["body"])), dtype)
        array[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(x)] = x
    return out


class Bits:
    """A Bloom filter of a fixed number of bits for 64-bit values that are already well mixed."""

    def __init__(self, log2: int, words: np.ndarray | None = None):
        self.log2 = log2
        self.words = np.zeros(1 << (log2 - 3), np.uint8) if words is None else words

    def slots(self, x: np.ndarray) -> list[np.ndarray]:
        x = x.view(np.uint64)
        return [(x >> np.uint64(64 - self.log2)).astype(np.int64), (mix(x, 0x9E3779B97F4A7C15) >> np.uint64(64 - self.log2)).astype(np.int64)]

    def add(self, x: np.ndarray) -> None:
        for s in self.slots(x):
            np.bitwise_or.at(self.words, s >> 3, np.left_shift(1, s & 7).astype(np.uint8))

    def has(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for s in self.slots(x):
            out &= (self.words[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
        return out


def bits_of(df: DataFrame, log2: int, keys: Callable = lambda x: x, columns: tuple[str, ...] = ()) -> Bits:
    """The filter of keys(columns) (all of df's, of longs), OR-ed together from per-task filters; its size is
    fixed. The keys are made where the filters are filled, so a task has one Python worker."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(log2)
        for batch in batches:
            bits.add(keys(*[longs(c) for c in batch.columns]))
        yield from partials({0: bits.words})

    got = merged((df.select(*columns) if columns else df).mapInArrow(fill, PARTIALS), 1 << (log2 - 3), np.uint8, "or")
    return Bits(log2, got.get(0))


def log2_bits(n: int, per: int = 16, least: int = 16, most: int = 27) -> int:
    """log2 of the bits for n values, held between fixed limits (2^27 bits are 16 MB)."""
    return int(min(most, max(least, np.ceil(np.log2(max(1, n) * per)))))


# ---------------------------------------------------------------- arrays in Arrow tasks


def longs(column) -> np.ndarray:
    """A column without nulls as int64."""
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64)


def utf8(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column in place, and where each text starts and ends; null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = (column if pa.types.is_string(column.type) else column.cast(pa.string())), np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1].copy(), offsets[1:].copy()
    if column.null_count:
        null = np.asarray(column.is_null())
        ends[null] = starts[null]
    return data, starts, ends


def runs(starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive texts whose bytes together stay within the limit; a longer text stands alone."""
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends[i:], starts[i] + limit, "right")) + i)
        yield i, j
        i = j


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of (byte + 1) * BASE^t over i <= t < j."""
    s = np.empty(len(buf) + 1, np.uint64)
    s[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf) + 1)[0][: len(buf)], out=s[1:])
    return s


def spans_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), independent of where they lie."""
    return mix((s[end] - s[start]) * powers(len(s))[1][start])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Every ASCII character but letters and digits ends a token of loose().
LOOSE = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])


def words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, loose: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts buf[starts:ends], and the text each word stands in.

    A word is a run of anything but 0x20 and 0x09-0x0D, with A-Z in lower case. loose: punctuation
    in ASCII also separates, and the accented capitals of Latin-1 are lower-cased too.
    """
    b = LOWER[buf]
    gap = (LOOSE if loose else SPACE)[buf]
    if loose and len(b) > 1:
        up = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
        b[up] += 0x20
    cut = np.zeros(len(b) + 1, bool)
    cut[starts], cut[ends] = True, True
    inside = ~gap
    covered = np.zeros(len(b) + 1, np.int8)
    full = ends > starts
    np.add.at(covered, starts[full], 1)
    np.add.at(covered, ends[full], -1)
    inside &= np.cumsum(covered)[:-1] > 0
    before = np.concatenate(([False], inside[:-1])) if len(b) else inside
    after = np.concatenate((inside[1:], [False])) if len(b) else inside
    ws = np.flatnonzero(inside & (~before | cut[:-1]))
    we = np.flatnonzero(inside & (~after | cut[1:])) + 1
    doc = np.searchsorted(starts[full], ws, "right") - 1
    return spans_hash(prefix_sums(b), ws, we), np.flatnonzero(full)[doc] if len(ws) else doc


_FACTORS = [int(x) | 1 for x in mix(np.arange(1, 65, dtype=np.uint64), 0x51ED27)]


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words of one text; with fewer words the whole sequence is one."""
    if len(h) == 0:
        return h
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * np.uint64(_FACTORS[k % 64])
        out = out * np.uint64(BASE) if n > 64 else out
    return mix(out)


def list_array(parts: list[np.ndarray], kind=None) -> pa.Array:
    """Arrow lists from arrays, without Python objects in between."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    flat = flat.view(np.int64) if flat.dtype == np.uint64 else flat
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind or pa.int64()))


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values), offsets


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads, so that others of any name cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def over_text(df: DataFrame, fn: Callable, schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow over texts in batches small enough that long texts stay within a worker's memory."""

    def small(batches):
        return fn(b.slice(i, rows) for b in batches for i in range(0, max(1, b.num_rows), rows))

    return df.mapInArrow(small, schema)
