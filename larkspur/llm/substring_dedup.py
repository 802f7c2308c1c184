"""Suffix-array dedup: distributed prefix doubling over content-anchored positions.

Prefix doubling ranks positions by the pair (rank of the first h bytes, rank of what follows at
offset h), drops positions whose rank is unique and goes on with a larger h until the threshold is
reached. With a row for each byte the first round alone would write about 20 times the input, so
positions start in blocks, each round cuts the blocks that are still open into smaller cells, and
the length by which they are ranked grows:

* Round 1 (64 bytes). Of the 64-byte strings inside the first `passage` bytes of a position, the one
  with the least hash (the leftmost of equals) is its anchor, which depends on the bytes alone.
  Neighbouring positions with one anchor are a block. A block's rank is its anchor's 64 bytes; blocks
  with a unique rank are done: none of their strings occurs twice.
* Next rounds (337, 385, 397 bytes for a threshold of 400). Open blocks are cut into cells of 64, then
  16, then 4 positions, by their distance from the anchor. A cell's rank is the pair (rank of the
  anchor, rank of the bytes that all its strings have in common). Cells with a unique rank are done.
  So are those of which the bytes that their strings span together occur again: all their strings are
  repeated. The others, and for the strings that they may share with those, one cell of each span,
  go on.
* Last round (400 bytes). Each string of the cells left is ranked by all its bytes.

Ranks are hashes, so equal strings have one rank without a global sort; Spark shuffles and counts
them, and a string that stands a million times costs a partial sum. What is removed is decided by
joins on the pair of ranks (two 64-bit hashes, the second from polynomials modulo a prime). The
filters that carry survivors into the next scan are Bloom filters of fixed size, whose errors cost
work but no exactness.

In the second round each cell is also ranked by what its strings have in common of their first
`passage` bytes, which shows texts that share a shorter passage with another row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bits_of, log2_bits, longs, mix, over_text, prefix_sums, runs, spans_hash, texts_of, utf8

GRAM = 64
#: Positions in a cell, round by round.
CELLS = (64, 16, 4, 1)
#: Low bits that hold a place while the least hash is sought.
PLACE = 24
#: A prime, and the bases of two polynomials modulo it.
PRIME, BASES = (1 << 31) - 1, (1_000_003, 776_531_401)
#: Bits of a place that hold the number of positions (less 1), the first of them, and part of the row's name.
WIDE, FIRST = 6, 31


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i with i + w <= len(x)."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


_PRIME_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prime_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo PRIME for i < n."""
    if base not in _PRIME_POWERS or len(_PRIME_POWERS[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, PRIME)):
            x, step = np.ones(1, np.uint64), b
            while len(x) < max(n, 1 << 18):
                x = np.concatenate((x, x * np.uint64(pow(b, len(x), PRIME)) % np.uint64(PRIME)))
            out.append(x)
        _PRIME_POWERS[base] = (out[0], out[1])
    return _PRIME_POWERS[base]


class PrimeSums:
    """Hashes of byte strings from polynomials modulo a prime, unlike those of prefix_sums."""

    def __init__(self, buf: np.ndarray):
        self.sums = []
        for base in BASES:
            s = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _prime_powers(base, len(buf) + 1)[0][: len(buf)] % np.uint64(PRIME), out=s[1:])
            self.sums.append(s)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for base, s in zip(BASES, self.sums):
            x = (s[end] - s[start]) % np.uint64(PRIME) * _prime_powers(base, len(s))[1][start] % np.uint64(PRIME)
            out = (out << np.uint64(31)) | x
        return mix(out, 41)


class Piece:
    """Blocks of positions of consecutive texts, or of a part of a long one."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, passage: int):
        self.buf, self.ends = buf, ends
        self.s = prefix_sums(buf)
        gram = spans_hash(self.s, np.arange(len(buf) - GRAM + 1), np.arange(GRAM, len(buf) + 1))
        places = np.arange(len(gram), dtype=np.uint64)
        low = _sliding_min(((gram >> np.uint64(PLACE)) << np.uint64(PLACE)) | places, passage - GRAM + 1)
        at = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)  # the anchor of each position
        # The texts fill buf but for stretches that belong to none.
        fits = np.zeros(len(buf) + 1, np.int32)
        room = ends - starts >= passage
        np.add.at(fits, starts[room], 1)
        np.add.at(fits, ends[room] - passage + 1, -1)
        first = np.flatnonzero(np.cumsum(fits)[: len(at)] > 0)
        at = at[first]
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)))) if len(at) else np.zeros(0, np.int64)
        # Two texts are never one block: the anchor of a position lies inside its text.
        self.lo, self.anchor = first[new], at[new]
        self.hi = first[np.concatenate((new[1:], [len(first)])) - 1] if len(new) else self.lo
        self.doc = np.flatnonzero(room)[np.searchsorted(starts[room], self.lo, "right") - 1] if len(new) else self.lo
        self.rank = gram[self.anchor] if len(new) else np.zeros(0, np.uint64)

    def keep(self, some: np.ndarray) -> None:
        for name in ("lo", "hi", "anchor", "doc", "rank"):
            setattr(self, name, getattr(self, name)[some])


def pieces(column, length: int, passage: int, limit: int) -> Iterator[tuple[int, int, np.ndarray, Piece]]:
    """(first text, its byte offset, text starts, blocks). A text over the limit is cut where a block ends."""
    data, starts, ends = utf8(column)
    for i, j in runs(starts, ends, limit):
        lo, hi = starts[i], max(ends[j - 1], starts[i])
        if hi - lo < passage:
            continue
        if j - i > 1 or hi - lo <= limit:
            yield i, 0, starts[i:j] - lo, Piece(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo, passage)
            continue
        at = lo
        while hi - at >= passage:
            stop = min(hi, at + limit)
            p = Piece(data[at:stop], np.array([0]), np.array([stop - at]), passage)
            if stop < hi:  # what is cut off, or may go on behind the cut, comes with the next part
                p.keep(np.flatnonzero(p.hi[:-1] + length <= stop - at))
            yield i, at - lo, np.array([0]), p
            at += int(p.hi[-1]) + 1


class Cells:
    """The cells of `size` positions of the blocks kept; those without a string of `length` bytes have n = 0."""

    def __init__(self, p: Piece, keep: np.ndarray, size: int, length: int):
        a, lo, hi = p.anchor[keep], p.lo[keep], p.hi[keep]
        c0, c1 = (a - hi) // size, (a - lo) // size
        k = c1 - c0 + 1
        block = np.repeat(np.arange(len(a)), k)
        self.number = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(c0, k)
        self.block, self.doc, self.rank = keep[block], p.doc[keep][block], p.rank[keep][block]
        self.nearest = a[block] - size * self.number
        self.farthest = self.nearest - size + 1
        self.low, self.high = lo[block], hi[block]
        self.first = np.maximum(self.farthest, self.low)
        self.last = np.minimum(np.minimum(self.nearest, self.high), p.ends[self.doc] - length)
        self.n = np.maximum(self.last - self.first + 1, 0)

    def take(self, some: np.ndarray) -> Cells:
        for name, value in list(vars(self).items()):
            setattr(self, name, value[some])
        return self

    def parent_first(self, anchor: np.ndarray, size: int, wide: int) -> np.ndarray:
        """The first position of the cell of `wide` positions that holds the cell."""
        number = self.number * size // wide
        return np.maximum(anchor - wide * number - wide + 1, self.low)


def _scan(docs: DataFrame, per_piece, names: list[str], length: int, passage: int, limit: int, rows=None) -> DataFrame:
    """per_piece over the blocks of docs (row, tag, text); rows: a filter of the rows to look at."""

    def run(batches):
        for batch in batches:
            if rows is not None:
                batch = batch.take(pa.array(np.flatnonzero(rows.value.has(mix(longs(batch.column(0)))))))
                if not batch.num_rows:
                    continue
            ids, tags = longs(batch.column(0)), longs(batch.column(1))
            for i, shift, starts, p in pieces(batch.column(2), length, passage, limit):
                out = per_piece(p, ids[i:], tags[i:], shift, starts) if len(p.lo) else None
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) if isinstance(x, np.ndarray) else x for x in out], names)

    return over_text(docs, run, ", ".join(f"{n} long" for n in names))


def _key(row: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mix(mix(row) ^ mix(first, 99))


def _cell_keys(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    return _key(row, (place >> WIDE) & ((1 << FIRST) - 1))


def _filter_of(df: DataFrame, keys):
    return df.sparkSession.sparkContext.broadcast(bits_of(df, log2_bits(df.count()), keys))


def repeated(docs: DataFrame, length: int, passage: int, scratch: Scratch, limit: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """For docs (row, tag, text): (row, place), the positions whose strings of `length` bytes are repeated,
    and (row, tag, n), how many cells share a passage with another row."""
    if not 2 * GRAM <= passage <= length or limit < 2 * length + passage:
        raise ValueError(f"need {2 * GRAM} <= passage <= length, and a limit of more than two strings and a passage")

    def blocks(p, ids, tags, shift, starts):
        return (p.rank,)

    counts = _scan(docs, blocks, ["rank"], length, passage, limit).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    ranks = scratch.put(counts.where("n > 1").select("rank"), "ranks")
    held = docs.sparkSession.sparkContext.broadcast(bits_of(ranks, log2_bits(ranks.count())))
    scratch.drop("ranks")
    found, shared, rows, opened = [], None, None, None

    for level, size in enumerate(CELLS):

        def cells(p, ids, tags, shift, starts, size=size, level=level, opened=opened):
            keep = np.flatnonzero(held.value.has(p.rank))
            if not len(keep):
                return None
            if level:
                # Whole cells of the round before first, then the open ones' parts.
                wide = CELLS[level - 1]
                up = Cells(p, keep, wide, length)
                some = (up.n > 0) & opened.value.has(_key(ids[up.doc], up.first + shift - starts[up.doc]))
                if not some.any():
                    return None
                up.take(some)
                c = Cells(p, np.unique(up.block), size, length)
                inside = np.isin(_key(c.block, c.number * size // wide), _key(up.block, up.number))
                c.take(inside & (c.n > 0))
            else:
                c = Cells(p, keep, size, length)
            n, at = c.n, c.first + shift - starts[c.doc]
            place = (tags[c.doc] << (FIRST + WIDE)) | (at << WIDE) | (np.maximum(n, 1) - 1)
            real = n > 0
            core = np.zeros(len(n), np.uint64)
            core[real] = mix(spans_hash(p.s, c.nearest[real], c.farthest[real] + length) ^ mix(c.rank[real]))
            whole = np.zeros(len(n), np.uint64)
            if real.any():
                whole[real] = PrimeSums(p.buf).spans(c.first[real], c.last[real] + length)
            out = [ids[c.doc], place, pa.array(core.view(np.int64), mask=~real), whole]
            if not level:
                out.append(mix(spans_hash(p.s, c.nearest, c.farthest + passage) ^ mix(c.rank)))
            return out

        names = ["row", "place", "core", "whole"] + ([] if level else ["passage"])
        cell = scratch.put(_scan(docs, cells, names, length, passage, limit, rows), f"cells{size}")
        if not level:
            # A passage's cell counts where another row has it too.
            both = cell.groupBy("passage").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("passage")
            # Stored, so that both sides of the join are plain shuffles and a hot passage is split.
            both = scratch.put(both, "passages")
            tag = F.shiftright("place", FIRST + WIDE).alias("tag")
            shared = scratch.put(cell.select("row", tag, "passage").join(both, "passage", "left_semi").groupBy("row", "tag").agg(F.count(F.lit(1)).alias("n")), "shared")
        if size == 1:
            twice = cell.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core", "whole")
            twice = scratch.put(twice, "twice")
            found.append(scratch.put(cell.join(twice, ["core", "whole"], "left_semi").select("row", "place"), "found1"))
            scratch.drop("cells1")
            break
        # Of the cells with one rank, either all span the same bytes, so all are done, or the spans decide.
        group = cell.where("core is not null").groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
        group = scratch.put(group.where("n > 1").select("core", (F.col("a") == F.col("b")).alias("same")), f"ranks{size}")
        alive = scratch.put(cell.select("row", "place", "core", "whole").join(group, "core"), f"alive{size}")
        scratch.drop(f"cells{size}", f"ranks{size}")
        found.append(alive.where("same").select("row", "place"))
        part = alive.where(~F.col("same"))
        spans = part.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("c")).where("n > 1").select("core", "whole", "c")
        spans = scratch.put(spans, f"spans{size}")
        judged = scratch.put(part.join(spans.select("core", "whole", F.lit(True).alias("all")), ["core", "whole"], "left").select("row", "place", "core", "all"), f"judged{size}")
        found.append(judged.where("all").select("row", "place"))
        left = judged.where("all is null")
        also = spans.join(left.select("core").distinct(), "core", "left_semi").select("c.row", "c.place")
        next_ = scratch.put(left.select("row", "place").unionByName(also), f"open{size}")
        scratch.drop(f"spans{size}")
        if next_.isEmpty():
            break
        opened, rows = _filter_of(next_, _cell_keys), _filter_of(next_.select("row"), mix)
        scratch.drop(f"open{size}")

    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, shared


#: Positions that are merged in one go.
STRETCH = 12


def _ranges(found: DataFrame, length: int) -> DataFrame:
    """(row, tag, spans): the ranges of bytes that repeated strings cover, merged stretch by stretch, so that
    no list is longer than a stretch or a row's number of stretches and gaps."""
    stretch = F.shiftright("place", WIDE + STRETCH).alias("stretch")
    lists = found.groupBy("row", stretch).agg(F.sort_array(F.collect_list("place")).alias("places"))

    def merge(batches):
        for batch in batches:
            spans = []
            for places in batch.column(1):
                x = np.asarray(places.values)
                lo = (x >> WIDE) & ((1 << FIRST) - 1)
                hi = lo + (x & ((1 << WIDE) - 1)) + 1
                hi = np.maximum.accumulate(hi)
                new = np.concatenate(([True], lo[1:] > hi[:-1] + length - 1))
                end = hi[np.concatenate((np.flatnonzero(new)[1:], [len(x)])) - 1]
                spans.append([{"lo": int(a), "hi": int(b) + length - 1} for a, b in zip(lo[new], end)])
            tag = longs(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tag), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["row", "tag", "spans"])

    tag = F.shiftright("stretch", FIRST - STRETCH).alias("tag")
    return lists.select("row", "places", tag).mapInArrow(merge, "row long, tag long, spans array<struct<lo:long,hi:long>>")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, kept_text string"


def _batch(ids, out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept_text"])


def _cut(batches):
    """Text rows (doc_id, text, spans, n) with their ranges: what is removed and what stays."""
    for batch in batches:
        data, starts, ends = utf8(batch.column(1))
        ranges, shared = batch.column(2), batch.column(3).to_pylist()
        out = []
        for i in range(batch.num_rows):
            raw = data[starts[i] : ends[i]]
            gone = spans = 0
            keep = raw.tobytes()
            some = ranges[i].values
            if some is not None and len(some):
                a, b = np.asarray(some.field("lo")), np.minimum(np.asarray(some.field("hi")), len(raw))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.concatenate(([True], a[1:] > b[:-1]))
                a, b = a[new], b[np.concatenate((np.flatnonzero(new)[1:], [len(b)])) - 1]
                gone, spans = int((b - a).sum()), len(a)
                edges = np.concatenate(([0], np.stack((a, b), 1).ravel(), [len(raw)])).reshape(-1, 2)
                keep = b"".join(raw[x:y].tobytes() for x, y in edges)
            out.append((len(raw), gone, spans, hashlib.sha256(keep).hexdigest(), shared[i] or 0, keep.decode("utf-8", "replace")))
        yield _batch(batch.column(0), out)


def remove_repeats(docs: DataFrame, length: int = 400, limit: int = 1 << 18, passage: int = 255) -> DataFrame:
    """Remove every byte that a `length`-byte string covers which starts anywhere else, too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, kept_text (bytes that are no
    longer UTF-8 at a cut are replaced in kept_text, not in the digest). n_passages counts cells (up to
    64 neighbouring positions) whose common bytes another row has too: it is above 0 for every text that
    shares a string of `passage` bytes with another row, and 0 for those that share none of
    passage - 63. A null text is empty; texts below `length` bytes stay as they are; rows that repeat
    are texts of their own, so both lose what they share, whatever their doc_id (null ones included).
    Other columns are ignored. Texts longer than `limit` bytes are scanned in parts that give the same
    result.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    passage = min(passage, length)
    # A row's name: 64 and 26 bits from its id and content. Copies of one row share it; all of them
    # are repeated whole.
    tag = F.shiftrightunsigned(F.xxhash64("text", "doc_id"), 38).alias("tag")
    named = texts_of(docs).select(F.xxhash64("doc_id", "text").alias("row"), tag, "text", "doc_id")
    found, shared = repeated(named.select("row", "tag", "text"), length, passage, scratch, limit)
    twins = named.where(F.octet_length("text") >= passage).groupBy("row", "tag").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("size")).where("n > 1")
    twins = scratch.put(twins, "twins")
    kind = "array<struct<lo:long,hi:long>>"
    whole = F.when(F.col("size") >= length, F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi")))).otherwise(F.array()).cast(kind)
    parts = _ranges(found, length).withColumn("n", F.lit(0).cast("long"))
    parts = parts.unionByName(shared.select("row", "tag", F.array().cast(kind).alias("spans"), "n")).unionByName(twins.select("row", "tag", whole.alias("spans"), F.lit(1).cast("long").alias("n")))
    known = scratch.put(parts.groupBy("row", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.sum("n").alias("n")), "known")
    held = _filter_of(known.select("row"), mix)

    def plain(batches):
        """Rows of which nothing is known are as they are; the others' texts go into the join."""
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(~held.value.has(mix(longs(batch.column(0)))))))
            data, starts, ends = utf8(batch.column(1))
            raw = [data[a:b].tobytes() for a, b in zip(starts, ends)]
            yield _batch(batch.column(2), [(len(x), 0, 0, hashlib.sha256(x).hexdigest(), 0, x.decode()) for x in raw])

    def wanted(batches):
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(held.value.has(mix(longs(batch.column(0)))))))

    rest = over_text(named.select("row", "text", "doc_id"), plain, RESULT, 256)
    some = over_text(named.select("row", "tag", "text", "doc_id"), wanted, "row long, tag long, text string, doc_id long", 256)
    both = some.join(known, ["row", "tag"], "left").select("doc_id", "text", "spans", "n")
    return rest.unionByName(over_text(both, _cut, RESULT, 256))


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).drop("kept_text")
