"""Benchmark decontamination by spaced-seed hashing.

Masks pick some of the tokens of a window and ignore the others, so a window still hits where an
ignored token was substituted. The masks of a length are chosen so that every placement of the
substitutions that the check allows is hit by one of them (see masks). Windows of the test items give an index (hash, item, place). The
training texts are scanned once; a Bloom filter of fixed size keeps the windows that may be in the
index, and a Spark join on the hash decides. Around the hits of one item on one diagonal, tokens are
compared place by place: a text counts as contaminated where, of `window` consecutive tokens, a share
of `threshold` is the same.

Tokens are runs of ASCII letters, digits and non-ASCII characters in lower case (ASCII and Latin-1),
so punctuation and line breaks don't hide a copy.

Items shorter than `window` are compared whole, by the same share: up to 4 tokens that means exact
copies. Items of one or two tokens stand in nearly every text, so they count only where they are the
whole text.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Bits, Scratch, bits_of, list_array, lists, log2_bits, longs, mix, over_text, row_name, runs, utf8, words

#: Items below this many tokens are sought only as whole texts.
WHOLE = 3
#: Most masks of one length; more of them would be heavier and hit less by chance.
MOST = 5
#: Longest window whose placements are enumerated.
ENUMERATED = 16


@lru_cache(None)
def masks(length: int, wrong: int) -> tuple[str, ...]:
    """Masks of which at least one, somewhere inside a window of `length` tokens, avoids any `wrong` places.

    The heaviest weight that a greedy cover reaches with MOST masks is taken. Longer windows get the
    run of equal tokens that any `wrong` places must leave."""
    if wrong == 0 or length > ENUMERATED:
        return ("1" * (length // (wrong + 1)),)
    places = np.array([sum(1 << k for k in c) for c in combinations(range(length), wrong)], np.int64)
    for weight in range(length - wrong, 0, -1):
        shapes = [x for x in range(1, 1 << length, 2) if x.bit_count() == weight]
        hit = np.zeros((len(shapes), len(places)), bool)
        for k, x in enumerate(shapes):
            for shift in range(length - x.bit_length() + 1):
                hit[k] |= places & (x << shift) == 0
        out, left = [], np.ones(len(places), bool)
        while left.any() and len(out) < MOST:
            best = int((hit & left).sum(1).argmax())
            out.append(f"{shapes[best]:b}"[::-1])
            left &= ~hit[best]
        if not left.any():
            return tuple(out)
    raise ValueError(f"no masks for {wrong} of {length} places")


def _needed(length: int, threshold: float) -> int:
    """Equal tokens that a window of this length must have."""
    return max(1, ceil(threshold * length - 1e-9))


def seeds_of(tokens: int, window: int = 13, threshold: float = 0.8) -> tuple[tuple[str, bool], ...]:
    """(mask, whether only whole texts count) under which an item of so many tokens is indexed."""
    if tokens < WHOLE:
        return (("1" * tokens, True),)
    w = min(window, tokens)
    return tuple((m, False) for m in masks(w, w - _needed(w, threshold)))


def _tokens(column):
    data, starts, ends = utf8(column)
    for i, j in runs(starts, ends):
        lo, hi = starts[i], max(ends[j - 1], starts[i])
        h, doc = words(data[lo:hi], starts[i:j] - lo, np.maximum(ends[i:j], starts[i:j]) - lo, loose=True)
        yield i, j, h, np.searchsorted(doc, np.arange(j - i + 1))


def _seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hashes of the windows of h under a mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    return mix(out)


def _salt(mask: str, whole: bool) -> int:
    return (int(mask, 2) * 128 + 2 * len(mask) + whole) & 0xFFFFFFFFFFFFFFFF


def index(benchmark: DataFrame, scratch: Scratch, window: int, threshold: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(item_id, tokens) and (hash, item_id, place) of the test items with `least` tokens or more."""

    def tokenize(batches):
        for batch in batches:
            parts = [h[at[k] : at[k + 1]] for i, j, h, at in _tokens(batch.column(1)) for k in range(j - i)]
            keep = [k for k, p in enumerate(parts) if len(p) >= max(1, least)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), list_array([parts[k] for k in keep])], ["item_id", "tokens"])

    def seed(batches):
        for batch in batches:
            ids = batch.column(0)
            values, offsets = lists(batch.column(1))
            who, place, key = [], [], []
            for k in range(batch.num_rows):
                h = values[offsets[k] : offsets[k + 1]].view(np.uint64)
                for mask, whole in seeds_of(len(h), window, threshold):
                    s = _seeds(h, mask, _salt(mask, whole))
                    key.append(s)
                    place.append(np.arange(len(s)))
                    who.append(np.full(len(s), k))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), ids.take(pa.array(np.concatenate(who))), pa.array(np.concatenate(place))], ["hash", "item_id", "place"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    items = scratch.put(over_text(items, tokenize, "item_id long, tokens array<long>"), "items")
    return items, scratch.put(over_text(items, seed, "hash long, item_id long, place long"), "index")


def _segments(docs: DataFrame, bits, seeds: list[tuple[str, bool]], window: int) -> DataFrame:
    """Token stretches around hits: one row each, from token `first` of the text, with the hits' places and
    hashes."""

    def scan(batches):
        have: Bits = bits.value
        for batch in batches:
            rows, firsts, toks, places, keys = [], [], [], [], []
            for i, j, h, at in _tokens(batch.column(2)):
                # Windows over the border of two texts are dropped below.
                at_hits, at_keys = [], []
                for mask, whole in seeds:
                    s = _seeds(h, mask, _salt(mask, whole))
                    p = np.flatnonzero(have.has(s))
                    d = np.searchsorted(at, p, "right") - 1
                    end = at[np.minimum(d + 1, len(at) - 1)]
                    p = p[(p == at[d]) & (p + len(mask) == end) if whole else p + len(mask) <= end]
                    at_hits.append(p)
                    at_keys.append(s[p])
                if not sum(map(len, at_hits)):
                    continue
                p, key = np.concatenate(at_hits), np.concatenate(at_keys)
                order = np.argsort(p, kind="stable")
                p, key = p[order], key[order]
                d = np.searchsorted(at, p, "right") - 1
                reach = window + max(len(mask) for mask, _ in seeds)
                new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] - p[:-1] > 2 * reach))))
                for x, y in zip(new, np.concatenate((new[1:], [len(p)]))):
                    k = int(d[x])
                    a, b = max(int(at[k]), int(p[x]) - reach), min(int(at[k + 1]), int(p[y - 1]) + reach)
                    rows.append(i + k)
                    firsts.append(a - int(at[k]))
                    toks.append(h[a:b])
                    places.append(p[x:y] - a)
                    keys.append(key[x:y])
            if rows:
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(firsts, pa.int64()), list_array(toks), list_array(places), list_array(keys)], ["row", "doc_id", "first", "tokens", "places", "keys"])

    return over_text(docs, scan, f"row {ROW}, doc_id long, first long, tokens array<long>, places array<long>, keys array<long>")


def _verified(rows: DataFrame, window: int, threshold: float) -> DataFrame:
    """rows: (row, doc_id, item_id, skip, tokens, item), the tokens that lie against item from token skip on."""
    need = {w: _needed(w, threshold) for w in range(1, window + 1)}

    def compare(batches):
        for batch in batches:
            skip = longs(batch.column(3))
            (x, xo), (y, yo) = lists(batch.column(4)), lists(batch.column(5))
            keep, best = [], []
            for k in range(batch.num_rows):
                t, u = x[xo[k] : xo[k + 1]], y[yo[k] : yo[k + 1]]
                w = min(window, len(u))
                if len(t) < w:
                    continue
                same = np.concatenate(([0], np.cumsum(t == u[skip[k] : skip[k] + len(t)])))
                if int((same[w:] - same[:-w]).max()) >= need[w]:
                    keep.append(k)
                    best.append(int(same[-1]))
            take = pa.array(keep, pa.int64())
            size = np.diff(yo)[keep] if keep else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(best, pa.int64()), pa.array(np.asarray(size, np.int64))], ["row", "doc_id", "item_id", "matched", "item_tokens"])

    return over_text(rows, compare, f"row {ROW}, doc_id long, item_id long, matched long, item_tokens long")


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, threshold: float = 0.8, scratch: Scratch | None = None, least: int = WHOLE) -> DataFrame:
    """(row, doc_id, item_id, matched, item_tokens): each contaminated text with each item it overlaps.

    row is row_name(); matched counts equal tokens on the best diagonal. Null, empty and
    too short texts overlap with nothing, items with fewer than `least` tokens or without an id are
    not sought, items shorter than `window` are compared whole, those of one or two tokens (with
    least=1) with whole texts only. Rows that repeat give one result row.
    Whole texts are searched; other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontaminate")
    items, places = index(benchmark, scratch, window, threshold, least)
    n, lengths = places.count(), [r[0] for r in items.select(F.least(F.size("tokens"), F.lit(max(window, WHOLE))).alias("n")).distinct().collect()]
    seeds = sorted({s for length in lengths for s in seeds_of(length, window, threshold)})
    bits = spark.sparkContext.broadcast(bits_of(places, log2_bits(n, per=1024, least=20), columns=("hash",)))
    ids = docs.select(row_name().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    segments = scratch.put(_segments(ids, bits, seeds, window), "segments")
    hits = segments.select("row", "first", F.explode(F.arrays_zip("places", "keys")).alias("h")).select("row", "first", F.col("h.places").alias("at"), F.col("h.keys").alias("hash"))
    found = hits.join(places, "hash").select("row", "first", "item_id", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    found = scratch.put(found.join(items.withColumnRenamed("tokens", "item"), "item_id"), "found")
    # Of a stretch only the tokens that lie against the item go on, however many diagonals it has.
    both = found.join(segments.select("row", "first", "doc_id", "tokens").dropDuplicates(["row", "first"]), ["row", "first"])
    skip = F.greatest(F.lit(0).cast("long"), -F.col("diagonal"))
    start = F.col("diagonal") + skip
    n = F.least(F.size("tokens") - start, F.size("item") - skip)
    both = both.where(n > 0).select("row", "doc_id", "item_id", skip.alias("skip"), F.slice("tokens", (start + 1).cast("int"), n.cast("int")).alias("tokens"), "item")
    rows = _verified(both, window, threshold)
    return rows.groupBy("row", "doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("item_tokens").alias("item_tokens"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, threshold: float = 0.8, least: int = WHOLE) -> DataFrame:
    """docs without the texts that overlap a benchmark item; rows and columns otherwise as they are."""
    scratch = Scratch(docs.sparkSession, "decontaminate-stage")
    bad = scratch.put(overlaps(docs, benchmark, window, threshold, scratch, least).select(F.col("row").alias("_bad")).distinct(), "bad")
    return docs.join(bad, row_name() == bad["_bad"], "left_anti").select(*docs.columns)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return overlaps(docs, bench, least=1).drop("row")
