"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

1. A first pass counts, over all texts, the shingles whose hash is so small that they may become keys.
   Those that several texts share go into Bloom filters by magnitude. The number of filters that have a
   shingle, then its hash, order all shingles, rare ones first. Any such order is right, as long as it
   is the same for all texts; only the amount of work depends on it.
2. A set of n shingles must share one of its first n - ceil(t*n) + 1 with every set that is similar
   by t: its keys. Texts with one and the same set are one class first, so groups of copies never meet.
3. Every set is paired with the least set of each of its keys (a star, not all pairs). A parity bitmap
   of 512 bits bounds the symmetric difference from below, so the overlap from above; what passes is
   verified by exact intersection of the sorted shingle arrays.
4. A set is named by the least head it is linked to. Pairs that share a key are then tried only
   between different names, in the first key they share, so no link between components is lost and a
   large group of near copies costs a star. The band of sizes within which two sets can be similar is part
   of the join's condition, not of its key: with bands in the key, each set must look into its own and
   the next band's tile, and the copies of its row cost more shuffle than the pairs that are saved.

Memory: batches of texts, and Bloom filters of at most 16 MB each.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, Scratch, bits_of, list_array, lists, log2_bits, longs, mix, over_text, runs, shingles, texts_of, utf8, words
from .components import components

#: Texts that share a shingle, for each filter of the order; and a set up to this size is counted whole.
SHARED, SMALL = (3, 12, 48, 192, 768, 3072), 64
#: A tile of more sets than this is large.
FEW = 4


def sets_of(column, size: int) -> Iterator[np.ndarray]:
    """The shingle hashes, in order and with repetitions, of each text of an Arrow column."""
    data, starts, ends = utf8(column)
    for i, j in runs(starts, ends):
        lo = starts[i]
        h, doc = words(data[lo : ends[j - 1]] if j > i else data[:0], starts[i:j] - lo, np.maximum(ends[i:j], starts[i:j]) - lo)
        at = np.searchsorted(doc, np.arange(j - i + 1))
        for k in range(j - i):
            yield shingles(h[at[k] : at[k + 1]], size)


def _levels(docs: DataFrame, size: int, threshold: float, scratch: Scratch) -> list[Bits]:
    """Filters of the shingles that at least so many texts share, by the numbers in SHARED."""
    least = np.uint64(min(1.0, 1.5 * (1 - threshold)) * (2**64 - 2**12))

    def small(batches):
        for batch in batches:
            keys = [u if len(u) <= SMALL else u[: np.searchsorted(u, least)] for u in map(np.unique, sets_of(batch.column(0), size))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))], ["key"])

    counts = over_text(docs.select("text"), small, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED[0])
    counts = scratch.put(counts, "counts")
    sizes = counts.agg(*[F.count(F.when(F.col("n") >= k, 1)).alias(str(k)) for k in SHARED]).first()
    return [bits_of(counts.where(F.col("n") >= k), log2_bits(sizes[str(k)]), columns=("key",)) for k in SHARED if sizes[str(k)]]


def _share(t: float) -> Fraction:
    return Fraction(str(t))


def _sketches(docs: DataFrame, filters, size: int, threshold: float, schema: str):
    t = _share(threshold)

    def sketch(batches):
        for batch in batches:
            n, k1, k2, bits, keys = [], [], [], [], []
            for s in sets_of(batch.column(1), size):
                u = np.unique(s)
                n.append(len(u))
                k1.append(np.bitwise_xor.reduce(u) if len(u) else np.uint64(0))
                k2.append(np.add.reduce(mix(u, 77)) if len(u) else np.uint64(0))
                spot = (mix(u, 5) & np.uint64(511)).astype(np.int64)
                parity = (np.bincount(spot, minlength=512) & 1).astype(np.uint8)
                bits.append(np.packbits(parity).view(np.int64))
                take = len(u) - ceil(t * len(u)) + 1 if len(u) else 0
                level = np.zeros(len(u), np.uint64)
                for f in filters.value:
                    level += f.has(u)
                order = (level << np.uint64(57)) | (u >> np.uint64(7))
                keys.append(np.partition(order, take - 1)[:take] if 0 < take < len(u) else order)
            k1, k2 = np.array(k1, np.uint64).view(np.int64), np.array(k2, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), list_array(bits), list_array(keys)], ["doc_id", "n_shingles", "k1", "k2", "bits", "keys"])

    return over_text(docs, sketch, schema)


def _arrays(docs: DataFrame, wanted, size: int):
    """The sorted shingle arrays of the texts whose id the filter has; others cost one scan."""

    def arrays(batches):
        bits = wanted.value
        for batch in batches:
            keep = np.flatnonzero(bits.has(mix(longs(batch.column(0)))))
            if len(keep):
                some = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([some.column(0), list_array([np.unique(s) for s in sets_of(some.column(1), size)])], ["doc_id", "grams"])

    return over_text(docs.where("doc_id is not null"), arrays, "doc_id long, grams array<long>")


def _verify(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches the threshold."""
    t = _share(threshold)

    def exact(batches):
        for batch in batches:
            a, b = longs(batch.column(0)), longs(batch.column(1))
            (x, xo), (y, yo) = lists(batch.column(2)), lists(batch.column(3))
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                p, q = x[xo[i] : xo[i + 1]].view(np.uint64), y[yo[i] : yo[i + 1]].view(np.uint64)
                if len(q) < len(p):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep[i] = both * t.denominator >= t.numerator * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["u", "v"])

    one, two = grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ga", "gb")
    return over_text(both, exact, "u long, v long", 256)


def similar_sets(docs: DataFrame, size: int = 3, threshold: float = 0.9, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text, ...).

    Texts link when the Jaccard similarity of their sets of `size`-word shingles is at least the
    threshold (compared as exact fractions). component_id is the least doc_id reachable by links.
    A null or blank text has an empty set, links with nothing and is its own component; so is a row
    whose doc_id is null, whose component is null. Rows that repeat a doc_id are one node, and each
    stays in the result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    t, sc = _share(threshold), spark.sparkContext
    docs = texts_of(docs)
    filters = sc.broadcast(_levels(docs, size, threshold, scratch))
    found = scratch.put(_sketches(docs, filters, size, threshold, "doc_id long, n_shingles long, k1 long, k2 long, bits array<long>, keys array<long>"), "sets")

    n = found.count()
    # What is asked of every row later, without signatures and keys, so that those can go early.
    rows_of = scratch.put(found.select("doc_id", "n_shingles", "k1", "k2"), "who", n)
    # One class for each distinct set; its least doc_id stands for it.
    full = found.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.put(full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes", n)
    member = rows_of.where("n_shingles > 0 and doc_id is not null").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "rep")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi")
    reps = scratch.put(reps.dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "n_shingles", "bits", "keys"), "reps", n)
    scratch.drop("sets")

    tiles = scratch.put(reps.select("doc_id", "n_shingles", F.explode("keys").alias("key")), "tiles")
    signature = scratch.put(reps.select("doc_id", "n_shingles", "bits"), "signature", n)
    scratch.drop("reps")
    heads = tiles.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head <> last")
    heads = scratch.put(heads.select("key", "head"), "heads")
    shared = scratch.put(tiles.join(heads, "key"), "shared")
    scratch.drop("tiles", "heads")

    num, den = t.numerator, t.denominator

    def allowed(na: str, nb: str, sa: str, sb: str):
        """What sizes and bit counts allow: with d bits apart, the overlap is at most (na + nb - d) / 2."""
        apart = F.bit_count(F.get(sa, F.lit(0)).bitwiseXOR(F.get(sb, F.lit(0))))
        for k in range(1, 8):
            apart = apart + F.bit_count(F.get(sa, F.lit(k)).bitwiseXOR(F.get(sb, F.lit(k))))
        most = F.floor((F.col(na) + F.col(nb) - apart) / 2)
        return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (most * den >= (F.col(na) + F.col(nb) - most) * num)

    def links(pairs: DataFrame, name: str) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        ids = scratch.put(ids, f"{name}ids", n)
        wanted = sc.broadcast(bits_of(ids, log2_bits(ids.count()), mix))
        grams = _arrays(docs, wanted, size).join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").distinct()
        return scratch.put(_verify(pairs, grams, threshold), f"{name}links", n)

    stars = shared.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    one, two = (signature.select(F.col("doc_id").alias(x), F.col("n_shingles").alias("n" + x), F.col("bits").alias("s" + x)) for x in "ab")
    stars = stars.join(one, "a").join(two, "b").where(allowed("na", "nb", "sa", "sb")).select("a", "b")
    first = links(scratch.put(stars, "starpairs", n), "star")

    # A set's least linked head names it: sets of one name are connected already.
    label = scratch.put(first.groupBy(F.col("v").alias("doc_id")).agg(F.min("u").alias("c")), "label", n)
    named = scratch.put(shared.join(label, "doc_id", "left").select("key", "doc_id", "head", F.coalesce("c", "doc_id").alias("c")), "named")
    scratch.drop("shared")
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("m")).where("c0 <> c1").select("key", (F.col("m") > FEW).alias("large"))
    rows = scratch.put(named.join(scratch.put(mixed, "mixed"), "key"), "open")
    scratch.drop("named", "mixed")
    # Each set with its keys of large open tiles; a pair is tried in the first of those that both share
    # (and in each small tile), and the bound is part of the join, so only pairs that may be similar
    # come out.
    keys = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("large"), F.col("key")))).alias("keys"))
    known = scratch.put(keys.join(signature, "doc_id"), "known", n)
    rows = rows.join(known, "doc_id").withColumn("keys", F.when(F.col("large"), F.col("keys")))
    rows = scratch.put(rows, "rows")
    scratch.drop("open", "known", "signature", "label")
    left = rows.select("key", "large", F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("c").alias("ca"), "head", F.col("bits").alias("sa"), F.col("keys").alias("ka"))
    right = rows.select(F.col("key").alias("key2"), F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("c").alias("cb"), F.col("bits").alias("sb"), F.col("keys").alias("kb"))
    first_shared = F.array_min(F.array_intersect("ka", "kb")) == F.col("key")
    cross = left.join(right, (F.col("key") == F.col("key2")) & (F.col("ca") < F.col("cb")) & (F.col("a") != F.col("head")) & (F.col("b") != F.col("head")) & allowed("na", "nb", "sa", "sb") & (~F.col("large") | first_shared))
    cross = scratch.put(cross.select("a", "b").distinct(), "crosspairs", n)
    scratch.drop("rows")
    second = links(cross, "cross")

    edges = first.unionByName(second).unionByName(member.select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    final = scratch.put(components(edges, scratch, n), "final", n)
    out = rows_of.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the least doc_id.

    Rows without a doc_id are kept; of rows that repeat a kept doc_id all are kept, as they are one
    document. Columns are those of docs.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-stage")
    found = similar_sets(docs, size, threshold, scratch)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = scratch.put(gone, "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*docs.columns)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
