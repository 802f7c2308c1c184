"""Language ID with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds for every slot one bit per language; the AND of an n-gram's slots
gives all languages that contain it in one look-up. A text's language is the one with the most
n-grams, after each count is corrected for the false positives that the language's fill predicts.

A language contains an n-gram when the n-gram's rate there is at least `least_share` of its highest
rate in any language, so strays in mixed texts don't fill the filters. The fit takes a bounded sample
of the labelled rows (`max_docs` for each language, by a hash of id and text); predictions read every
text whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROW, Scratch, in_share, longs, merged, mix, over_text, partials, row_name, runs, utf8, PARTIALS

N = 4
PROBES = 2
LETTER = regex.compile(r"\p{L}")
_FOLD = LOWER.copy()
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _grams(data, starts, ends):
    """Packed 4-byte grams of the folded texts, each set off by spaces, and the text of each."""
    size = ends - starts
    buf = np.full(int(size.sum()) + (len(starts) + 1) * 1, 32, np.uint8)
    base = np.concatenate(([0], np.cumsum(size + 1)))
    idx = np.arange(len(starts)).repeat(size)
    buf[np.arange(int(size.sum())) + idx + 1] = _FOLD[data]
    up = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    buf[up] += 0x20
    if len(buf) < N:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    b = buf.astype(np.uint32)
    g = b[: len(b) - 3] | b[1 : len(b) - 2] << 8 | b[2 : len(b) - 1] << 16 | b[3:] << 24
    at = np.arange(len(g))
    doc = np.searchsorted(base, at, "right") - 1
    ok = (doc < len(starts)) & (at + N <= base[np.minimum(doc + 1, len(starts))] + 1)
    ok &= (buf[1 : len(g) + 1] != 32) | (buf[2 : len(g) + 2] != 32)
    return g[ok], doc[ok]


def _pieces(column):
    data, starts, ends = utf8(column)
    ends = np.maximum(ends, starts)
    for i, j in runs(starts, ends):
        lo, hi = starts[i], ends[j - 1]
        if (starts[i + 1 : j] == ends[i : j - 1]).all():
            yield i, j, *_grams(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
        else:  # null slots that hold bytes
            for k in range(i, j):
                g, d = _grams(data[starts[k] : ends[k]], np.array([0]), np.array([ends[k] - starts[k]]))
                yield k, k + 1, g, d


def _slots(g: np.ndarray, log2: int) -> list[np.ndarray]:
    h = mix(g)
    low = np.uint64((1 << log2) - 1)
    return [((h >> np.uint64(k * 27)) & low).astype(np.int64) for k in range(PROBES)]


class Filters:
    """Languages in order, and for each 64 of them a table of bit masks."""

    def __init__(self, names: list[str], log2: int, tables: dict[int, np.ndarray], commonest: int):
        self.names, self.log2, self.commonest = names, log2, commonest
        self.tables = [tables.get(p, np.zeros(1 << log2, np.uint64)) for p in range((len(names) + 63) // 64)]
        self.false = np.array([(((self.tables[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) ** PROBES for k in range(len(names))])

    def masks(self, g: np.ndarray) -> list[np.ndarray]:
        slots = _slots(g, self.log2)
        out = []
        for t in self.tables:
            m = t[slots[0]]
            for s in slots[1:]:
                m = m & t[s]
            out.append(m)
        return out

    def counts(self, g: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text its n-grams, and for each language the corrected number that it contains."""
        total = np.bincount(doc, minlength=n).astype(float)
        got = np.empty((len(self.names), n))
        masks = self.masks(g)
        for k in range(len(self.names)):
            has = ((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.float64)
            got[k] = (np.bincount(doc, has, n) - total * self.false[k]) / max(1e-9, 1 - self.false[k])
        return total, got


def fit(docs: DataFrame, scratch: Scratch, max_docs: int = 20_000, least_share: float = 0.2, least_count: int = 2) -> Filters:
    """Filters learned from rows (doc_id, text, lang) whose lang is not null. The driver holds a few numbers for
    each language, so this is meant for up to some thousand languages."""
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Filters([], 16, {}, 0)
    number = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])[F.col("lang")]
    # Of each language a share that gives max_docs rows, chosen by hash: the same in every run.
    share = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, max_docs / sizes[name]))])[F.col("lang")]
    sample = known.where(in_share(share, "doc_id", "text", F.lit(5))).select(number.cast("long").alias("k"), "text")

    def count(batches):
        for batch in batches:
            lang = longs(batch.column(0))
            for i, j, g, doc in _pieces(batch.column(1)):
                key, n = np.unique(lang[i:j][doc].astype(np.uint64) << np.uint64(32) | g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(32)).astype(np.int64)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["k", "gram", "n"])

    seen = over_text(sample, count, "k long, gram long, n long", 2048).groupBy("k", "gram").agg(F.sum("n").alias("n"))
    seen = scratch.put(seen, "grams")
    totals = {r["k"]: r["n"] for r in seen.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, float(n))])[F.col("k")] if totals else F.lit(0.0)
    rated = seen.select("k", "gram", "n", rate.alias("rate"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    chosen = scratch.put(rated.join(top, "gram").where((F.col("rate") >= least_share * F.col("top")) & (F.col("n") >= least_count)).select("k", "gram"), "chosen")
    log2 = int(min(22, max(16, np.ceil(np.log2(16.0 * max(1, chosen.count()))))))

    def fill(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            k, g = longs(batch.column(0)), longs(batch.column(1)).astype(np.uint32)
            for part in np.unique(k // 64):
                t = tables.setdefault(int(part), np.zeros(1 << log2, np.uint64))
                mine = k // 64 == part
                for s in _slots(g[mine], log2):
                    np.bitwise_or.at(t, s, np.uint64(1) << (k[mine] % 64).astype(np.uint64))
        yield from partials(tables)

    tables = merged(chosen.mapInArrow(fill, PARTIALS), 1 << log2, np.uint64, "or")
    return Filters(names, log2, tables, max(range(len(names)), key=lambda k: (sizes[names[k]], -k)))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, row, lang_pred, score) for rows (doc_id, row, text).

    lang_pred is `und` (score 0) if the text is null or has no letter, or if nothing was learned. A
    text whose n-grams no language contains gets the commonest language with score 0. Of equal
    counts the first name wins. score is the share of n-grams the language contains.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        f: Filters = held.value
        for batch in batches:
            n = batch.num_rows
            name, score = ["und"] * n, np.zeros(n)
            column = batch.column(2)
            for i, j, g, doc in _pieces(column) if f.names else ():
                total, got = f.counts(g, doc, j - i)
                best = got.argmax(axis=0)
                share = np.clip(got[best, np.arange(j - i)] / np.maximum(total, 1), 0, 1)
                for k in range(j - i):
                    name[i + k] = f.names[best[k] if share[k] > 0 else f.commonest]
                score[i:j] = share
            for k in range(n):
                if name[k] != "und":
                    text = column[k].as_py()
                    if text is None or not LETTER.search(text):
                        name[k], score[k] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name), pa.array(score)], ["doc_id", "row", "lang_pred", "score"])

    return over_text(docs.select("doc_id", "row", "text"), run, f"doc_id long, row {ROW}, lang_pred string, score double")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("row", row_name())


def identify(docs: DataFrame, learn_from=None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, row, lang_pred, score) for every row of docs (doc_id, text, lang, ...), learned from the
    rows where the condition learn_from holds (all that have a lang, by default). Rows that repeat
    stay; a null doc_id is allowed; other columns are ignored; row is row_name()."""
    scratch = scratch or Scratch(docs.sparkSession, "language")
    rows = _rows(docs)
    filters = fit(rows if learn_from is None else rows.where(learn_from), scratch)
    return predict(rows, filters)


def keep_identified(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """docs whose language is known with the least score; the others (no letter, null, or n-grams that
    no language has) go. Columns are those of docs; rows that repeat stay repeated."""
    scratch = Scratch(docs.sparkSession, "language-stage")
    found = identify(docs, scratch=scratch)
    bad = scratch.put(found.where((F.col("lang_pred") == "und") | (F.col("score") < least_score)).select(F.col("row").alias("_bad")).distinct(), "bad")
    return docs.join(bad, row_name() == bad["_bad"], "left_anti").select(*docs.columns)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    found = identify(docs, learn_from=fold != 1)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
