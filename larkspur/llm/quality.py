"""Quality classifier: Bradley-Terry pairwise ranking.

Each pair of a preferred (label 1) and another document (label 0) is a game that the first one won;
logistic loss on the difference of their features gives weights, and a document's score is its
weighted features. The threshold is the quantile of the scores of the labelled documents that parts
them with the fewest errors; it is mapped to `cut`.

Features come from the bytes of the whole text: shares of byte values, of the byte pairs' classes,
lengths of words and lines, and how much of it repeats. Every labelled row that may be learned from is
in the fit and in the threshold. Rows are dealt out by a hash into blocks of about LARGER of the more
frequent label and at least about RARER of the other one, whose rows play in several blocks where they are
few; within a block every preferred row plays against every other one. So up to LARGER rows a label, all
pairs are games, and beyond that the work grows with the rows. Each Newton step sums the blocks'
gradients and Hessians on the executors; the threshold is read from cumulated counts of all scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import cumulated, numbered
from .common import PARTIALS, SPACE, Scratch, bits_of, list_array, lists, log2_bits, longs, merged, mix, over_text, partials, runs, utf8, words

#: Rows of a block, of the more frequent label and (at least, about) of the other one.
LARGER, RARER = 512, 64
#: Rows of a file of blocks. Such a file is one row group, so no task reads a part of a block.
FILE_ROWS = 4_096
#: All games together weigh this much against the ridge, or 8 for each row if that is less.
GAMES = 30_000
#: Sums over blocks are in units of 1 / UNIT: integers, so neither tasks nor their order change them.
UNIT = float(1 << 54)
#: Pieces in which the sums are added up.
PIECE = 8_192

#: Classes of bytes: space, line break, lower, upper, digit, other ASCII one by one in four groups, beyond ASCII.
_CLASS = np.array([1 if c == 10 else 0 if SPACE[c] else 2 if 97 <= c <= 122 else 3 if 65 <= c <= 90 else 4 if 48 <= c <= 57 else 9 if c >= 128 else 5 if c in b".,;:" else 6 if c in b"!?" else 7 if c in b"'\"()-" else 8 for c in range(256)])
CLASSES = 10
#: Bytes 0-127, class pairs, and the figures of _shape.
WIDTH = 128 + CLASSES * CLASSES + 8


def _shape(n: int, h: np.ndarray, lines: int) -> list[float]:
    k = len(h)
    distinct = len(np.unique(h)) / k if k else 0.0
    pairs = h[:-1] * np.uint64(3) + h[1:] if k > 1 else h
    return [np.log1p(n) / 10, np.log1p(k) / 10, n / (k + 1) / 20, distinct, 1 - len(np.unique(pairs)) / max(1, len(pairs)), lines / (k + 1), float(k < 20), float(n == 0)]


def features(column) -> np.ndarray:
    """A row of WIDTH numbers for each text; null and empty texts have a row of their own kind."""
    data, starts, ends = utf8(column)
    out = np.zeros((len(starts), WIDTH))
    for i, j in runs(starts, ends):
        lo, hi = starts[i], max(ends[j - 1], starts[i])
        h, doc = words(data[lo:hi], starts[i:j] - lo, np.maximum(ends[i:j], starts[i:j]) - lo)
        at = np.searchsorted(doc, np.arange(j - i + 1))
        for k in range(i, j):
            b = data[starts[k] : ends[k]]
            n = max(1, len(b))
            count = np.bincount(b, minlength=256)
            c = _CLASS[b]
            out[k, :128] = np.sqrt(count[:128] / n)
            out[k, 128 : 128 + CLASSES * CLASSES] = np.sqrt(np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES) / n)
            out[k, 128 + CLASSES * CLASSES :] = _shape(len(b), h[at[k - i] : at[k - i + 1]], int(count[10]))
    return out


def rounded(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Raw scores, of features as they are stored and without the last digits, which depend on the batch."""
    return np.round(x.astype(np.float32).astype(float) @ weights, 9)


class Ranking:
    """Weights of a Bradley-Terry model, and the raw score that is mapped to `cut`."""

    def __init__(self, weights: np.ndarray, at: float, scale: float, cut: float):
        self.weights, self.at, self.scale, self.cut = weights, at, scale, cut

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (rounded(x, self.weights) - self.at) * self.scale + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def games(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian (flat, one after the other) of all games of a block, which weigh 1 together. A
    game weighs the product of the times n that its rows are there."""
    a, b, na, nb = x[y == 1], x[y == 0], n[y == 1].astype(float), n[y == 0].astype(float)
    if not len(a) or not len(b):
        return np.zeros(1 + len(w) + len(w) ** 2)
    u = np.outer(na / na.sum(), nb / nb.sum())
    z = np.clip((a @ w)[:, None] - (b @ w)[None, :], -50, 50)
    p = 1 / (1 + np.exp(z))  # probability that the poorer one had won
    lost = u * p
    v = lost * (1 - p)
    cross = a.T @ (v @ b)
    hess = (a * v.sum(1)[:, None]).T @ a + (b * v.sum(0)[:, None]).T @ b - cross - cross.T
    return np.concatenate(([(u * np.logaddexp(0, -z)).sum()], a.T @ lost.sum(1) - b.T @ lost.sum(0), hess.ravel()))


def newton(sums: Callable[[np.ndarray], np.ndarray], width: int, weight: float, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights with the least loss; sums(w): what games() gives, over all blocks, which weigh `weight` together."""
    w, last = np.zeros(width), None
    for _ in range(rounds):
        got = sums(w) * weight
        loss, g, hess = got[0] + ridge * (w @ w) / 2, got[1 : 1 + width], got[1 + width :].reshape(width, width)
        if last is not None and loss > last[0] * (1 + 1e-9):  # the step went too far
            w = (w + last[1]) / 2
            continue
        step = np.linalg.solve(hess + ridge * np.eye(width), g - ridge * w)
        last = loss, w
        w = w + step
        if np.abs(step).max() < 1e-4:
            return w
    return last[1]


def fit(x: np.ndarray, y: np.ndarray, cut: float = 0.3) -> Ranking:
    """The plain counterpart of fit_blocks for rows in one block: all games, all cuts."""
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return Ranking(np.zeros(x.shape[1]), -1.0 if len(good) else 1.0, 1.0, cut)
    x = x.astype(np.float32).astype(float)
    w = newton(lambda w: games(x, y, np.ones(len(y)), w), x.shape[1], min(GAMES, 8 * len(y)))
    s = rounded(x, w)
    v = np.unique(s)
    # Errors if everything up to the k-th score is called poor, for each k; the quantile with the fewest.
    wrong = np.array([len(poor), *((s[good] <= c).sum() + (s[poor] > c).sum() for c in v)])
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    edges = np.concatenate(([v[0] - 1], v, [v[-1] + 1]))
    median = lambda rows: np.sort(s[rows])[(len(rows) - 1) // 2]
    return Ranking(w, (edges[k] + edges[k + 1]) / 2, 8 / max(1e-6, median(good) - median(poor)), cut)


def _matrix(column) -> np.ndarray:
    values, offsets = lists(column)
    return values[offsets[0] : offsets[-1]].reshape(-1, WIDTH)


def labelled(rows: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h, quality, n, x), stored, of all rows (doc_id, text) with a label; rows of one id and text are one that is there n
    times. Ids without a label are left out before features are taken, by a filter of the labels' ids; no text is shuffled."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = scratch.put(known.where("doc_id is not null"), "labels")
    bits = rows.sparkSession.sparkContext.broadcast(bits_of(known, log2_bits(known.count()), lambda i: mix(i, 7), ("doc_id",)))

    def vectors(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bits.value.has(mix(longs(batch.column(0)), 7))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), list_array(list(features(batch.column(1)).astype(np.float32)), pa.float32())], ["doc_id", "h", "x"])

    found = over_text(rows.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("h")), vectors, "doc_id long, h long, x array<float>")
    return scratch.put(found.join(known, "doc_id").groupBy("doc_id", "h", "quality").agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x")), "labelled")


def blocks_of(found: DataFrame, rows: dict[int, int], scratch: Scratch) -> DataFrame:
    """found with (block, nth), stored in files of whole blocks, one after the other. rows: of each label, above 0; nth: which of
    its blocks this is for the row, from 0."""
    common = int(rows[1] >= rows[0])
    blocks = -(-rows[common] // LARGER)
    several = min(blocks, -(-RARER * blocks // rows[1 - common]))
    nth = F.when(F.col("quality") == common, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(several - 1)))
    dealt = found.withColumn("nth", F.explode(nth)).withColumn("block", F.pmod(F.xxhash64("doc_id", "h", F.lit(21)) % blocks + F.col("nth") * (blocks // several), F.lit(blocks)))
    files = -(-(rows[common] + rows[1 - common] * several) // FILE_ROWS)
    return scratch.put(dealt.repartition(files, "block").sortWithinPartitions("block", "doc_id", "h", "quality"), "blocks")


def threshold(scores: DataFrame, scratch: Scratch) -> tuple[float, float]:
    """Of raw scores (s, distinct; good, poor: rows with it), both labels there: where calling all below poor errs least (the
    middle such place, the upper one of two), and how far the labels' medians are apart."""
    s, good, poor = F.col("s"), F.col("upto_good"), F.col("upto_poor")
    upto = scratch.put(cumulated(cumulated(scores, "good", s, name="upto_good"), "poor", s, name="upto_poor").select(s, good, poor), "upto")
    t = upto.agg(F.max(good).alias("good"), F.max(poor).alias("poor"), F.min(s).alias("low")).first()
    # Errors if everything up to a score is called poor.
    wrong = good + (F.lit(t["poor"]) - poor)
    m = upto.agg(F.min(wrong).alias("wrong"), F.min(F.when(good * 2 >= t["good"], s)).alias("good"), F.min(F.when(poor * 2 >= t["poor"], s)).alias("poor")).first()
    least = min(m["wrong"], t["poor"])
    best, below = upto.where(wrong == least), int(t["poor"] == least)  # below: nothing is poor
    places = best.count() + below
    if places // 2 < below:
        return t["low"] - 0.5, m["good"] - m["poor"]
    k = numbered(best, s).where(F.col("pos") == places // 2 - below + 1).first()["s"]
    above = upto.where(s > k).agg(F.min(s).alias("s")).first()["s"]
    return k + 0.5 if above is None else (k + above) / 2, m["good"] - m["poor"]


def fit_blocks(found: DataFrame, scratch: Scratch, cut: float = 0.3) -> Ranking:
    """The model of all rows (doc_id, h, quality, n, x). The driver holds sums by feature, never rows."""
    rows = {0: 0, 1: 0} | {r["quality"]: r["count"] for r in found.groupBy("quality").count().collect()}
    if not rows[0] or not rows[1]:
        return Ranking(np.zeros(WIDTH), -1.0 if rows[1] else 1.0, 1.0, cut)
    stored = blocks_of(found, rows, scratch)
    about = stored.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("nth") == 0, F.col("n"))).alias("rows")).first()

    def tops(batches):
        top = np.zeros(WIDTH)
        for batch in batches:
            top = np.maximum(top, np.abs(_matrix(batch.column(0))).max(0, initial=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH)), pa.array(top)], ["i", "top"])

    top = np.ones(WIDTH)
    for r in stored.select("x").mapInArrow(tops, "i long, top double").groupBy("i").agg(F.max("top").alias("top")).collect():
        top[r["i"]] = r["top"] or 1.0

    def sums(w: np.ndarray) -> np.ndarray:
        """Over features that lie in -1 to 1, so that the sums stay within 64 bits, and then as they are."""
        at, total = w * top, about["all"]

        def play(batches):
            out, block, held = np.zeros(1 + WIDTH + WIDTH**2, np.int64), None, []

            def over() -> None:
                if held:
                    y, k, x = (np.concatenate(c) for c in zip(*held))
                    np.add(out, np.rint(games(x / top, y, k, at) * (k.sum() / total * UNIT)).astype(np.int64), out=out)
                    held.clear()

            for batch in batches:
                b, y, k, x = longs(batch.column(0)), longs(batch.column(1)), longs(batch.column(2)), _matrix(batch.column(3))
                edges = [0, *(np.flatnonzero(np.diff(b)) + 1), len(b)]
                for i, j in zip(edges, edges[1:]):
                    if i < j:
                        if b[i] != block:
                            over()
                            block = b[i]
                        held.append((y[i:j], k[i:j], x[i:j].astype(float)))
            over()
            yield from partials({i // PIECE: out[i : i + PIECE] for i in range(0, len(out), PIECE)})

        size = 1 + WIDTH + WIDTH**2
        got = merged(stored.select("block", "quality", "n", "x").mapInArrow(play, PARTIALS), PIECE, np.int64)
        flat = np.concatenate([got.get(i, np.zeros(PIECE, np.int64)) for i in range(-(-size // PIECE))])[:size] / UNIT
        return flat * np.concatenate(([1.0], top, np.outer(top, top).ravel()))

    w = newton(sums, WIDTH, min(GAMES, 8 * about["rows"]))

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(rounded(_matrix(batch.column(2)), w)), batch.column(0), batch.column(1)], ["s", "quality", "n"])

    count = lambda q: F.sum(F.when(F.col("quality") == q, F.col("n")).otherwise(0))
    scores = stored.where("nth = 0").select("quality", "n", "x").mapInArrow(raw, "s double, quality int, n long").groupBy("s").agg(count(1).alias("good"), count(0).alias("poor"))
    at, spread = threshold(scores, scratch)
    return Ranking(w, at, 8 / max(1e-6, spread), cut)


def rank_quality(docs: DataFrame, labels: DataFrame, learn_from=None, cut: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs (doc_id, text, ...).

    labels (doc_id, quality 0 or 1); other values and null are not learned from, a doc_id labelled twice
    counts as 0 if any says so; learn_from limits the documents used to fit, which otherwise are all with a
    label. score lies in 0..1 and predicted is 1 where it is at least `cut`. Null texts are scored as empty
    ones. Without labels of both kinds everything gets the label there is, or 0. Rows that repeat stay; other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "quality")
    found = labelled(rows if learn_from is None else rows.where(learn_from), labels, scratch)
    model = docs.sparkSession.sparkContext.broadcast(fit_blocks(found, scratch, cut))
    scratch.drop("labels", "labelled", "blocks", "upto")

    def score(batches):
        m: Ranking = model.value
        for batch in batches:
            s = m.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= m.cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return over_text(rows, score, "doc_id long, score double, predicted int")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    found = rank_quality(docs, labels, learn_from=fold != 0)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")
