"""BM25 top-k of a stated set of queries over all documents, scored where the documents lie.

The queries' terms are known beforehand, so a document is taken apart once and kept as what it has of them
(a small table). Counts of documents and lengths are summed over all documents; then each task scores
its documents against all queries, in blocks, and gives its k best of each query. No posting and no pair of query
and document is shuffled. A block whose heaviest weights together cannot reach a query's k-th score
so far is not scored for it; nothing is lost by that. The rows are those of
`retrieval.sparse_topk` over `retrieval.bm25_index`.

Weights are rounded to nine digits and summed as whole numbers, so the order of the sums changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import Scratch, shipped

#: Terms of all queries together that the driver and each worker hold; larger sets go by joins.
MOST_TERMS = 2_000_000
#: Scores (queries times documents) of a block, and pairs of a posting and a query, at once.
CELLS, PAIRS = 1 << 21, 1 << 21
NANO = 1_000_000_000


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to whole numbers, halves away from zero."""
    whole = np.trunc(x)
    return whole + np.where(np.abs(x - whole) >= 0.5, np.copysign(1.0, x), 0.0)


def scan_topk(queries: DataFrame, docs: DataFrame, k: int, by: tuple[str, ...] = (), text: str = "text", doc: str = "doc_id", k1: float = 1.2, b: float = 0.75, block: int = 1024) -> DataFrame:
    """(*by, query, doc, score, rank) of queries (query, *by, text) among docs (doc, *by, text); ties by doc. `by` restricts
    a query to the docs with equal values, not the counts that weights come from. block: documents scored at once, at most."""
    from .retrieval import _ranked, bm25_index, sparse_topk

    spark = docs.sparkSession
    shipped(spark)
    scratch = Scratch(spark, "scan")
    wanted = queries.select("query", *by, F.explode(F.array_distinct(T.tokens(F.lower(F.col("text"))))).alias("term"))
    wanted = scratch.put(wanted.groupBy("query", *by, "term").agg(F.count(F.lit(1)).alias("times")), "terms")
    if wanted.count() > MOST_TERMS:
        return sparse_topk(queries, bm25_index(docs, text, doc, k1, b, by), k, by)
    asked = wanted.toArrow().combine_chunks()
    terms = pc.unique(asked.column("term"))
    held_terms, n_terms = spark.sparkContext.broadcast(terms), max(1, len(terms))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("_w")
            sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(words.flatten(), value_set=held_terms.value), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), sizes)
            key, tf = np.unique(row[at >= 0] * n_terms + at[at >= 0], return_counts=True)
            row, t = key // n_terms, key % n_terms
            ends = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (t, tf, sizes[row])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "doc")), pa.array(sizes, pa.int64()), *lists], [*by, "doc", "len", "t", "tf", "l"])

    rows = docs.select(*by, F.col(doc).alias("doc"), T.tokens(F.lower(F.col(text))).alias("_w"))
    kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    lists = "t array<int>, tf array<int>, l array<int>"
    kept = scratch.put(rows.mapInArrow(packed, ", ".join([*(kind(rows, c) for c in (*by, "doc")), "len bigint", lists])), "kept")
    about = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), F.sum("len").alias("words")).first()
    kept = _one_row_each(kept, by, scratch)
    n = F.lit(about["n"])
    df = kept.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = df.select("t", idf.alias("idf")).toArrow()
    weights = np.zeros(n_terms)
    weights[found.column("t").to_numpy()] = found.column("idf").to_numpy()

    # Queries by number; a list of (query, times) for each group of `by` values and term.
    names = asked.select(["query", *by]).group_by(["query", *by]).aggregate([]).combine_chunks()
    number = {tuple(r.values()): i for i, r in enumerate(names.select(["query", *by]).to_pylist())}
    of = np.array([number[tuple(r.values())] for r in asked.select(["query", *by]).to_pylist()], np.int64)
    groups: dict[tuple, int] = {}
    own = [tuple(r.values()) for r in names.select(list(by)).to_pylist()] if by else [()] * len(names)
    own = np.array([-1 if None in g else groups.setdefault(g, len(groups)) for g in own], np.int64)  # null equals nothing
    term = pc.index_in(asked.column("term"), value_set=terms).to_numpy()
    use = own[of] >= 0 if len(of) else np.zeros(0, bool)
    slot, of, times = (own[of] * n_terms + term)[use], of[use], asked.column("times").to_numpy()[use]
    order = np.argsort(slot, kind="stable")
    plan = spark.sparkContext.broadcast({"slots": slot[order], "query": of[order], "times": times[order], "groups": groups, "idf": weights, "avg": about["avg"], "names": names})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        top = _Best(p, n_terms, k, block)
        for batch in batches:
            if not len(batch):
                continue
            at = np.array([p["groups"].get(g, -1) for g in zip(*(batch.column(c).to_pylist() for c in by))], np.int64) if by else np.zeros(len(batch), np.int64)
            t, tf, length = (batch.column(c) for c in ("t", "tf", "l"))
            sizes = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
            tf, length = (x.flatten().to_numpy(zero_copy_only=False) for x in (tf, length))
            t = t.flatten().to_numpy(zero_copy_only=False)
            w = p["idf"][t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / p["avg"])) if len(t) else np.zeros(0)
            top.add(batch.column("doc"), at, sizes, t, half_up(w * NANO))
        yield from top.rows(by)

    schema = ", ".join([*(kind(queries, c) for c in by), kind(queries, "query"), "`doc` " + rows.schema["doc"].dataType.simpleString(), "score double"])
    return _ranked(kept.mapInArrow(best, schema), k, (*by, "query"))


def _one_row_each(kept: DataFrame, by: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """kept with one row for each document. Ids are counted alone; where none repeats, kept as it is. Rows of a
    repeated id become one, and those of one length count as one text."""
    keys = [*by, "doc"]
    again = scratch.put(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "again")
    if again.isEmpty():
        return kept
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"a.{c}"))
    alone = kept.alias("k").join(again.alias("a"), same, "left_anti")
    parts = kept.alias("k").join(again.alias("a"), same, "left_semi").select(*keys, "len", F.explode(F.arrays_zip("t", "tf")).alias("x"))
    parts = parts.groupBy(*keys, "len", F.col("x.t").alias("t")).agg(F.sum("x.tf").cast("int").alias("tf"))
    parts = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "tf", F.col("len").cast("int").alias("l")))).alias("x"))
    made = parts.select(*keys, F.lit(0).cast("long").alias("len"), "x.t", "x.tf", "x.l")
    return scratch.put(alone.unionByName(made), "one")


class _Best:
    """The k best documents of each query among those seen."""

    def __init__(self, plan: dict, n_terms: int, k: int, block: int):
        self.plan, self.n_terms, self.k = plan, n_terms, k
        self.n = len(plan["names"])
        self.block = max(1, min(block, CELLS // max(1, self.n)))
        self.query, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        self.least = np.full(self.n, -1, np.int64)  # k-th score so far, in millionths

    def add(self, docs: pa.Array, group: np.ndarray, sizes: np.ndarray, t: np.ndarray, w: np.ndarray) -> None:
        """Documents with their groups (-1: of no query) and numbers of postings; the postings' terms and weights."""
        self.doc = docs.slice(0, 0) if self.doc is None else self.doc
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for low in range(0, len(docs), self.block):
            high = min(len(docs), low + self.block)
            part = slice(ends[low], ends[high])
            row = np.repeat(np.arange(high - low), sizes[low:high])
            own = group[low:high][row]
            slot, weight = own * self.n_terms + t[part], w[part]
            slot, row, weight = slot[own >= 0], row[own >= 0], weight[own >= 0]
            if len(slot):
                self._score(docs.slice(low, high - low), slot, row, weight)

    def _score(self, docs: pa.Array, slot: np.ndarray, row: np.ndarray, weight: np.ndarray) -> None:
        p, d = self.plan, len(docs)
        order = np.argsort(slot, kind="stable")
        slot, row, weight = slot[order], row[order], weight[order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        heaviest = np.maximum.reduceat(weight, first)
        # Lists of queries of the slots that the block has.
        low, high = (np.searchsorted(p["slots"], slot[first], side) for side in ("left", "right"))
        at, each = _ranges(low, high - low)
        bound = np.bincount(p["query"][at], heaviest[each] * p["times"][at], self.n)
        able = half_up(bound / NANO * 1e6) >= self.least
        keep = able[p["query"][at]]
        at, each = at[keep], each[keep]
        if not len(at):
            return
        sizes = np.diff(np.concatenate((first, [len(slot)])))
        total, seen = np.zeros(self.n * d), np.zeros(self.n * d, bool)
        ends = np.cumsum(sizes[each])
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            post, of = _ranges(first[each[begin:end]], sizes[each[begin:end]])
            cell = p["query"][at[begin:end]][of] * d + row[post]
            total += np.bincount(cell, weight[post] * p["times"][at[begin:end]][of], self.n * d)
            seen[cell] = True
            begin = end
        cell = np.flatnonzero(seen)
        query, score = cell // d, half_up(total[cell] / NANO * 1e6).astype(np.int64)
        good = score >= self.least[query]
        query, score, cell = query[good], score[good], cell[good]
        query, score = np.concatenate((self.query, query)), np.concatenate((self.score, score))
        doc = pa.concat_arrays([self.doc, docs.take(pa.array(cell % d))])
        order = pc.sort_indices(pa.table({"q": query, "s": score, "d": doc}), [("q", "ascending"), ("s", "descending"), ("d", "ascending")], null_placement="at_start").to_numpy()
        query = query[order]
        begin = np.searchsorted(query, np.arange(self.n))
        order = order[np.arange(len(query)) - begin[query] < self.k]
        self.score, self.doc = score[order], doc.take(pa.array(order))
        self.query = query[np.arange(len(query)) - begin[query] < self.k]
        begin = np.searchsorted(self.query, np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(begin) == self.k)
        self.least[full] = self.score[begin[full + 1] - 1]

    def rows(self, by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        if self.doc is None:
            return
        names = self.plan["names"].take(pa.array(self.query)).combine_chunks()
        flat = lambda c: pa.concat_arrays(names.column(c).chunks) if names.column(c).num_chunks else pa.array([], names.schema.field(c).type)
        yield pa.RecordBatch.from_arrays([*(flat(c) for c in by), flat("query"), self.doc, pa.array(self.score / 1e6)], [*by, "query", "doc", "score"])


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the range of each."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size), of
