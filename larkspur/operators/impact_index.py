"""BM25 top-k from postings in blocks of similar weight, each with an upper bound of it.

A term's postings are cut into levels by weight, and a level into blocks of bounded length, by hash of the
document: no task orders or holds all postings of a common term. A search reads the heaviest levels of each
of the query's terms first, which gives k documents a score that the k-th best result has at least
(`least`). A document whose weights all lie below `cut` cannot reach it, where `cut` is the largest number for which the
sum of min(heaviest weight of the term, cut) over the query's terms stays below `least`; so only blocks that
reach the cut are read, and of terms that lie below it altogether none. The documents found there that
can still reach `least` get their whole scores from the postings by document and term. Nothing is lost:
the rows are those of `retrieval.sparse_topk`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import Scratch
from .retrieval import _ranked

#: Levels that a term's weights are cut into; a posting's level is 0 for the heaviest.
LEVELS = 16
#: Scores are rounded to six digits; bounds are compared with this margin.
MARGIN = 1e-5


class ImpactIndex:
    """Stored tables: `postings` (*by, term, doc, weight), `blocks` (*by, term, level, docs: array of (doc, weight)) and
    `levels` (*by, term, level, heaviest, n), a row for each term and level."""

    def __init__(self, postings: DataFrame, by: tuple[str, ...] = (), block: int = 1024):
        self.by, self.scratch = by, Scratch(postings.sparkSession, "impact")
        self.term = [*by, "term"]
        p = self.postings = self.scratch.put(postings.select(*self.term, "doc", "weight"), "postings")
        top = p.groupBy(*self.term).agg(F.max("weight").alias("_top"))
        # A level holds weights of one part of the way from the heaviest to zero.
        level = F.least(F.lit(LEVELS - 1), F.floor((1 - F.greatest("weight", F.lit(0.0)) / F.greatest("_top", F.lit(1e-300))) * LEVELS)).cast("int")
        placed = self.scratch.put(p.join(top, self.term).withColumn("level", level).drop("_top"), "placed")
        self.levels = self.scratch.put(placed.groupBy(*self.term, "level").agg(F.max("weight").alias("heaviest"), F.count(F.lit(1)).alias("n")), "levels")
        parts = self.levels.select(*self.term, "level", F.ceil(F.col("n") / block).alias("_parts"))
        dealt = placed.join(parts, [*self.term, "level"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("_parts")))
        blocks = dealt.groupBy(*self.term, "level", "part").agg(F.collect_list(F.struct("doc", "weight")).alias("docs"))
        self.blocks = self.scratch.put(blocks, "blocks")
        self.scratch.drop("placed")

    # ------------------------------------------------------------ searching

    def _hits(self, chosen: DataFrame) -> DataFrame:
        """(query, *by, term, doc, weight) of the blocks of chosen (query, *by, term, level, ...)."""
        keys = [*self.term, "level"]
        return chosen.join(self.blocks, keys).select("query", *self.term, F.explode("docs").alias("d")).select("query", *self.term, "d.doc", "d.weight")

    def _first(self, terms: DataFrame, k: int) -> DataFrame:
        """Of each query and term the heaviest levels that have k documents together."""
        w = Window.partitionBy("query", *self.term).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
        return terms.join(self.levels, self.term).withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("_before") < k).drop("_before")

    def _plan(self, terms: DataFrame, k: int, scratch: Scratch) -> DataFrame:
        """(query, *by, term, top, least, cut): the heaviest weight of each of the query's terms, and the bounds."""
        q = ["query", *self.by]
        seen = self._hits(self._first(terms, k)).groupBy(*q, "doc").agg(F.sum("weight").alias("score"))
        least = _ranked(seen, k, tuple(q)).where(F.col("rank") == k).select(*q, F.col("score").alias("least"))
        tops = terms.join(self.levels.groupBy(*self.term).agg(F.max("heaviest").alias("top")), self.term)
        bound = tops.groupBy(*q).agg(F.sort_array(F.collect_list("top")).alias("tops")).join(least, q, "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - MARGIN)
        bound = scratch.put(bound.select(*q, "least", _cut(F.col("tops"), F.col("least")).alias("cut")), "bounds")
        return tops.join(bound, q)

    def _reading(self, plan: DataFrame) -> DataFrame:
        return plan.join(self.levels, self.term).where(F.col("heaviest") >= F.col("cut"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(*by, query, doc, score, rank) of queries (query, *by, text), as `sparse_topk` has them."""
        scratch, q = Scratch(queries.sparkSession, "impact"), ["query", *self.by]
        terms = self._terms(queries, scratch)
        plan = scratch.put(self._plan(terms, k, scratch), "plan")
        below = F.least("top", "cut")
        total = plan.groupBy(*q).agg(F.sum(below).alias("_all"), F.first("least").alias("least"))
        found = self._hits(self._reading(plan)).join(plan.select(*q, "term", below.alias("_below")), [*q, "term"])
        found = found.groupBy(*q, "doc").agg(F.sum("weight").alias("_has"), F.sum("_below").alias("_seen"))
        # Unseen terms of the document weigh less than the cut, and no more than the term's heaviest.
        able = found.join(total, q).where(F.col("_has") + F.col("_all") - F.col("_seen") >= F.col("least")).select(*q, "doc")
        whole = able.join(terms, q).join(self.postings, [*self.term, "doc"])
        return _ranked(whole.groupBy(*q, "doc").agg(F.round(F.sum("weight"), 6).alias("score")).select(*self.by, "query", "doc", "score"), k, tuple(q))

    def _terms(self, queries: DataFrame, scratch: Scratch) -> DataFrame:
        return scratch.put(queries.select("query", *self.by, F.explode(F.array_distinct(T.tokens(F.lower(F.col("text"))))).alias("term")), "terms")

    def postings_read(self, queries: DataFrame, k: int) -> DataFrame:
        """One row (all_postings, read_postings): what `sparse_topk` joins the queries' terms with, and what the search
        reads, both of its passes together."""
        scratch = Scratch(queries.sparkSession, "impact")
        terms = self._terms(queries, scratch)
        plan = scratch.put(self._plan(terms, k, scratch), "plan")
        every = terms.join(self.levels, self.term).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_postings"))
        read = self._first(terms, k).select("n").unionByName(self._reading(plan).select("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("read_postings"))
        return every.crossJoin(read)  # one row each


def _cut(tops: Column, least: Column) -> Column:
    """The largest c for which the sum of min(top, c) over the tops, in ascending order, is at most `least`: all tops if
    their sum is, 0 where least is not positive."""
    n = F.size(tops)
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("c"))

    def step(s, top):
        level = (least - s["sum"]) / (n - s["i"])  # the tops so far are below c, the others at c
        return F.struct((s["sum"] + top).alias("sum"), (s["i"] + 1).alias("i"), F.when(s["c"].isNotNull(), s["c"]).when(level <= top, level).alias("c"))

    c = F.aggregate(tops, state, step, lambda s: F.coalesce(s["c"], F.lit(float("inf"))))
    return F.when(least <= 0, F.lit(0.0)).otherwise(c)
