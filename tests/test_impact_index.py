"""Pruned BM25 search against the full join, and the bound that it prunes by."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import retrieval as Q
from larkspur.operators.impact_index import ImpactIndex, _cut


def words(rng, n, size):
    """Words of which the first are in most texts."""
    return " ".join(f"w{int(rng.paretovariate(0.7)) % n}" for _ in range(size))


def rows(df):
    return sorted((r["query"], r["rank"], r["doc"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10])
def test_pruned_rows_equal_all_rows(spark, k):
    rng = random.Random(k)
    docs = spark.createDataFrame([(i, words(rng, 400, rng.randint(1, 80))) for i in range(1500)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, words(rng, 400, rng.randint(1, 12))) for i in range(60)] + [(100, "nothing here"), (101, ""), (102, None), (103, "w0 w0 w1")], "query long, text string")
    postings = Q.bm25_index(docs)
    index = ImpactIndex(postings, block=64)
    assert rows(index.search(queries, k)) == rows(Q.sparse_topk(queries, postings, k))
    assert index.blocks.agg(F.max(F.size("docs"))).first()[0] <= 130  # no block holds a common term
    n = index.postings_read(queries, k).first()
    assert n["read_postings"] < 0.8 * n["all_postings"]


def test_pruned_within_groups(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, words(rng, 60, 20), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, lang string")
    queries = spark.createDataFrame([(i, words(rng, 60, 4), "ab"[i % 2]) for i in range(20)], "query long, text string, lang string")
    postings = Q.bm25_index(docs, by=("lang",))
    assert rows(ImpactIndex(postings, ("lang",)).search(queries, 5)) == rows(Q.sparse_topk(queries, postings, 5, ("lang",)))


def test_empty_index(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ImpactIndex(Q.bm25_index(docs)).search(spark.createDataFrame([(1, "a b")], "query long, text string"), 3).count() == 0


def test_cut_is_the_largest_level_below_the_least_score(spark):
    rng = random.Random(2)
    cases = [(sorted(rng.random() * 5 for _ in range(rng.randint(1, 8))), rng.random() * 20) for _ in range(200)] + [([1.0, 2.0], 0.0)]
    got = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(cases)], "i int, tops array<double>, least double").select("i", _cut(F.col("tops"), F.col("least")).alias("c")).collect()
    for r in got:
        tops, least = cases[r["i"]]
        value = lambda c: sum(min(t, c) for t in tops)
        if least <= 0:
            assert r["c"] == 0
        elif sum(tops) < least:
            assert r["c"] == float("inf")
        else:
            assert abs(value(r["c"]) - least) < 1e-9
