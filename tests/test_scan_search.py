"""Search by scanning the documents against the join of postings, on odd rows."""

import random

import pytest

from larkspur.operators import retrieval as Q
from larkspur.operators import scan_search as S
from larkspur.plans import retrieval as plans

from .conftest import SF

DOCS, QUERIES = "doc_id long, text string, lang string", "query long, text string, lang string"


def words(rng, n, size):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % n}" for _ in range(size))


def rows(df):
    return sorted((r["query"], r["rank"], r["doc"], round(r["score"], 5)) for r in df.collect())


def tables(spark, seed, repeated):
    rng = random.Random(seed)
    docs = [(i, words(rng, 300, rng.randint(0, 60)), rng.choice(["a", "b", None, "z"])) for i in range(900)]
    docs += [(1000 + i, "w1 w2 w3 copy", "a") for i in range(40)] + [(2000, None, "a"), (2001, "", "b")]
    if repeated:  # the same id with an equal length, another length, another language
        docs += [(i, words(rng, 300, 20), "a") for i in (1, 1, 2, 3)] + [(5, t, "b") for t in ("w1 w2 w3", "w1 w5 w9", "w7")]
    queries = [(i, words(rng, 300, rng.randint(1, 12)), rng.choice(["a", "b", "none", None])) for i in range(50)]
    queries += [(100, "nothing here", "a"), (101, "", "a"), (102, None, "b"), (7, "w1 w2 w900", "a"), (103, "W1 w1 COPY", "a")]
    return spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(queries, QUERIES)


@pytest.mark.parametrize("by", [(), ("lang",)])
@pytest.mark.parametrize("repeated", [False, True])
def test_scan_equals_join(spark, by, repeated):
    docs, queries = tables(spark, 3, repeated)
    want = rows(Q.sparse_topk(queries, Q.bm25_index(docs, by=by), 10, by))
    assert want and rows(S.scan_topk(queries, docs, 10, by)) == want
    assert rows(S.scan_topk(queries, docs, 10, by, block=3)) == want


def test_small_blocks_and_many_terms(spark, monkeypatch):
    docs, queries = tables(spark, 4, True)
    want = rows(S.scan_topk(queries, docs, 5))
    monkeypatch.setattr(S, "MOST_TERMS", 3)
    assert rows(S.scan_topk(queries, docs, 5)) == want
    assert S.scan_topk(queries, docs.where("false"), 5).count() == 0 and S.scan_topk(queries.where("false"), docs, 5).count() == 0


@pytest.mark.parametrize("name", ["sparse", "pruned"])
def test_no_posting_is_shuffled(spark, name):
    """What goes over exchanges is the best of each task; before, postings were joined and paired with queries."""
    df = getattr(plans, name)(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashAggregate" not in plan and plan.count("Exchange") == 1


def test_halves_go_up():
    import numpy as np

    assert S.half_up(np.array([0.5, 1.5, 2.5, -0.5, 0.49999999999999994, 7.0])).tolist() == [1, 2, 3, -1, 0, 7]


@pytest.mark.parametrize("name", ["hybrid", "filtered_hybrid", "cascade", "evidence", "keyword_hits"])
def test_no_index_of_all_postings(spark, monkeypatch, name):
    """These queries know their terms; before, each stored and shuffled the postings of all terms."""
    monkeypatch.setattr(Q, "bm25_index", None)
    assert getattr(plans, name)(spark, SF).count() > 0


def test_texts_are_not_shuffled_to_the_hits(spark):
    plan = plans.keyword_hits(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
