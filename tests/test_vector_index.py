"""The stored index against the exact grid: what `exact` returns, recall of `search`, additions, awkward rows."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import retrieval as Q
from larkspur.operators import vector_index as V

ROWS = "doc long, kind string, vector array<double>"


def vectors(spark, n, width=16, groups=0, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    if groups:
        x = 3 * rng.standard_normal((groups, width))[rng.integers(0, groups, n)] + x
    return spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], ROWS)


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-larkspur-")


def rows(df):
    return sorted((r["query"], r["rank"], r["doc"], r["score"]) for r in df.collect())


def queries(v, every=7):
    return v.where(F.col("doc") % every == 0).withColumnRenamed("doc", "query")


@pytest.mark.parametrize("groups", [0, 40])
def test_exact_equals_grid(spark, groups):
    v = vectors(spark, 3000, groups=groups)
    index = V.VectorIndex.build(v.drop("kind"), folder(), per_cell=50)
    assert index.vectors().count() == 3000 and len(index.cell) > 20
    q = queries(v).drop("kind")
    assert rows(index.exact(q, 5, first=2)) == rows(Q.dense_topk(q, v.drop("kind"), 5))
    assert rows(index.exact(q, 5, min_score=0.5, block=16)) == rows(Q.dense_topk(q, v.drop("kind"), 5, 0.5))
    assert rows(index.exact(q, 5, others_only=True)) == rows(Q.dense_topk(q, v.drop("kind"), 5, others_only=True))


def test_filtered_search_equals_filtered_grid(spark):
    v = vectors(spark, 1500, groups=10)
    index = V.VectorIndex.build(v, folder(), by=("kind",), per_cell=64)
    assert rows(index.exact(queries(v), 4)) == rows(Q.dense_topk(queries(v), v, 4, by=("kind",)))


def test_few_probes_find_most_in_grouped_vectors_and_are_calibrated(spark):
    v = vectors(spark, 6000, groups=60).drop("kind")
    index = V.VectorIndex.build(v, folder(), per_cell=100)
    q, true = queries(v), Q.dense_topk(queries(v), v, 10)
    n = index.calibrated(10, 0.95, 300)
    assert n * 4 <= len(index.cell)
    assert V.recall_at(index.search(q, 10, n), true) >= 0.9
    assert V.recall_at(index.search(q, 10, len(index.cell)), true) == 1.0


def test_added_vectors_are_found(spark):
    v = vectors(spark, 2000).drop("kind")
    index = V.VectorIndex.build(v.where("doc < 500"), folder(), per_cell=32)
    index.add(v.where("doc >= 500"))
    again = V.VectorIndex(spark, index.path)
    assert again.cells().agg(F.sum("n")).first()[0] == 2000
    assert rows(again.exact(queries(v), 5)) == rows(Q.dense_topk(queries(v), v, 5))


def test_awkward_vectors_and_empty_tables(spark):
    odd = [(0, "a", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (2, "a", None), (3, "b", [0.0, 0.0]), (4, "b", [float("nan"), 1.0]), (5, None, [0.5, 0.5]), (6, "a", [1.0]), (7, "a", [-1.0, 0.1]), (8, "b", [float("inf"), 0.0]), (0, "a", [1.0, 0.0])]
    v = spark.createDataFrame(odd, ROWS)
    index = V.VectorIndex.build(v.drop("kind"), folder())
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (None, [1.0, 0.0])], "query long, vector array<double>")
    assert [(r[0], r[2]) for r in rows(index.exact(q, 3))] == [(1, 0), (1, 0), (1, 1)]
    empty = V.VectorIndex.build(v.drop("kind").limit(0), folder())
    assert empty.cell.size == 0


def test_grid_by_entity_with_one_large_entity(spark):
    """Blocks are counted for each entity: a hot one has several, the others one."""
    v = vectors(spark, 900).withColumn("entity", F.when(F.col("doc") < 700, 0).otherwise(F.col("doc") % 50)).drop("kind")
    q = queries(v, 3)
    got = Q.dense_topk(q, v, 3, by=("entity",), doc_block=64)
    x = {r["doc"]: (r["entity"], np.array(r["vector"])) for r in v.collect()}
    for r in q.collect()[::17]:
        y = np.array(r["vector"])
        cos = sorted(((-round(float(y @ z / np.linalg.norm(y) / np.linalg.norm(z)), 9), d) for d, (e, z) in x.items() if e == r["entity"]))[:3]
        assert [d for _, d in cos] == [t["doc"] for t in sorted(got.where(F.col("query") == r["query"]).collect(), key=lambda t: t["rank"])]
