"""Draws in one pass by user against draws by joins."""

import random

import pytest

from larkspur.operators import draws as D
from larkspur.operators import sampling as S

ROWS = "grp long, user long, item long, label int"


def table(spark, seed):
    """Users with few and many groups, one who holds nearly all, null users, repeated rows."""
    rng, rows = random.Random(seed), []
    for g in range(400):
        u = rng.choice([1, 1, 1, 2, 3, 4, 5, None, *range(10, 40)])
        rows += [(g, u, rng.randrange(120), rng.randint(0, 1)) for _ in range(rng.randint(1, 6))]
    rows += [(1000 + i % 7, 99, i, 1) for i in range(112)] + rows[:30]
    return spark.createDataFrame(rows, ROWS).repartition(4)


def rows(df):
    return sorted((r["grp"], r["user"] is None, r["user"] or 0, int(r["item"]), r["label"]) for r in df.collect())


@pytest.mark.parametrize("asks,at_once", [(20_000, 8192), (9, 5)])
def test_lists_equal_those_by_joins(spark, monkeypatch, asks, at_once):
    df = table(spark, 1)
    with monkeypatch.context() as m:
        m.setattr(D, "MOST_ITEMS", 0)
        want = rows(S.build_eval_lists(df, 12, 5, 60))
    monkeypatch.setattr(D, "ASKS", asks)
    monkeypatch.setattr(D, "AT_ONCE", at_once)
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if asks > 9 else 3)  # a user in many batches
    try:
        assert want and rows(S.build_eval_lists(df, 12, 5, 60)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    ids = df.withColumn("item", df["item"].cast("string"))  # texts, in another order, so other lists
    assert len(rows(S.build_eval_lists(ids, 12, 5, 60))) == len(want)


def test_draws_are_not_shuffled(spark, monkeypatch):
    """Where enough comes of the draws, none becomes a row; before, all of them were joined and grouped."""
    monkeypatch.setattr(S, "nth_place", None)
    df = spark.createDataFrame([(g, g % 9, (g * 7 + i) % 500, i % 2) for g in range(60) for i in range(4)], ROWS)
    lists = S.build_eval_lists(df, 20, 10, 400)
    assert lists.groupBy("grp").count().where("count = 21").count() == 60


@pytest.mark.parametrize("asks,at_once,sent", [(20_000, 8192, 200_000), (9, 5, 0)])
def test_negatives_equal_those_by_joins(spark, monkeypatch, asks, at_once, sent):
    """Also of rows that repeat, and of a user who holds nearly all."""
    from pyspark.sql import functions as F

    df = table(spark, 2).selectExpr("grp", "user", "item", "label", "IF(item % 5 = 0, NULL, concat('c', item % 7)) AS category", "item % 3 AS tier", "'CLICK' AS signal", "1.0D AS weight")
    df = df.unionByName(df.where("grp < 20"))
    got = lambda: sorted((r["grp"], str(r["user"]), r["item"], str(r["category"]), r["tier"], r["signal"], r["label"], r["weight"]) for r in S.add_negatives(df, 2, key=("grp",)).collect())
    with monkeypatch.context() as m:
        m.setattr(D, "MOST_ITEMS", 0)
        want = got()
    monkeypatch.setattr(D, "ASKS", asks)
    monkeypatch.setattr(D, "AT_ONCE", at_once)
    monkeypatch.setattr(S, "SENT_KINDS", sent)
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if asks > 9 else 3)
    try:
        assert len(want) > df.count() * 1.5 and got() == want
        monkeypatch.setattr(S, "nth_place", None)  # no draw is a row; before, all were joined
        assert S.add_negatives(df.where(F.col("user") != 99), 2, key=("grp",)).count() > 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
