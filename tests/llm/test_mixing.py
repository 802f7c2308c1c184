"""Mixing: every source near its target, each document as often as its source's rate says on average."""

from statistics import median

from pyspark.sql import functions as F

from larkspur.llm import mixing

REPLICAS = 200


def _replicas(spark, **kinds):
    """REPLICAS sources of each kind, a list of document sizes."""
    rows = [(int(i * REPLICAS + r), f"{kind}{r:03d}", k, n) for j, (kind, sizes) in enumerate(kinds.items()) for r in range(REPLICAS) for k, n in enumerate(sizes) for i in [j * 1000 + k]]
    return spark.createDataFrame(rows, "doc_id long, source string, slot int, words int").withColumn("text", F.expr("repeat('w ', words)"))


def _mixed(spark, **kinds):
    docs = _replicas(spark, **kinds)
    return mixing.mix(docs, weights=(1,)).join(docs.select("doc_id", "slot", "words"), "doc_id").toPandas()


def test_sources_with_long_documents_meet_their_targets(spark):
    """One document of 40 % of its source, several of 15 %, and very uneven ones."""
    kinds = {"a": [400] + [20] * 30, "b": [150] * 5 + [25] * 50, "c": [2 ** (k % 10) for k in range(100)]}
    got = _mixed(spark, **kinds)
    assert (got["size"] == got["words"]).all() and (got["taken"] == got["copies"] * got["size"]).all() and (got["taken"] <= 3 * got["size"]).all()
    for name, rows in got.groupby("source"):
        target = rows["target"].iloc[0]
        assert abs(rows["taken"].sum() - target) <= max(0.01 * target, median(kinds[name[0]])), name


def test_expectations_stay(spark):
    """The mean number of copies of each place over all replicas is its source's rate; also where one
    document has 80 % of a source, so that no mix of the others can make up for it."""
    kinds = {"a": [400] + [20] * 30, "d": [800] + [10] * 20, "e": [7, 300, 5, 90, 90, 1], "f": [50] * 60, "g": [3]}
    got = _mixed(spark, **kinds)
    got["kind"] = got["source"].str[0]
    for (kind, slot), rows in got.groupby(["kind", "slot"]):
        rate = rows["target"].iloc[0] / rows["source_size"].iloc[0]
        p = rate % 1
        assert abs(rows["copies"].mean() - rate) <= 4.5 * (p * (1 - p) / REPLICAS) ** 0.5 + 1e-9, (kind, slot)
        assert set(rows["copies"]) <= {int(rate), int(rate) + (p > 0)}
    equal = got[got["kind"] == "f"]
    assert (abs(equal.groupby("source")["taken"].sum() - equal["target"].iloc[0]) <= 50).all()


def test_ties_of_size_and_large_sources(spark):
    """A source of many groups with a few documents a hundred times as long as the others."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', if(id % 2000 = 0, 1000, 10)) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    out = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 10 for r in out)
