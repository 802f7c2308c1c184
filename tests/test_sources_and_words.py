"""Landed partitions, large dictionaries, evidence of entities with many bullets."""

import json
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from larkspur.functions import dictionary as D
from larkspur.functions import text as T
from larkspur.operators import retrieval as Q
from larkspur.sources import readers as I
from larkspur.streaming import jobs as S


def folder():
    return tempfile.mkdtemp(prefix="spark-larkspur-")


def land(base, day, lines, marker=True, array=False):
    path = f"{base}/raw/dt={day}"
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part.json", "w") as f:
        f.write("\n  " + json.dumps(lines, indent=1) if array else "\n".join(map(json.dumps, lines)) + "\n\n")
    if marker:
        open(f"{path}/_SUCCESS", "w").close()


SCHEMA = "event_id string, event_name string"


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_lines_are_split_and_arrays_are_read(spark):
    base = folder()
    land(base, "2026-01-01", [{"event_id": str(i), "event_name": "x" * 50} for i in range(20_000)])
    land(base, "2026-01-02", [{"event_id": str(i), "event_name": "[y]"} for i in range(5)], array=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = I.read_raw(spark, base, "raw", schema(spark))
        assert {r["dt"]: r["count"] for r in got.groupBy("dt").count().collect()} == {"2026-01-01": 20_000, "2026-01-02": 5}
        tasks = got.where("dt = '2026-01-01'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks >= 4  # a file of lines is several tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_marker_set_while_the_stream_runs_is_noticed(spark):
    base, check, seen = folder(), folder(), []
    land(base, "2026-01-01", [{"event_id": "1", "event_name": "a"}])
    land(base, "2026-01-02", [{"event_id": "2", "event_name": "b"}], marker=False)
    sink = lambda df, epoch: seen.append((epoch, sorted((r["event_id"], r["dt"]) for r in df.collect())))

    def run(until):
        q = S.poll_complete(spark, base, "raw", schema(spark), sink, check, processingTime="1 second")
        end = time.time() + 60
        try:
            while time.time() < end and len(seen) < until:
                time.sleep(0.3)
                if len(seen) == 1 and not os.path.exists(f"{base}/raw/dt=2026-01-02/_SUCCESS"):
                    open(f"{base}/raw/dt=2026-01-02/_SUCCESS", "w").close()
        finally:
            q.stop()

    run(2)
    land(base, "2026-01-03", [{"event_id": "3", "event_name": "c"}])
    run(3)  # started anew: the first two stay taken
    assert [rows for _, rows in seen] == [[("1", "2026-01-01")], [("2", "2026-01-02")], [("3", "2026-01-03")]]
    assert len({e for e, _ in seen}) == 3


@pytest.mark.parametrize("library", [True, False])
def test_many_words_equal_plain_search(library, monkeypatch):
    if not library:
        monkeypatch.setitem(__import__("sys").modules, "ahocorasick", None)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcä ") for _ in range(rng.randint(1, 6)))
    words, texts = [word() for _ in range(500)], [word() * rng.randint(0, 5) for _ in range(200)]
    found = D.matcher(words)
    for t in texts:
        assert {words[k] for k in found(t)} == {w for w in words if w in t}
    assert list(D.matcher(["", "a"])("b")) == [0] and list(D.matcher([])("b")) == []


def test_ten_thousand_keywords_in_spark(spark):
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7))) for _ in range(10_000)})
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.contains_any(F.col("t"), words).alias("any"), D.matches(F.col("t"), words).alias("which"))
    for r in df.collect():
        t = texts[r["i"]]
        want = None if t is None else sorted(k for k, w in enumerate(words) if w in t)
        assert r["which"] == want and r["any"] == (None if want is None else bool(want))


def test_evidence_of_an_entity_with_many_bullets(spark):
    """Ten thousand bullets of one entity, and random small ones against the plain rule."""
    rng = random.Random(3)
    small = [(e, rng.choice("ab"), b, rng.randint(0, 8), 0.5, None) for e in range(1, 30) for b in range(8) for _ in range(4)]
    rows, seen = [], {}
    for e, c, b, d, s, _ in small:
        if (e, c, b, d) not in seen:
            seen[e, c, b, d] = True
            rows.append((e, c, b, d, s, sum(1 for k in seen if k[:3] == (e, c, b))))
    kind = "entity long, category string, bullet long, doc long, score double, rank int"
    got = {(r["entity"], r["category"], r["bullet"]): (r["doc"], r["rank"]) for r in Q.map_evidence(spark.createDataFrame(rows, kind)).collect()}
    want, used = {}, set()
    for e, c, b, d, _, k in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[5], r[3])):
        if (e, c, b) not in want and (e, d) not in used:
            used.add((e, d))
            want[e, c, b] = (d, k)
    assert got == want
    many = spark.range(10_000 * 40).selectExpr("0L AS entity", "'a' AS category", "id div 40 AS bullet", "pmod(xxhash64(id), 20000L) AS doc", "0.9D AS score", "CAST(id % 40 + 1 AS INT) AS rank")
    out = Q.map_evidence(many)
    n = out.agg(F.count(F.lit(1)), F.count_distinct("bullet"), F.count_distinct("doc")).first()
    assert n[0] == n[1] == n[2] > 9900


def test_few_partitions_are_spread_and_many_are_left(spark, tmp_path):
    from larkspur.sources.readers import spread

    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).withColumn("text", F.col("id").cast("string")).withColumn("more", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    got = spread(one)
    assert got.rdd.getNumPartitions() == cores and sorted(r["id"] for r in got.collect()) == list(range(1000))
    plan = got.where("id > 500").select("text")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,text:string>" in plan and "GreaterThan(id,500)" in plan
    many = one.repartition(cores + 1)
    many.write.parquet(f"{tmp_path}/many")
    back = spark.read.option("maxPartitionBytes", 1).parquet(*[str(p) for p in sorted((tmp_path / "many").glob("*.parquet"))])
    assert spread(many) is many
    assert spread(spark.range(0)).count() == 0 and spread(back).count() == 1000
