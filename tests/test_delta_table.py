"""The table of changes against the plain rules of `upsert`, over random histories."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from larkspur.operators import upsert as U
from larkspur.operators.delta_table import Conflict, DeltaTable


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-larkspur-") + "/t"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def base(spark, n=300):
    return spark.range(n).selectExpr("id", "concat('s', id) AS status", "id % 4 + 1 AS version")


def test_random_histories_equal_plain_rules(spark):
    rng = random.Random(3)
    plain = base(spark)
    t = DeltaTable.create(plain, folder(), "id", "version", 16)
    for step in range(7):
        ids = rng.sample(range(400), 30)
        kind = rng.choice(["upsert", "upsert", "delete", "write_back", "compact"]) if step else "upsert"
        if kind == "upsert":
            changes = spark.createDataFrame([(i, f"u{step}", rng.choice([None, 1, 2, 3])) for i in ids + ids[:3]] + [(None, "x", None)], "id long, status string, expected long")
            kept, report = U.upsert(plain, changes.where("id IS NOT NULL"), "id")
            assert rows(t.upsert(changes)) == rows(report)
        elif kind == "delete":
            some = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long")
            kept, report = U.delete(plain, some.where("id IS NOT NULL"), "id")
            assert rows(t.delete(some)) == rows(report)
        elif kind == "write_back":
            new = spark.createDataFrame([(i, rng.choice([None, f"w{step}"])) for i in ids], "id long, status string")
            kept = U.write_back(plain, new, "id", "status").select("id", "status", "version")
            t.write_back(new, "status")
        else:
            t.compact()
            assert t.vacuum() or True
            kept = plain
        plain = spark.createDataFrame(kept.select("id", "status", "version").collect(), "id long, status string, version long")
        assert rows(t.read()) == rows(plain), (step, kind)
    assert rows(DeltaTable(spark, t.path).read()) == rows(plain)


def test_a_change_touches_its_buckets_alone(spark):
    t = DeltaTable.create(base(spark, 5000), folder(), "id", "version", 100)
    one = base(spark, 5000).withColumn("b", t._bucket()).where("b = 7").selectExpr("id", "'new' AS status", "CAST(NULL AS LONG) AS expected")
    report = t.upsert(one)
    assert t.log()[-1]["buckets"] == [7] and report.count() == one.count()
    read = t.read({7}).inputFiles()
    assert read and all("_bucket=7/" in f for f in read)
    untouched = {f for f in t.read().inputFiles() if "base-" in f}
    assert t.compact() == [7] and len(t.vacuum()) == 2
    assert untouched - set(t.read().inputFiles()) == {f for f in untouched if "_bucket=7/" in f}


def test_two_writers_and_an_emptied_bucket(spark):
    t = DeltaTable.create(base(spark, 40), folder(), "id", "version", 4)
    other = DeltaTable(spark, t.path)
    seen = other.log()
    t.delete(base(spark, 10))
    with pytest.raises(Conflict):
        other._commit(seen, "change", "x", [0])
    gone = base(spark, 40).withColumn("b", t._bucket()).where("b = 1")
    t.delete(gone)
    t.compact()
    t.vacuum()
    assert rows(t.read()) == rows(base(spark, 40).where("id >= 10").join(gone.select("id"), "id", "left_anti"))
    assert t.upsert(spark.createDataFrame([], "id long, status string, expected long")).count() == 0


def test_empty_table_takes_rows(spark):
    t = DeltaTable.create(base(spark, 0), folder(), "id", "version", 4)
    assert t.read().count() == 0
    t.upsert(base(spark, 5).select("id", "status", F.lit(None).cast("long").alias("expected")))
    assert [r[2] for r in rows(t.read())] == [1] * 5
