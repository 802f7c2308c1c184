"""Groups that hold most of the rows: positions, sums and percentiles over many tasks, against one window."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import opsmetrics as M
from larkspur.operators import sampling as S


def hot(spark, n):
    """n rows, of which 90 % are of one entity."""
    return spark.range(n).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 20 == 0, F.lit(None)).otherwise(F.concat(F.lit("e"), F.col("id") % 70)).alias("entity"), F.col("id").alias("key"), F.pmod(F.xxhash64("id"), F.lit(n // 3)).alias("ts"))


def test_positions_within_a_hot_group_equal_one_window(spark):
    df = hot(spark, 40_000)
    got = S.numbered_within(df, ("entity",), F.col("ts"), F.col("key"))
    w = Window.partitionBy("entity")
    want = df.withColumn("pos", F.row_number().over(w.orderBy("ts", "key")).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))
    cols = ["entity", "key", "pos", "n"]
    assert got.count() == 40_000 and got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert S.numbered_within(df.limit(0), ("entity",), F.col("ts"), F.col("key")).count() == 0


def test_no_task_holds_the_hot_group(spark):
    """Two million rows: the stored partitions that are numbered hold about as many rows each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        out = S.numbered_within(hot(spark, 2_000_000), ("entity",), F.col("ts"), F.col("key"))
        files = {f: n for f, n in spark.read.parquet(*out.inputFiles()).groupBy(F.input_file_name()).count().collect()}
        sizes = sorted(files.values())
        assert len(sizes) >= 6 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        hot_rows = out.where("entity = 'hot'").agg(F.max("pos"), F.count_distinct("pos"), F.max("n")).first()
        assert tuple(hot_rows) == (1_800_000,) * 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_percentiles_of_many_distinct_values(spark):
    import duckdb
    import numpy as np

    x = np.random.default_rng(1).random(1_000_000)
    want = sorted(x.tolist())
    n = len(want)
    path = f"{__import__('tempfile').mkdtemp(prefix='spark-larkspur-')}/v.parquet"
    duckdb.connect().from_df(__import__("pandas").DataFrame({"v": x})).write_parquet(path)
    got = M.index_percentile(spark.read.parquet(path), "v", (0, 1, 50, 95, 99, 100)).first()
    assert tuple(got) == tuple(want[min(n * p // 100, n - 1)] for p in (0, 1, 50, 95, 99, 100))


def test_spread_percentiles_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 3.5, None, rng.random()])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    one, two = (sorted(map(tuple, M.index_percentile(df, "v", (10, 50, 99), ("k",), spread).collect()), key=repr) for spread in (True, False))
    assert one == two and len(one) == 3
    assert M.index_percentile(df.limit(0), "v", (50,)).first()[0] is None
