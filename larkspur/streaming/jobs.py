"""Structured Streaming jobs over the same operators. Rows later than the watermark are dropped where a
job has one; each docstring says so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import last_per_key
from ..sources.readers import complete_partitions, read_raw


def stream_partitions(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """New files of a landing path. Run with trigger(availableNow=True) to take what is there and stop."""
    return spark.readStream.schema(schema).format(fmt).option("recursiveFileLookup", False).load(path)


def stream_complete(spark: SparkSession, base: str, kind: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame | None:
    """The files of the partitions base/kind/dt=… that hold a marker by now, with dt; None if there is none
    yet. Each scheduled run (trigger(availableNow=True), one checkpoint for all runs) lists them anew;
    the checkpoint knows the files that earlier runs have taken."""
    found = complete_partitions(spark, base, kind)
    if not found:
        return None
    days = ",".join(p.rpartition("/")[2] for p in found)
    rows = spark.readStream.schema(schema).format(fmt).load(f"{base}/{kind}/{{{days}}}")
    return rows.withColumn("dt", F.regexp_extract(F.col("_metadata.file_path"), r"/dt=([^/]+)/", 1))


def poll_complete(spark: SparkSession, base: str, kind: str, schema: T.StructType, sink: Callable[[DataFrame, int], None], check: str, per_batch: int | None = None, **trigger):
    """A query that hands each partition base/kind/dt=… to the sink once its marker is there, by itself.

    A clock stream asks for new markers in every micro-batch; what a batch takes is written to a plan under `check`
    before it is read, so that a batch that is repeated after a failure takes the same partitions, and
    later ones leave them out. The sink is called as foreachBatch's is, with all csv and JSON rows of
    the new partitions and the batch's number; as there, writing by that number makes it exactly once.
    per_batch: partitions that a batch takes at most, the earliest first."""
    plans = f"{check}/taken"

    def batch(_: DataFrame, epoch: int) -> None:
        taken = _taken(spark, plans)
        mine = sorted(p for p, e in taken.items() if e == epoch)
        if not mine:
            mine = [p for p in complete_partitions(spark, base, kind) if p not in taken][:per_batch]
            if not mine:
                return
            spark.createDataFrame([(p, epoch) for p in mine], "path string, epoch long").coalesce(1).write.mode("overwrite").parquet(f"{plans}/batch={epoch}")
        sink(read_raw(spark, base, kind, schema, paths=mine), epoch)

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return clock.writeStream.option("checkpointLocation", f"{check}/clock").foreachBatch(batch).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def _taken(spark: SparkSession, plans: str) -> dict[str, int]:
    """The batch that took each partition."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(plans)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return {}
    rows = spark.read.schema("path string, epoch long").option("recursiveFileLookup", True).parquet(plans)
    return {r["path"]: r["epoch"] for r in rows.collect()}  # a row for each partition, as many as listed


def dedupe_events(sdf: DataFrame, watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Each event_id once; its state is kept for the watermark, later repeats count as new."""
    return sdf.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["event_id"])


def success_rate(sdf: DataFrame, size: str = "5 minutes", slide: str = "30 seconds", watermark: str = "10 minutes") -> DataFrame:
    """(start, requests, success_rate) in sliding windows of (ts, ok); late rows are dropped."""
    w = sdf.withWatermark("ts", watermark).groupBy(F.window("ts", size, slide))
    return w.agg(F.count(F.lit(1)).alias("requests"), F.avg(F.col("ok").cast("double")).alias("success_rate")).select(F.col("window.start").alias("start"), "requests", "success_rate")


def saturation(sdf: DataFrame, size: str = "1 minute", limit: float = 0.95, watermark: str = "5 minutes") -> DataFrame:
    """(start, ratio) of tumbling windows of (ts, busy, total) whose mean busy share exceeds the limit."""
    w = sdf.withWatermark("ts", watermark).groupBy(F.window("ts", size)).agg(F.avg(F.col("busy") / F.col("total")).alias("ratio"))
    return w.select(F.col("window.start").alias("start"), "ratio").where(F.col("ratio") > limit)


def event_counts(sdf: DataFrame, size: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """(start, event_type, n) in tumbling windows."""
    w = sdf.withWatermark("ts", watermark).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(sdf: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): sessions that end after a gap."""
    w = sdf.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def enrich_stream(sdf: DataFrame, items: DataFrame, menus: DataFrame, key: str = "restaurant_id", order: str = "dt") -> DataFrame:
    """Stream joined with the last row of each static item and menu."""
    return sdf.join(last_per_key(items, key, order).drop(order), key, "left").join(last_per_key(menus, key, order).drop(order), key, "left")
