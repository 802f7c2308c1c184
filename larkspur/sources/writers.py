"""Sinks: partitioned tables with markers, nested and flat exports, saved look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from ..scratch import Scratch
from .readers import complete_partitions


def to_flat(df: DataFrame, order: str, entity: str, text: str) -> DataFrame:
    """Valid rows with sequential ids: (id, restaurant_id, content), numbered in order without one big task."""
    return numbered(df.where(F.length(F.trim(F.col(text))) > 0), F.col(order), name="id").select("id", F.col(entity).alias("restaurant_id"), F.col(text).alias("content"))


def to_nested(df: DataFrame, entity: str, key: str, *columns: str, part: Column | None = None) -> DataFrame:
    """(entity, part, reviews): one row for each entity with its rows by key. With `part`, an expression of the
    key that is the same for a bounded number of rows, an entity has a row for each part."""
    by = [F.col(entity), *([] if part is None else [part.alias("part")])]
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(key, *columns))).alias("reviews"))


def flatten_results(df: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """(key, analysis_type, result_payload): one row for each analysis struct that is there, as JSON."""
    rows = F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("analysis_type"), F.to_json(k).alias("result_payload"))) for k in kinds]), lambda x: x.isNotNull())
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def write_recs(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Partitions pipeline_version=/dt=, gzip; a marker in every partition after the job has committed. The rows
    are stored once, and both the files and the list of partitions come from there."""
    df = Scratch(df.sparkSession, "recs").put(df, "rows")
    (df.write.mode("append").partitionBy("pipeline_version", "dt").option("compression", "gzip").option("header", True).format(fmt).save(path))
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in df.select("pipeline_version", "dt").distinct().toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/pipeline_version={row[0]}/dt={row[1]}/_SUCCESS")
        p.getFileSystem(conf).create(p, True).close()


def import_recs(df: DataFrame, imported: DataFrame) -> DataFrame:
    """Rows of the partitions that are not imported yet."""
    return df.join(imported.select("pipeline_version", "dt").distinct(), ["pipeline_version", "dt"], "left_anti")


def write_features(df: DataFrame, path: str) -> None:
    """Typed Parquet by split; no header lines that a reader could miss."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def save_lookups(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_seeds(seeds: DataFrame, path: str) -> None:
    """Seeds (category, pos, phrase) where readers.load_seeds finds them."""
    seeds.write.mode("overwrite").parquet(path)


def load_lookups(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_splits(samples: DataFrame, path: str) -> DataFrame:
    """Samples by split, and one row of counts for each split and window."""
    samples.write.mode("overwrite").partitionBy("split").parquet(path)
    return samples.groupBy("split", "window_size", "stride").agg(F.count(F.lit(1)).alias("samples"))


def latest_partition(spark, base: str, kind: str) -> str | None:
    found = complete_partitions(spark, base, kind)
    return found[-1] if found else None


def versioned_result(df: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """The newest row of an append-only result table for each key."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
