"""Sources. Schemas are explicit; names that differ between files are settled here, never in operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_reviews_delimited(spark: SparkSession, path: str, sep: str = "\t", names: tuple[str, ...] = ("Review", "content", "text")) -> DataFrame:
    """(content): the first of the names that the header has, trimmed, empty ones dropped."""
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    have = [n for n in names if n in df.columns]
    if not have:
        raise ValueError(f"none of {names} is a column of {path}")
    return df.select(F.trim(F.col(have[0])).alias("content")).where("content <> ''")


def spread(df: DataFrame) -> DataFrame:
    """A table just read, for work that is heavy on each row: dealt out to all cores where Spark would read it in
    fewer partitions than there are cores, as a file of one row group is otherwise one task. What moves is then
    at most the content of a scan's partition for each core; a table of more partitions stays as it is. Filters
    and column choices made later still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


REVIEW = "struct<id:bigint,review_id:bigint,restaurant_id:bigint,content:string,text:string,created_at:string>"
NESTED = f"struct<reviews:array<{REVIEW}>,restaurants:array<struct<id:bigint,restaurant_id:bigint,name:string,restaurant_name:string,reviews:array<{REVIEW}>>>>"


def read_reviews_json(spark: SparkSession, path: str) -> DataFrame:
    """(restaurant_id, id, content, created_at) from a list, {reviews: […]} or {restaurants: [{reviews}]}, one JSON value a file."""
    raw = spark.read.text(path, wholetext=True)
    as_list, as_tree = F.from_json("value", f"array<{REVIEW}>"), F.from_json("value", NESTED)
    inner = F.flatten(F.transform(as_tree["restaurants"], lambda r: F.transform(r["reviews"], lambda x: x.withField("restaurant_id", F.coalesce(x["restaurant_id"], r["id"], r["restaurant_id"])))))
    rows = raw.select(F.explode(F.when(F.ltrim("value").startswith("["), as_list).otherwise(F.coalesce(as_tree["reviews"], inner))).alias("r"))
    return rows.select("r.restaurant_id", F.coalesce("r.id", "r.review_id").alias("id"), F.coalesce("r.content", "r.text").alias("content"), "r.created_at")


def complete_partitions(spark: SparkSession, base: str, kind: str, dt: str | None = None, marker: str = "_SUCCESS") -> list[str]:
    """Paths of base/kind/dt=…/ that hold the marker, in order; only those are read, so Spark prunes the rest."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{base}/{kind}/dt={dt or '*'}/{marker}")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern) or []
    return sorted(str(s.getPath().getParent()) for s in found)


def read_raw(spark: SparkSession, base: str, kind: str, schema: T.StructType, dt: str | None = None, only_complete: bool = True, paths: list[str] | None = None) -> DataFrame:
    """All csv and json(.gz) files (arrays or lines) of the kind's partitions with the schema, and dt; paths: of
    these partitions. Files of JSON lines are split among tasks like any text; a file that is one array (a line
    of it starts with a bracket) is one value."""
    if paths is None:
        paths = complete_partitions(spark, base, kind, dt) if only_complete else [f"{base}/{kind}"]
    with_dt = T.StructType([*[f for f in schema.fields if f.name != "dt"], T.StructField("dt", T.StringType())])
    if not paths:
        return spark.createDataFrame([], with_dt)
    opts = {"basePath": f"{base}/{kind}", "recursiveFileLookup": False}
    csv = spark.read.options(**opts).option("header", True).option("pathGlobFilter", "*.csv").schema(with_dt).csv(paths)
    text = spark.read.options(**opts).option("pathGlobFilter", "*.json*").schema("value string, dt string")
    file = F.col("_metadata.file_path")
    line = text.text(paths).where(F.trim("value") != "")
    arrays = line.where(F.col("value").rlike(r"^\s*\[")).select(file.alias("_array")).distinct()
    lines = line.withColumn("_file", file).join(arrays, F.col("_file") == F.col("_array"), "left_anti").select(F.from_json("value", schema).alias("r"), "dt")
    whole = text.text(paths, wholetext=True).where(F.col("value").rlike(r"^\s*\[")).select(F.explode(F.from_json("value", T.ArrayType(schema))).alias("r"), "dt")
    rows = lines.unionByName(whole)
    return csv.unionByName(rows.select("r.*", "dt").select(csv.columns), allowMissingColumns=True)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def normalize_columns(df: DataFrame) -> DataFrame:
    """camelCase names as snake_case; where both are there, the snake_case column stays."""
    have = set(df.columns)
    drop = [c for c in df.columns if snake(c) != c and snake(c) in have]
    return df.drop(*drop).withColumnsRenamed({c: snake(c) for c in df.columns if c not in drop})


def id_strings(df: DataFrame, columns: tuple[str, ...] = ("event_id", "member_id", "anonymous_id", "session_id", "restaurant_id", "recommendation_id", "food_category_id")) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})


def blocks(c: Column) -> Column:
    """Blank-line-separated blocks of a text, lines joined by a space."""
    parts = F.transform(F.split(c, r"\n\s*\n"), lambda b: F.trim(F.regexp_replace(b, r"\s*\n\s*", " ")))
    return F.filter(parts, lambda b: b != "")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(blocks(F.col("value"))).alias("content"))


def extract_reviews(c: Column, start: str, end: str) -> Column:
    """Texts between a start marker line and a line that matches `end`, lines joined by a space."""
    found = F.regexp_extract_all(c, F.lit(rf"(?sm)^{start}\s*$(.*?)^{end}\s*$"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s*\n\s*", " "))), lambda x: x != "")


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def load_seeds(spark: SparkSession, path: str | None, defaults: DataFrame) -> DataFrame:
    """(category, pos, phrase): the stored seeds of each category, the defaults of those that have none."""
    if path is None:
        return defaults
    stored = spark.read.schema(defaults.schema).parquet(path)
    return stored.unionByName(defaults.join(stored.select("category").distinct(), "category", "left_anti"))


def read_samples(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """(meta, *sample) from {meta, results}, {meta, samples} or a list; one JSON value a file."""
    raw = spark.read.text(path, wholetext=True)
    tree = F.from_json("value", f"struct<meta:map<string,string>,results:array<{sample}>,samples:array<{sample}>>")
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{sample}>")).otherwise(F.coalesce(tree["results"], tree["samples"]))
    return raw.select(tree["meta"].alias("meta"), F.explode(rows).alias("s")).select("meta", "s.*")
