"""Table maintenance: versioned upsert, deletes, write-back, merges, set comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str = "version", expected: str = "expected") -> tuple[DataFrame, DataFrame]:
    """(table, report) after the changes (key, expected version or null, …).

    A new key is inserted with version 1; a known one is updated to its version + 1 if the expected
    version is null or equal, else skipped. Existence is tested before writing. Of several changes of a
    key the last by `expected` counts, of equal ones the first by the other columns."""
    cols = [c for c in base.columns if c not in (key, version)]
    w = Window.partitionBy(key).orderBy(F.col(expected).desc_nulls_last(), *cols)
    c = changes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(key, F.col(expected).alias("_e"), *[F.col(x).alias(f"_{x}") for x in cols], F.lit(True).alias("_c"))
    j = base.withColumn("_b", F.lit(True)).join(c, key, "full")
    action = F.when(F.col("_c").isNull(), "kept").when(F.col("_b").isNull(), "inserted").when(F.col("_e").isNull() | (F.col("_e") == F.col(version)), "updated").otherwise("skipped")
    j = j.withColumn("action", action)
    new = F.col("action").isin("inserted", "updated")
    table = j.select(key, *[F.when(new, F.col(f"_{x}")).otherwise(F.col(x)).alias(x) for x in cols], F.when(F.col("action") == "inserted", 1).when(F.col("action") == "updated", F.col(version) + 1).otherwise(F.col(version)).alias(version))
    report = j.where("action <> 'kept'").select(key, "action", F.col("_e").alias("requested"), F.col(version).alias("current"))
    return table, report


def delete(base: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table, report): rows without the ids; deleted or not_found for each id."""
    d = ids.select(key).distinct()
    known = base.select(key).distinct().withColumn("_b", F.lit(True))
    return base.join(d, key, "left_anti"), d.join(known, key, "left").select(key, F.when(F.col("_b"), "deleted").otherwise("not_found").alias("state"))


def write_back(base: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """base with column replaced where new (key, column) has a value."""
    return base.join(new.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def drop_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each composite key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")


def merge(a: DataFrame, b: DataFrame, keys: list[str] | None, order: str) -> DataFrame:
    both = a.unionByName(b, allowMissingColumns=True)
    return drop_duplicates(both, keys, order) if keys else both


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (same, only_a, only_b)."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full").agg(F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"))
    return j.select(((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("same"), "only_a", "only_b")


def first_names(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """(key, name): the first non-empty name of each key."""
    return df.where(F.trim(F.col(name)) != "").groupBy(key).agg(F.min_by(name, order).alias(name))


def with_name(df: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Left join that tolerates text and number ids."""
    n = names.select(F.trim(F.col(key).cast("string")).alias("_k"), F.col(name).alias(name))
    return df.join(n, F.trim(df[key].cast("string")) == F.col("_k"), "left").drop("_k")


def assemble_results(entities: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """A row for each entity with a struct for each part, and the names of the parts that are missing."""
    out = entities.select(key).distinct()
    for name, p in parts.items():
        out = out.join(p.select(key, F.struct(*[c for c in p.columns if c != key]).alias(name)), key, "left")
    return out.withColumn("errors", F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in parts])))
