"""A keyed table that is changed in place of being rewritten: hash buckets, change files, merge on read.

A key's bucket is a hash of it. `upsert`, `delete` and `write_back` read only the buckets that hold a changed key,
and write the changed rows (or tombstones) to a new folder; a numbered entry in `log` makes them part
of the table, and as that file can be created only once, of two writers at the same time one gets an error
and the table stays whole. `read` returns each key's newest row; only buckets with changes are joined. `compact`
rewrites those as new base files; the folders that it replaces stay for readers until `vacuum`."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch
from . import upsert as U


class Conflict(RuntimeError):
    """Another writer has made the next entry of the log."""


class DeltaTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads(self._text("about"))
        self.key, self.version, self.buckets = about["key"], about["version"], about["buckets"]
        self.schema = T.StructType.fromJson(about["schema"])

    # ------------------------------------------------------------ files

    def _fs(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str:
        p, fs = self._fs(name)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """A new file; an error if it is there already."""
        p, fs = self._fs(name)
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def log(self) -> list[dict]:
        """The entries in order: (kind base or change, folder, buckets)."""
        p, fs = self._fs("log")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._text(f"log/{n}")) for n in names]

    def _commit(self, entries: list[dict], kind: str, folder: str, buckets: list[int]) -> None:
        self._put(f"log/{len(entries):09d}.json", json.dumps({"kind": kind, "folder": folder, "buckets": buckets}))

    # ------------------------------------------------------------ making and reading

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, version: str | None = None, buckets: int = 64) -> DeltaTable:
        """A table of df's rows with a key (rows without one are left out; keys must not repeat), at a new path. With a
        `version` column, upserts go by `upsert.upsert`'s rule."""
        table = cls.__new__(cls)
        table.spark, table.path, table.key, table.version, table.buckets = df.sparkSession, path.rstrip("/"), key, version, buckets
        table.schema = df.schema
        table._put("about", json.dumps({"key": key, "version": version, "buckets": buckets, "schema": df.schema.jsonValue()}))
        table._write(df.where(F.col(key).isNotNull()), "base", [])
        return table

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, entries: list[dict]) -> list[int]:
        """Store rows by bucket and add the entry; an update without rows adds none."""
        folder = f"{kind}-{uuid.uuid4().hex[:12]}"
        dealt = rows.withColumn("_bucket", self._bucket()).repartition(F.col("_bucket")).sortWithinPartitions("_bucket", self.key)
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        p, fs = self._fs(folder)
        found = sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(p) if s.getPath().getName().startswith("_bucket="))
        if found or not entries:
            self._commit(entries, kind, folder, found)
        return found

    def _files(self, entries: list[dict], buckets: set[int] | None) -> tuple[dict[int, str], list[tuple[int, int, str]]]:
        """The base folder of each bucket, and (entry, bucket, folder) of the changes made after it."""
        base, since = {}, []
        for n, e in enumerate(entries):
            for b in e["buckets"]:
                if buckets is None or b in buckets:
                    if e["kind"] == "base":
                        base[b] = f"{self.path}/{e['folder']}/_bucket={b}"
                        since = [x for x in since if x[1] != b]
                    else:
                        since.append((n, b, f"{self.path}/{e['folder']}/_bucket={b}"))
        return base, since

    def _changes(self, since: list[tuple[int, int, str]]) -> DataFrame:
        """The changes of some buckets with the number of their entry."""
        schema = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType())])
        out = None
        for n in sorted({n for n, _, _ in since}):
            part = self.spark.read.schema(schema).parquet(*[f for m, _, f in since if m == n]).withColumn("_entry", F.lit(n))
            out = part if out is None else out.unionByName(part)
        return out

    def read(self, buckets: set[int] | None = None, entries: list[dict] | None = None) -> DataFrame:
        """The rows as they are now, or as of the entries given; of some buckets only, if given."""
        base, since = self._files(self.log() if entries is None else entries, buckets)
        names = self.schema.names
        none = self.spark.createDataFrame([], self.schema)
        load = lambda paths: self.spark.read.schema(self.schema).parquet(*paths) if paths else none
        if not since:
            return load(list(base.values()))
        changed = {b for _, b, _ in since}
        newest = self._changes(since).groupBy(self.key).agg(F.max_by(F.struct(*[c for c in names if c != self.key], "_gone"), "_entry").alias("_r"))
        newest = newest.select(self.key, "_r.*")
        old = load([f for b, f in base.items() if b in changed]).join(newest.select(self.key), self.key, "left_anti")
        return load([f for b, f in base.items() if b not in changed]).unionByName(old.select(names)).unionByName(newest.where(~F.col("_gone")).select(names))

    # ------------------------------------------------------------ changing

    def _touched(self, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # at most as many as buckets

    def _current(self, keys: DataFrame, entries: list[dict]) -> DataFrame:
        """The present rows of the given keys, from their buckets alone."""
        return self.read(self._touched(keys), entries).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def upsert(self, changes: DataFrame, expected: str = "expected") -> DataFrame:
        """Insert or update by key; the report of `upsert.upsert` (key, action, requested, current). The table needs a
        version column. Changes without a key are left out."""
        scratch, entries = Scratch(self.spark, "delta"), self.log()
        changes = scratch.put(changes.where(F.col(self.key).isNotNull()), "changes")
        rows, report = U.upsert(scratch.put(self._current(changes, entries), "current"), changes, self.key, self.version, expected)
        report = scratch.put(report, "report")
        new = rows.join(report.where("action IN ('inserted', 'updated')").select(self.key), self.key, "left_semi")
        self._write(new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], F.lit(False).alias("_gone")), "change", entries)
        return report

    def delete(self, ids: DataFrame) -> DataFrame:
        """Put tombstones for the ids that are there; (key, state) with deleted or not_found for each id."""
        scratch, entries = Scratch(self.spark, "delta"), self.log()
        ids = scratch.put(ids.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "ids")
        current = scratch.put(self._current(ids, entries), "current")
        self._write(current.withColumn("_gone", F.lit(True)), "change", entries)
        return U.delete(current, ids, self.key)[1]

    def write_back(self, new: DataFrame, column: str) -> int:
        """Replace a column where new (key, column) has a value; the number of rows written."""
        scratch, entries = Scratch(self.spark, "delta"), self.log()
        new = scratch.put(new.where(F.col(self.key).isNotNull() & F.col(column).isNotNull()).select(self.key, column), "new")
        rows = scratch.put(U.write_back(self._current(new, entries), new, self.key, column).select(self.schema.names), "rows")
        self._write(rows.withColumn("_gone", F.lit(False)), "change", entries)
        return rows.count()

    def compact(self, least: int = 1) -> list[int]:
        """Rewrite the buckets with at least so many change folders as base files; those buckets."""
        entries = self.log()
        _, since = self._files(entries, None)
        many = [b for _, b, _ in since]
        chosen = {b for b in many if many.count(b) >= least}
        if chosen:
            folder = f"base-{uuid.uuid4().hex[:12]}"
            dealt = self.read(chosen, entries).withColumn("_bucket", self._bucket()).repartition(F.col("_bucket")).sortWithinPartitions("_bucket", self.key)
            dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            for b in chosen:  # a bucket whose rows are all gone has no files, but is rewritten too
                self._fs(f"{folder}/_bucket={b}")[1].mkdirs(self._fs(f"{folder}/_bucket={b}")[0])
            self._commit(entries, "base", folder, sorted(chosen))
        return sorted(chosen)

    def vacuum(self) -> list[str]:
        """Remove the bucket folders that the table no longer reads; what is left is what `read` needs."""
        base, since = self._files(self.log(), None)
        used = {*base.values(), *(f for _, _, f in since)}
        gone = []
        for e in self.log():
            for b in e["buckets"]:
                name = f"{e['folder']}/_bucket={b}"
                p, fs = self._fs(name)
                if f"{self.path}/{name}" not in used and fs.exists(p):
                    fs.delete(p, True)
                    gone.append(name)
        return gone
