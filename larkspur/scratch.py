"""Tables that a job stores on its way, in the folder that all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark (from 4.1 on) removes a query's shuffle files as it ends, and not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets an own
    one; on a cluster this is an error, as a folder of one machine is not seen by the others."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-larkspur-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """The name of a folder of its own in the shared one."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Tables of one run in the shared folder. Reading them back cuts the lineage and, as every
    executor sees the folder, survives the loss of any of them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, new_folder(spark, tag)
        workers_find_package(spark)

    def put(self, df: DataFrame, name: str, rows: int | None = None, compression: str = "snappy") -> DataFrame:
        """Store and reread; `rows`, if known as a bound, keeps small tables from falling into many files."""
        path = f"{self.root}/{name}"
        df = df if rows is None else df.coalesce(max(12, -(-rows // 250_000)))
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing unfinished reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession | None = None) -> None:
    """Give the executors' Python workers this package, once for each application: as an archive that Spark
    sends to every executor, also to those that come later. On one machine its folder is put on the
    workers' path instead."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    if sc.master == "local" or sc.master.startswith("local["):
        have = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if REPO not in have:
            sc.environment["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, have)])
        return
    folder = tempfile.mkdtemp(prefix="spark-larkspur-")  # of the driver; Spark serves the file from there
    root = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(os.path.join(folder, "larkspur.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.join("larkspur", os.path.relpath(os.path.join(at, name), root)))
    sc.addPyFile(os.path.join(folder, "larkspur.zip"))


workers_find_package = shipped
