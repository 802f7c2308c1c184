"""A stored inverted cell index for vector search.

Centres are fitted in two levels by spherical k-means: coarse ones on the driver from a bounded sample, and
within each coarse cell, on the executors, as many as its number of vectors asks for, again from a
bounded sample of it. Every vector is stored in the cell of its nearest centre, in folders by coarse cell,
so that a search reads the folders of the cells it visits. Vectors can be added later; they go to the
cells that are there.

`search` visits the `probes` nearest cells of each query and ranks what it finds by the exact cosine; `calibrated`
picks the number of probes that reaches a recall on a bounded sample of queries. `exact` visits every
cell that can hold a better document than those found so far, by the angle between the query and the cell's
centre less that to the cell's farthest vector, so it loses nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shipped
from .nearest import matrix, nearest, unit
from .retrieval import _ranked
from .sampling import uniform

#: Coarse cells, and cells within one, at most: the table of all centres is at most their product by the
#: vectors' width. Rows that a fit reads at most.
COARSE, WITHIN, SAMPLE = 128, 128, 16_384


def fit(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k unit centres of unit vectors by spherical k-means from a fixed seed."""
    c = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def usable(docs: DataFrame) -> DataFrame:
    """Rows whose vector has a direction: not null, without nulls or non-finite numbers, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = docs.withColumn("vector", F.col("vector").cast("array<double>")).where("vector IS NOT NULL")
    return v.where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


class VectorIndex:
    """An index at a path that all executors see: `vectors` (coarse, cell, doc, *by, vector), `cells` (cell, n,
    far: the least cosine of a vector to its centre), a row for each cell and batch added, and `centres`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        shipped(spark)
        rows = spark.read.parquet(f"{path}/centres").orderBy("coarse", "cell").collect()  # COARSE * WITHIN at most
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        self.by, self.width = tuple(about["by"]), about["width"]
        self.coarse = np.array([r["coarse"] for r in rows], np.int64)
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.centres = np.array([r["centre"] for r in rows], float).reshape(len(rows), self.width)

    # ------------------------------------------------------------ building

    @classmethod
    def build(cls, docs: DataFrame, path: str, by: tuple[str, ...] = (), per_cell: int = 1024, sample: int = SAMPLE, seed: int = 42) -> VectorIndex:
        """Index docs (doc, *by, vector) at a path, which must be new. Rows whose vector is null, zero or holds a null
        or non-finite number, or is of another width than most, are left out. per_cell is the aim for cells' sizes,
        as far as COARSE * WITHIN cells reach."""
        spark = docs.sparkSession
        shipped(spark)
        scratch = Scratch(spark, "index")
        v = scratch.put(usable(docs.select("doc", *by, "vector")), "usable")
        width = v.groupBy(F.size("vector").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
        n, width = (width["n"], width["w"]) if width else (0, 0)
        v = v.where(F.size("vector") == width)
        some = v.where(uniform(seed, "doc") < sample / max(1, n)).select("vector").limit(2 * sample).toPandas() if n > sample else v.select("vector").toPandas()
        k = max(1, min(COARSE, math.isqrt(max(1, n // per_cell))))
        x = unit(np.stack(some["vector"].to_numpy())) if len(some) else np.zeros((0, width))
        first = spark.sparkContext.broadcast(fit(x[np.lexsort(x.T)], k) if len(x) else x)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = (unit(matrix(b.column("vector"))) @ first.value.T).argmax(axis=1) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int64))], [*b.schema.names, "coarse"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.schema.fields)
        placed = scratch.put(v.mapInArrow(place, f"{schema}, coarse long"), "placed")
        sizes = placed.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))

        def within(t: pd.DataFrame) -> pd.DataFrame:
            x = unit(np.stack(t["vector"].to_numpy()))
            c = fit(x[np.lexsort(x.T)], int(max(1, min(WITHIN, round(t["n"].iloc[0] / per_cell), len(x)))))
            coarse = int(t["coarse"].iloc[0])
            return pd.DataFrame({"coarse": coarse, "cell": coarse * WITHIN + np.arange(len(c)), "centre": list(c)})

        chosen = placed.join(F.broadcast(sizes), "coarse").where(uniform(seed + 1, "doc") < F.lit(float(sample)) / F.col("n"))  # a row for each coarse cell
        centres = chosen.select("coarse", "n", "vector").groupBy("coarse").applyInPandas(within, "coarse long, cell long, centre array<double>")
        scratch.put(centres, "centres").coalesce(1).write.parquet(f"{path}/centres")
        spark.range(1).select(F.lit(json.dumps({"by": list(by), "width": width}))).coalesce(1).write.text(f"{path}/about")
        index = cls(spark, path)
        index.add(placed.drop("coarse"))
        scratch.drop("usable", "placed", "centres")
        return index

    def add(self, docs: DataFrame) -> None:
        """Store more docs in the cells that are there. An id that comes again is a second row."""
        v = usable(docs.select("doc", *self.by, "vector")).where(F.size("vector") == self.width)
        held = self.spark.sparkContext.broadcast((self.centres, self.cell, self.coarse))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, cell, coarse = held.value
            for b in batches:
                s = unit(matrix(b.column("vector"))) @ centres.T if b.num_rows else np.zeros((0, 1))
                near = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(coarse[near]), pa.array(cell[near]), pa.array(s[np.arange(len(s)), near]), *b.columns], ["coarse", "cell", "close", *b.schema.names])

        if not len(self.cell):
            return
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.schema.fields)
        scratch = Scratch(self.spark, "index")
        placed = scratch.put(v.mapInArrow(place, f"coarse long, cell long, close double, {schema}"), "added")
        # One folder for each coarse cell; a large one is written by several tasks.
        dealt = placed.repartition("coarse", F.pmod(F.xxhash64("cell"), F.lit(8))).sortWithinPartitions("coarse", "cell")
        dealt.drop("close").write.mode("append").partitionBy("coarse").parquet(f"{self.path}/vectors")
        placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("close").alias("far")).write.mode("append").parquet(f"{self.path}/cells")
        scratch.drop("added")

    # ------------------------------------------------------------ searching

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def cells(self) -> DataFrame:
        """(cell, n, far) of the cells that have vectors."""
        return self.spark.read.parquet(f"{self.path}/cells").groupBy("cell").agg(F.sum("n").alias("n"), F.min("far").alias("far"))

    def _visits(self, queries: DataFrame, choose, extra: list[str]) -> DataFrame:
        """queries with a row for each cell that choose(cosines to the centres, *extra columns) marks."""
        held = self.spark.sparkContext.broadcast((self.centres, self.cell))
        names = ["query", *self.by, "vector"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, cell = held.value
            for b in batches:
                for low in range(0, b.num_rows, 256):
                    part = b.slice(low, 256)
                    s = np.clip(unit(matrix(part.column("vector"))) @ centres.T, -1, 1)
                    i, j = np.nonzero(choose(s, *[part.column(c) for c in extra]))
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(i)) for c in names), pa.array(cell[j])], [*names, "cell"])

        q = usable(queries.select("query", *self.by, "vector", *extra)).where(F.size("vector") == self.width)
        schema = ", ".join(f"`{c}` {q.schema[c].dataType.simpleString()}" for c in names)
        return q.mapInArrow(run, f"{schema}, cell long")

    def _hits(self, visits: DataFrame, k: int, min_score: float, block: int, others_only: bool) -> DataFrame:
        """The best k of each query in each part of each cell that it visits; cells of more than `block` vectors are
        cut into parts. Only the folders of visited cells are read."""
        visits = Scratch(self.spark, "visits").put(visits, "visits")
        seen = sorted(r["cell"] for r in visits.select("cell").distinct().collect())  # COARSE * WITHIN at most
        folders = sorted({int(c) for c in self.coarse[np.isin(self.cell, seen)]})
        parts = F.broadcast(self.cells().where(F.col("cell").isin(seen)).select("cell", F.ceil(F.col("n") / block).alias("_n")))  # as many rows
        q = visits.join(parts, "cell").select("query", *self.by, "vector", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_b"))
        d = self.vectors().where(F.col("coarse").isin(folders)).join(parts, "cell").select("doc", *self.by, "vector", "cell", F.pmod(F.xxhash64("doc"), F.col("_n")).alias("_b"))
        return nearest(q, d, ["cell", "_b", *self.by], list(self.by), k, min_score, others_only=others_only)

    def search(self, queries: DataFrame, k: int, probes: int = 8, min_score: float = -1.0, block: int = 8192, others_only: bool = False) -> DataFrame:
        """(*by, query, doc, score, rank) like `dense_topk`, from the `probes` nearest cells of each query (query,
        *by, vector). A query without a direction finds nothing."""

        def choose(s: np.ndarray) -> np.ndarray:
            n = min(probes, s.shape[1])
            out = np.zeros(s.shape, bool)
            np.put_along_axis(out, np.argpartition(-s, n - 1, axis=1)[:, :n], True, 1)
            return out

        return _ranked(self._hits(self._visits(queries, choose, []), k, min_score, block, others_only), k, (*self.by, "query"))

    def exact(self, queries: DataFrame, k: int, first: int = 4, min_score: float = -1.0, block: int = 8192, others_only: bool = False) -> DataFrame:
        """The rows of `dense_topk`: first the `first` nearest cells of each query, whose k-th score is then the
        least that counts; then all other cells that can hold as much."""
        scratch = Scratch(self.spark, "exact")
        found = scratch.put(self.search(queries, k, first, min_score, block, others_only), "first")
        least = found.where(F.col("rank") == k).select("query", *self.by, F.col("score").alias("_least"))
        key = ["query", *self.by]
        more = queries.select(*key, "vector").join(least, key, "left").withColumn("_least", F.greatest(F.coalesce("_least", F.lit(float(min_score))), F.lit(float(min_score))))
        far = {r["cell"]: r["far"] for r in self.cells().collect()}  # as many rows as cells
        radius = np.array([math.acos(max(-1.0, min(1.0, far[c]))) if c in far else -10.0 for c in self.cell.tolist()])

        def choose(s: np.ndarray, least: pa.Array) -> np.ndarray:
            n = min(first, s.shape[1])
            s = s.copy()
            nearest_first = np.argpartition(-s, n - 1, axis=1)[:, :n]
            # Scores are rounded, and cosines near 1 lose digits in the angle: a margin keeps the bound safe.
            bound = np.cos(np.maximum(0.0, np.arccos(s) - radius[None, :])) + 1e-6
            out = (bound >= least.to_numpy(zero_copy_only=False)[:, None]) & (radius > -1)[None, :]
            np.put_along_axis(out, nearest_first, False, 1)
            return out

        rest = self._hits(self._visits(more, choose, ["_least"]), k, min_score, block, others_only)
        return _ranked(found.drop("rank").unionByName(rest.select(*found.drop("rank").columns)), k, (*self.by, "query"))

    def calibrated(self, k: int, recall: float = 0.95, queries: int = 200, seed: int = 5) -> int:
        """The least number of probes (a power of two, or all cells) that reaches the recall at k on at most about
        `queries` stored vectors, chosen by hash, against `exact`."""
        v = self.vectors()
        n = self.cells().agg(F.sum("n")).first()[0] or 0
        q = v.where(uniform(seed, "doc") < queries / max(1, n)).select(F.col("doc").alias("query"), *self.by, "vector")
        q = Scratch(self.spark, "calibration").put(q, "queries")
        true = Scratch(self.spark, "calibration").put(self.exact(q, k), "exact")
        probes = 1
        while probes < len(self.cell) and recall_at(self.search(q, k, probes), true, self.by) < recall:
            probes *= 2
        return min(probes, max(1, len(self.cell)))


def recall_at(found: DataFrame, true: DataFrame, by: tuple[str, ...] = ()) -> float:
    """The share of the true (query, doc) rows that were found; 1 if there are none."""
    key = ["query", *by, "doc"]
    r = true.select(*key).join(found.select(*key, F.lit(1).alias("_f")), key, "left").agg(F.count(F.lit(1)).alias("n"), F.count("_f").alias("f")).first()
    return r["f"] / r["n"] if r["n"] else 1.0
