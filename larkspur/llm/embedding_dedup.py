"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

Vectors that are equal are one class, of which one is compared. Centres are fitted on a bounded
sample. Every vector lives in the cell of its nearest centre and visits the other cells whose centres
are nearly as close (`slack`, at most `probes`), so that links over a border are found. A cell that is
larger than `block` gets centres of its own, from a bounded sample of it, and its vectors are assigned
again to the cells within it; so their number grows with the data, up to the square of `most_cells`.
What is still larger than `block` is cut into blocks, and each pair of blocks is a task of its own: no
task holds more than two blocks, however many rows one cell has. A task gives each vector its number
of links and one link to the least vector of its part, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_share
from .components import components


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that no square overflows or vanishes.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that can link: finite, without nulls, not all zero."""
    e = F.col("embedding").cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    twice = v.where("vec_id is not null").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    if not twice.isEmpty():
        once = v.join(twice, "vec_id", "left_anti")
        v = once.unionByName(v.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.where("vec_id is not null and embedding is not null").where((~F.exists("embedding", bad)) & F.exists("embedding", lambda x: x != 0))


def centres(v: DataFrame, n: int, per_cell: int, most_cells: int, sample: int, rounds: int = 8) -> np.ndarray:
    """Unit centres, from at most `sample` vectors chosen by a hash of their ids."""
    share = min(1.0, sample / max(1, n))
    got = v.where(in_share(share, "vec_id", F.lit(11))).orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(sample).toPandas()
    if not len(got):
        return np.zeros((0, 0))
    width = got["embedding"].map(len).mode()[0]
    x = _unit(np.array([e for e in got["embedding"] if len(e) == width], float))
    return _fit(x, int(min(most_cells, max(1, n // per_cell), len(x))), rounds)


def _fit(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k unit centres of unit vectors by spherical k-means."""
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, slack: float, probes: int) -> tuple[np.ndarray, list[list[int]]]:
    """The nearest centre of each unit vector, and those nearly as close."""
    sim = x @ c.T
    top = np.argsort(-sim, axis=1, kind="stable")[:, :probes]
    near = np.take_along_axis(sim, top, 1)
    return top[:, 0], [t[ok].tolist() for t, ok in zip(top, near >= near[:, :1] - slack)]


#: Numbers of the cells within a cell.
WITHIN = 1 << 20


def _parted(placed: DataFrame, scratch: Scratch, per_cell: int, most_cells: int, slack: float, probes: int, block: int, sample: int = 4096) -> DataFrame:
    """placed with each cell of more than `block` vectors parted: cell c is c * WITHIN, its parts the numbers after."""
    sizes = scratch.put(placed.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "large")
    own = F.broadcast(sizes)  # a row for each cell, most_cells and one for each odd width at most

    def centres_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = _unit(np.stack(pdf["embedding"].to_numpy()))
        c = _fit(x, int(min(most_cells, max(1, pdf["n"].iloc[0] // per_cell), max(1, len(x) // 4))), 6)
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "width": [c.shape[1]], "centres": [c.ravel()]})

    some = placed.join(own, placed["home"] == sizes["cell"]).where(in_share(F.least(F.lit(1.0), sample / F.col("n")), "vec_id", F.lit(12)))
    fitted = scratch.put(some.select("cell", "n", "vec_id", "embedding").groupBy("cell").applyInPandas(centres_of, "cell long, width int, centres array<double>"), "fitted")

    def near(v: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "home": pd.Series([], dtype="Int64"), "cells": pd.Series([], dtype=object)})
        cell = int(v["cell"].iloc[0])
        if len(c):
            first, cells = _nearest(_unit(np.stack(v["embedding"].to_numpy())), np.asarray(c["centres"].iloc[0]).reshape(-1, int(c["width"].iloc[0])), slack, probes)
        else:
            first, cells = np.zeros(len(v), np.int64), [[0]] * len(v)
        home = pd.Series(cell * WITHIN + 1 + first, dtype="Int64").where(v["home"].to_numpy() == cell)
        return pd.DataFrame({"vec_id": v["vec_id"].to_numpy(), "home": home, "cells": [[cell * WITHIN + 1 + t for t in x] for x in cells]})

    parts = F.ceil(F.col("n") / block)
    visits = placed.select("vec_id", "embedding", "home", F.explode("cells").alias("cell")).join(own, "cell").select("cell", F.pmod(F.xxhash64("vec_id", F.lit(9)), parts).alias("part"), "vec_id", "embedding", "home")
    held = fitted.join(own, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "width", "centres")
    again = visits.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInPandas(near, "vec_id long, home long, cells array<long>")
    again = scratch.put(again.groupBy("vec_id").agg(F.max("home").alias("_home"), F.flatten(F.collect_list("cells")).alias("_cells")), "again")
    # The large cells as one row of at most most_cells numbers.
    large = sizes.agg(F.collect_list("cell").alias("_large"))
    out = placed.join(again, "vec_id", "left").crossJoin(F.broadcast(large))
    others = F.transform(F.array_except("cells", "_large"), lambda c: c * WITHIN)
    return out.select("vec_id", "embedding", "m", F.coalesce("_home", F.col("home") * WITHIN).alias("home"), F.concat(others, F.coalesce("_cells", F.array().cast("array<long>"))).alias("cells"))


def _min_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number reachable from each of 0..n-1 over the edges (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, per_cell: int = 256, most_cells: int = 1024, sample: int = 20_000, slack: float = 0.25, probes: int = 8, block: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vec_id of vectors (vec_id, embedding, ...).

    Vectors link at a cosine, in double precision, of at least the threshold. A vector that is null,
    zero or holds null or non-finite components links with nothing and is kept, as is a null vec_id
    (one row, with a null component). Vectors of another width than the commonest share no cell with
    it and are compared with their like alone. A vec_id names one vector: of rows that repeat it with
    different vectors, the one that sorts first is compared. Other columns (labels too) are never read.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embeddings")
    every = scratch.put(valid(vectors), "valid")
    # Equal vectors are one class; its least id is compared for all.
    named = every.withColumn("name", F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b")))
    classes = scratch.put(named.groupBy("name").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")), "classes")
    member = scratch.put(named.select("vec_id", "name").join(classes, "name").select("vec_id", "rep", "m"), "member")
    v = scratch.put(every.join(classes.select(F.col("rep").alias("vec_id"), "m"), "vec_id"), "reps")
    scratch.drop("valid")
    n = v.count()
    c = spark.sparkContext.broadcast(centres(v, n, per_cell, most_cells, sample))

    def assign(batches):
        cent = c.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            emb = batch.column(1)
            offsets = np.asarray(emb.offsets)
            values, width = np.asarray(emb.values), np.diff(offsets)
            home, cells = np.empty(len(ids), np.int64), [None] * len(ids)
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                if not len(cent) or w != cent.shape[1]:
                    home[rows] = -int(w)
                    for r in rows:
                        cells[r] = [-int(w)]
                    continue
                home[rows], found = _nearest(_unit(values[offsets[rows][:, None] + np.arange(w)]), cent, slack, probes)
                for r, t in zip(rows, found):
                    cells[r] = t
            yield pa.RecordBatch.from_arrays([batch.column(0), emb, batch.column(2), pa.array(home), pa.array(cells, pa.list_(pa.int64()))], ["vec_id", "embedding", "m", "home", "cells"])

    first = scratch.put(v.mapInArrow(assign, "vec_id long, embedding array<double>, m long, home long, cells array<long>"), "first")
    placed = scratch.put(_parted(first, scratch, per_cell, most_cells, slack, probes, block), "placed")
    scratch.drop("reps", "first")
    # Blocks of each cell: as many as its rows need.
    counts = placed.select("home", F.explode("cells").alias("cell")).groupBy("cell").agg(F.sum((F.col("home") == F.col("cell")).cast("long")).alias("homes"), F.count(F.lit(1)).alias("rows"))
    grid = counts.select("cell", F.ceil(F.greatest("homes", F.lit(1)) / block).alias("nl"), F.ceil(F.col("rows") / block).alias("nr"))
    grid = scratch.put(grid.where("nl > 0"), "grid")
    h = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30))
    all_rows = placed.select("vec_id", "embedding", "m", "home", "cells", F.explode("cells").alias("cell")).join(grid, "cell")
    left = all_rows.where("home = cell").select("*", F.pmod(h, F.col("nl")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1)).alias("j"), F.lit(True).alias("is_left"))
    right = all_rows.select("*", F.pmod(h, F.col("nr")).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nl") - 1)).alias("i"), F.lit(False).alias("is_left"))
    cols = ["cell", "i", "j", "is_left", "vec_id", "embedding", "m", "home", "cells"]
    tasks = left.select(cols).unionByName(right.select(cols))

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(key[0])
        a, b = pdf[pdf["is_left"]], pdf[~pdf["is_left"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"vec_id": [], "n": [], "root": []})
        ids = np.unique(pdf["vec_id"].to_numpy())
        ia, ib = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        xa, xb = (_unit(np.array(t["embedding"].tolist(), float)) for t in (a, b))
        hb = b["home"].to_numpy()
        ma, mb = a["m"].to_numpy(), b["m"].to_numpy()
        pa_ = np.full((len(a), max(map(len, a["cells"]))), -(1 << 62))
        for r, t in enumerate(a["cells"]):
            pa_[r, : len(t)] = t
        count = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        step = max(1, (1 << 23) // (len(b) * pa_.shape[1]))
        for at in range(0, len(a), step):
            i, j = np.nonzero(xa[at : at + step] @ xb.T >= threshold)
            i += at
            at_home = hb[j] == cell
            # A pair is counted once: of two at home where the left id is less; of a visitor unless the
            # other one also visits its home and that cell comes first.
            good = ia[i] < ib[j]
            visit = np.flatnonzero(~at_home)
            good[visit] = ~(pa_[i[visit]] == hb[j[visit]][:, None]).any(axis=1) | (cell < hb[j[visit]])
            i, j = i[good], j[good]
            if len(i):
                p, q = np.searchsorted(ids, ia[i]), np.searchsorted(ids, ib[j])
                np.add.at(count, p, mb[j])
                np.add.at(count, q, ma[i])
                label = _min_labels(len(ids), np.concatenate((p, np.arange(len(ids)))), np.concatenate((q, label)))
        some = count > 0
        return pd.DataFrame({"vec_id": ids[some], "n": count[some], "root": ids[label[some]]})

    # Each task's rows are at most two blocks; groups are dealt over all executors.
    found = scratch.put(tasks.groupBy("cell", "i", "j").applyInPandas(compare, "vec_id long, n long, root long"), "found")
    joined = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")), scratch)
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    # A vector's links are those of its class's least one, and the others of its class.
    of_rep = links.withColumnRenamed("vec_id", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "full")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    out = ids.join(member, "vec_id", "left").join(scratch.put(of_rep, "of_rep"), "rep", "left")
    n_links = F.coalesce("n_links", F.lit(0)) + F.coalesce(F.col("m") - 1, F.lit(0))
    out = out.select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
