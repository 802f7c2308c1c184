"""The nearest documents of queries within groups of rows: the kernel of exact and of indexed search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import shipped

#: Scores of a task at once.
CELLS = 1 << 22


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def top_of_rows(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, in order, ties by column."""
    if s.shape[1] > 4 * k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        i, j = np.nonzero(s >= least[:, None])
    else:
        i, j = (x.ravel() for x in np.indices(s.shape))
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, np.arange(s.shape[0]))
    keep = np.arange(len(i)) - first[i] < k
    return i[keep], j[keep]


def nearest(queries: DataFrame, docs: DataFrame, keys: list[str], by: list[str], k: int, min_score: float = -1.0, digits: int = 9, others_only: bool = False, most: int = 2048) -> DataFrame:
    """(*by, query, doc, score): the k best docs (*keys, doc, vector) of each query (*keys, query, vector) among
    those with equal keys, by cosine in double precision, rounded, ties by doc. `by` are some of the keys.

    Both sides are shuffled by the keys, once. A task holds the documents of one group at a time, which come
    first and in order, and streams the queries past them; so the groups' documents must be bounded, the
    queries need not be. Vectors of different lengths do not meet; those that are null or hold a null are left out."""
    shipped(queries.sparkSession)
    whole = lambda t: t.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()) & (F.size("vector") > 0))
    none = lambda t, c: F.lit(None).cast(t.schema[c].dataType).alias(c)
    vector = F.col("vector").cast("array<double>").alias("vector")
    d = whole(docs.select(*keys, F.lit(0).alias("_kind"), "doc", none(queries, "query"), vector))
    q = whole(queries.select(*keys, F.lit(1).alias("_kind"), none(docs, "doc"), "query", vector)).where("query IS NOT NULL")
    rows = d.unionByName(q).withColumn("_dim", F.size("vector"))
    group = [*keys, "_dim"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, "_kind", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, x = None, [], [], None
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            marks = list(zip(*(columns[c].to_pylist() for c in group), columns["_kind"].to_pylist()))
            at = 0
            for mark, run in groupby(marks):
                n = sum(1 for _ in run)
                part = {c: a.slice(at, n) for c, a in columns.items()}
                at += n
                if mark[:-1] != now:
                    now, held, ids, x = mark[:-1], [], [], None
                if mark[-1] == 0:
                    held.append(unit(matrix(part["vector"])))
                    ids.append(part["doc"])
                    continue
                if not held:
                    continue
                if x is None:
                    x, ids = np.concatenate(held), pa.concat_arrays(ids)
                names = None
                y = unit(matrix(part["vector"]))
                size = min(most, max(1, CELLS // len(x)))
                for low in range(0, n, size):
                    some = y[low : low + size]
                    s = np.round(some @ x.T, digits)
                    mine = part["query"].slice(low, len(some))
                    if others_only:
                        names = ids.to_numpy(zero_copy_only=False) if names is None else names
                        s[mine.to_numpy(zero_copy_only=False)[:, None] == names[None, :]] = -np.inf
                    i, j = top_of_rows(s, k)
                    good = s[i, j] >= min_score
                    i, j = i[good], j[good]
                    out = {c: pa.array([v], batch.schema.field(c).type).take(pa.array(np.zeros(len(i), np.int64))) for c, v in zip(group, now) if c in by}
                    yield pa.RecordBatch.from_pydict({**{c: out[c] for c in by}, "query": mine.take(pa.array(i)), "doc": ids.take(pa.array(j)), "score": pa.array(s[i, j])})

    kind = lambda t, c: f"`{c}` {t.schema[c].dataType.simpleString()}"
    return rows.mapInArrow(run, ", ".join([*(kind(rows, c) for c in by), kind(queries, "query"), kind(docs, "doc"), "score double"]))
