"""Connected components on Spark by alternating large-star and small-star rounds
(Kiveris et al., "Connected components in MapReduce and beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(e: DataFrame):
    return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _to_min(e: DataFrame, scratch: Scratch, name: str, rows: int | None) -> DataFrame:
    """The edges with the least neighbour of u. The minima are a stored table, so both sides of the
    join are plain shuffles, of which adaptive execution splits the parts that a hub makes large."""
    mins = scratch.put(e.groupBy("u").agg(F.min("v").alias("m")), name, rows)
    return e.join(mins, "u")


def components(edges: DataFrame, scratch: Scratch, rows: int | None = None, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is its least reachable node.
    rows: a bound on the nodes, by which the tables in between are cut into files."""
    flat = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    e = scratch.put(flat.where("u <> v").distinct(), "cc0", rows)
    state = _state(e)
    for k in range(1, rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_min(both, scratch, f"cc{k}m", rows).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = scratch.put(large.where("u <> v").distinct(), f"cc{k}l", rows)
        near = _to_min(large, scratch, f"cc{k}n", rows)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        after = scratch.put(small.where("u <> v").distinct(), f"cc{k}", rows)
        then = _state(after)
        scratch.drop(f"cc{k - 1}", f"cc{k}m", f"cc{k}l", f"cc{k}n")
        e = after
        if then == state:
            break
        state = then
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("u")).distinct()
    return e.unionByName(roots.select("u", F.col("u").alias("v"))).select(F.col("u").alias("node"), F.col("v").alias("component"))
