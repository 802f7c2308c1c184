"""Operational metrics over request logs and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import cumulated_within


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def index_percentile(df: DataFrame, value: str, ps: tuple[int, ...], by: tuple[str, ...] = (), spread: bool | None = None) -> DataFrame:
    """(*by, p<p>…): the element at floor(n * p / 100), at most n - 1, of the sorted values; nulls are left out.

    Values are counted first; a value holds the places from its cumulated count on, so no group is
    gathered in a list. spread: counts are cumulated over range partitions, for groups with more distinct values
    than one task should order; by default where there is no `by`."""
    v = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    if not by if spread is None else spread:
        v = cumulated_within(v, by, F.col("_c"), F.col(value), name="_hi", total="_n")
    else:
        part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        v = v.withColumn("_hi", F.sum("_c").over(part.orderBy(value))).withColumn("_n", F.sum("_c").over(part))
    at = lambda p: F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)
    return v.groupBy(*by).agg(*[F.min(F.when(F.col("_hi") > at(p), F.col(value))).alias(f"p{p}") for p in ps])


def perf_stats(df: DataFrame, now: Column, days: int, by: str = "kind") -> DataFrame:
    """(kind, requests, avg_ms, tokens, errors, error_rate) of the last days; types: ms, tokens, error_count."""
    recent = df.where((F.col("ts") > now - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("ts") <= now))
    return recent.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("ms"), 4).alias("avg_ms"), F.sum("tokens").alias("tokens"), F.sum("error_count").alias("errors"), F.round(F.sum("error_count") / F.count(F.lit(1)), 6).alias("error_rate"))


def perf_stats_ext(df: DataFrame, by: str = "kind") -> DataFrame:
    bad = F.sum((F.col("error_count") > 0).cast("int"))
    n = F.count(F.lit(1))
    return df.groupBy(by).agg(n.alias("requests"), F.min("ms").alias("min_ms"), F.round(F.avg("ms"), 4).alias("avg_ms"), F.max("ms").alias("max_ms"), F.min("tokens").alias("min_tokens"), F.round(F.avg("tokens"), 4).alias("avg_tokens"), F.max("tokens").alias("max_tokens"), F.round(100 * bad / n, 4).alias("error_pct"), F.round(100 - 100 * bad / n, 4).alias("success_pct"))


def latest(df: DataFrame, n: int, ts: str = "ts", key: str = "id") -> DataFrame:
    """The latest n rows (a top-n, pruned in each task before the shuffle)."""
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


def latency_stats(df: DataFrame, n: int) -> DataFrame:
    """Mean, P95 and P99 of ttft and tps over the latest n rows, one row."""
    d = latest(df, n)
    out = d.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("ttft"), 6).alias("avg_ttft"), F.round(F.avg("tps"), 6).alias("avg_tps"))
    for c in ("ttft", "tps"):
        p = index_percentile(d, c, (95, 99), spread=False)  # of n rows
        out = out.crossJoin(F.broadcast(p.select(F.col("p95").alias(f"{c}_p95"), F.col("p99").alias(f"{c}_p99"))))
    return out


def goodput(df: DataFrame, sla_ms: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Throughput and goodput in tokens a second, compliance weighted by tokens and by requests, mean ttft."""
    met = F.col("ttft") < sla_ms
    s = df.groupBy(*by).agg(F.sum("ms").alias("_ms"), F.sum("tokens").alias("_t"), F.coalesce(F.sum(F.when(met, F.col("tokens"))), F.lit(0)).alias("_g"), F.count(F.lit(1)).alias("requests"), F.sum(met.cast("int")).alias("met"), F.round(F.avg("ttft"), 6).alias("avg_ttft"))
    per = lambda x, y: F.coalesce(F.round(x / F.nullif(y, F.lit(0)), 4), F.lit(0.0))
    return s.select(*by, "requests", "met", "avg_ttft", per(F.col("_t") * 1000, F.col("_ms")).alias("throughput_tps"), per(F.col("_g") * 1000, F.col("_ms")).alias("goodput_tps"), per(F.col("_g") * 100, F.col("_t")).alias("sla_tokens_pct"), per(F.col("met") * 100, F.col("requests")).alias("sla_requests_pct"))


def goodput_recent(df: DataFrame, n: int, sla_ms: float) -> DataFrame:
    return goodput(latest(df, n), sla_ms)


def goodput_rolling(df: DataFrame, n: int, sla_ms: float, by: str, ts: str = "ts", key: str = "id") -> DataFrame:
    """Each request with the goodput of the n requests up to it, of the same `by`."""
    w = Window.partitionBy(by).orderBy(ts, key).rowsBetween(-(n - 1), 0)
    good = F.sum(F.when(F.col("ttft") < sla_ms, F.col("tokens")).otherwise(0)).over(w)
    return df.withColumn("goodput_tps", F.coalesce(F.round(good * 1000 / F.nullif(F.sum("ms").over(w), F.lit(0)), 4), F.lit(0.0)))


def load_summary(df: DataFrame) -> DataFrame:
    """One row over (ts, ms, status): counts by class, success rate, latency figures of successes, throughput."""
    ok = F.col("status").between(200, 299)
    d = df.agg(F.count(F.lit(1)).alias("total"), F.sum(ok.cast("int")).alias("success"), F.sum(F.col("status").between(400, 499).cast("int")).alias("errors_4xx"), F.sum((F.col("status") >= 500).cast("int")).alias("errors_5xx"), F.round(F.avg(F.when(ok, F.col("ms"))), 4).alias("avg_ms"), F.min(F.when(ok, F.col("ms"))).alias("min_ms"), F.max(F.when(ok, F.col("ms"))).alias("max_ms"), (_us(F.max("ts")) - _us(F.min("ts"))).alias("_us"))
    p = index_percentile(df.where(ok), "ms", (50, 95, 99))
    return d.withColumn("success_rate", F.round(100 * F.col("success") / F.col("total"), 4)).withColumn("throughput", F.round(F.col("success") * 1e6 / F.nullif(F.col("_us"), F.lit(0)), 6)).drop("_us").crossJoin(F.broadcast(p))


def bench_summary(df: DataFrame, by: str = "mode") -> DataFrame:
    """(mode, n, mean, median, std, p95, p99, per_second) of ms, with items processed a second."""
    s = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 4).alias("mean"), F.round(F.median("ms"), 4).alias("median"), F.round(F.coalesce(F.stddev_samp("ms"), F.lit(0.0)), 4).alias("std"), F.round(F.sum("items") * 1000 / F.nullif(F.sum("ms"), F.lit(0)), 4).alias("per_second"))
    return s.join(index_percentile(df, "ms", (95, 99), (by,)), by)


def compare_modes(summary: DataFrame, baseline: str, by: str = "mode") -> DataFrame:
    """Improvement of latency and throughput over the baseline mode, in percent."""
    b = summary.where(F.col(by) == baseline).select(F.col("mean").alias("_m"), F.col("per_second").alias("_t"))
    d = summary.crossJoin(F.broadcast(b))
    return d.select(by, F.round((F.col("_m") - F.col("mean")) / F.nullif(F.col("_m"), F.lit(0)) * 100, 4).alias("latency_gain"), F.round((F.col("per_second") - F.col("_t")) / F.nullif(F.col("_t"), F.lit(0)) * 100, 4).alias("throughput_gain"))


def run_status(df: DataFrame) -> DataFrame:
    """(run, total, done, failed, completed) from job rows (run, state)."""
    n = lambda s: F.sum((F.col("state") == s).cast("int"))
    return df.groupBy("run").agg(F.count(F.lit(1)).alias("total"), n("done").alias("done"), n("failed").alias("failed"), ((n("done") + n("failed")) >= F.count(F.lit(1))).alias("completed"))


def should_skip(df: DataFrame, now: Column, minutes: int, by: tuple[str, ...]) -> DataFrame:
    """(*by, last_success, skip): skip where the last row without errors is younger than the interval."""
    last = F.max(F.when(F.col("error_count") == 0, F.col("ts")))
    return df.groupBy(*by).agg(last.alias("last_success")).withColumn("skip", F.coalesce(F.col("last_success") > now - F.expr(f"INTERVAL {int(minutes)} MINUTES"), F.lit(False)))


def max_concurrent(df: DataFrame, ts: str = "ts", by: str = "day") -> DataFrame:
    """(by, most): the most requests in any second that starts at one, within a partition key."""
    us = _us(F.col(ts))
    w = Window.partitionBy(by).orderBy("_us").rangeBetween(0, 999_999)
    return df.withColumn("_us", us).withColumn("_n", F.count(F.lit(1)).over(w)).groupBy(by).agg(F.max("_n").alias("most"))


def actual_rps(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: mean gap in seconds between requests in time order, and its inverse. The gaps sum to the
    last minus the first time, so no ordering is needed."""
    d = df.agg((_us(F.max(ts)) - _us(F.min(ts))).alias("us"), F.count(ts).alias("n"))
    gap = F.col("us") / 1e6 / F.nullif(F.col("n") - 1, F.lit(0))
    return d.select(F.round(gap, 6).alias("mean_gap"), F.round(1 / F.nullif(gap, F.lit(0.0)), 6).alias("rps"))


def score_bands(df: DataFrame, score: str = "score") -> DataFrame:
    """(band, rows, ambiguous): [0, .3) [.3, .5) [.5, .8) [.8, 1]; the middle two are ambiguous."""
    c = F.col(score)
    band = F.when(c < 0.3, "0.0-0.3").when(c < 0.5, "0.3-0.5").when(c < 0.8, "0.5-0.8").otherwise("0.8-1.0")
    return df.where(c.isNotNull()).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("rows")).withColumn("ambiguous", F.col("band").isin("0.3-0.5", "0.5-0.8"))


def dataset_stats(df: DataFrame, split: str, key: str, columns: list[str], n: int = 100) -> DataFrame:
    """(split, rows, hash): hash of the first n rows of each split by key."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"))
    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(split).orderBy(key))).where(F.col("_rn") <= n)
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    h = first.groupBy(split).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rn", text.alias("t")))), lambda x: x["t"]), "\n"), 256).alias("hash"))
    return counts.join(h, split)
