"""Ranking metrics and recommendation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .sampling import cumulated, numbered_within, uniform


def list_metrics(df: DataFrame, ks=(5, 10), group: str = "grp", score: str = "score", label: str = "label", weight: str = "weight", tie: str = "item") -> DataFrame:
    """(group, weight, ndcg@k, recall@k as columns ndcg_k, recall_k) of lists with a positive.

    Ranks by score, ties by `tie`, then irrelevant ones first; the list's weight is the largest of its positives, 1 if not positive."""
    rel = (F.col(label) >= 0.5).cast("int")
    by_score = Window.partitionBy(group).orderBy(F.desc(score), tie, rel)
    d = df.select(group, weight, rel.alias("rel"), F.row_number().over(by_score).alias("r"), F.row_number().over(Window.partitionBy(group).orderBy(rel.desc(), tie)).alias("ideal"))
    aggs = [F.sum("rel").alias("n"), F.max(F.when(F.col("rel") == 1, F.col(weight))).alias("w")]
    gain = lambda pos: F.col("rel") / F.log2(F.col(pos) + 1.0)
    for k in ks:
        aggs += [F.sum(F.when(F.col("r") <= k, gain("r"))).alias(f"dcg_{k}"), F.sum(F.when(F.col("ideal") <= k, gain("ideal"))).alias(f"idcg_{k}"), F.sum(F.when(F.col("r") <= k, F.col("rel"))).alias(f"hit_{k}")]
    g = d.groupBy(group).agg(*aggs).where("n > 0")
    w = F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)
    return g.select(group, w.alias("weight"), *[F.round(F.col(f"dcg_{k}") / F.col(f"idcg_{k}"), 9).alias(f"ndcg_{k}") for k in ks], *[F.round(F.least(F.lit(1.0), F.col(f"hit_{k}") / F.col("n")), 9).alias(f"recall_{k}") for k in ks])


def weighted_mean(metrics: DataFrame, ks=(5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    cols = [f"{m}_{k}" for m in ("ndcg", "recall") for k in ks]
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("lists"), *[F.round(F.sum(F.col(c) * F.col("weight")) / F.sum("weight"), 6).alias(c) for c in cols])


def ranking_metrics(df: DataFrame, train: DataFrame, ks=(5, 10), group: str = "grp", user: str = "user", item: str = "item") -> DataFrame:
    """(part, lists, metrics) for all lists, and for warm, user_cold and item_cold ones, judged by the
    list's positive: whether its user and item occur in train."""
    m = list_metrics(df, ks, group, tie=item)
    first = df.where(F.col("label") >= 0.5).groupBy(group).agg(F.min_by(user, item).alias("_u"), F.min(item).alias("_i"))
    users, items = train.select(F.col(user).alias("_u")).distinct().withColumn("_ku", F.lit(True)), train.select(F.col(item).alias("_i")).distinct().withColumn("_ki", F.lit(True))
    d = m.join(first, group).join(users, "_u", "left").join(items, "_i", "left")
    part = F.when(F.col("_ku").isNull(), "user_cold").when(F.col("_ki").isNull(), "item_cold").otherwise("warm")
    both = d.withColumn("part", F.explode(F.array(F.lit("all"), part)))
    return weighted_mean(both, ks, ("part",))


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row (auc): rank sum with mean ranks for ties; 0 with one class only. Scores are first summed by
    value, so ties need no pairs; the ranks come from counts cumulated over range partitions."""
    by = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    ranked = cumulated(by, "n", F.col(score), name="_to").select("p", "n", (F.col("_to") - F.col("n")).alias("below"))
    s = ranked.agg(F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    return s.select(F.when((F.col("p") > 0) & (neg > 0), F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg), 9)).otherwise(0.0).alias("auc"))


def popularity_baseline(lists: DataFrame, counts: DataFrame, ks=(5, 10), group: str = "grp", item: str = "item") -> DataFrame:
    """weighted_mean of lists scored by counts (item, cnt); unknown items 0."""
    d = lists.join(counts.select(item, F.col("cnt").cast("double").alias("score")), item, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return weighted_mean(list_metrics(d, ks, group, tie=item), ks)


def random_baseline(lists: DataFrame, ks=(5, 10), seed: int = 42, group: str = "grp", item: str = "item") -> DataFrame:
    d = lists.withColumn("score", uniform(seed, group, item))
    return weighted_mean(list_metrics(d, ks, group, tie=item), ks)


def rank_candidates(df: DataFrame, version: str, generated: Column, days: int = 1, top: int | None = None, keep_unknown: bool = False) -> DataFrame:
    """Candidates (member, anonymous, restaurant, score) with rank from 1 by user key, then only numeric
    restaurants (so ranks can have gaps), and version, generated_at, expires_at."""
    key = R.user_key(F.col("member"), F.col("anonymous"))
    d = df.withColumn("user_key", F.coalesce(key, F.lit("a_")) if keep_unknown else key).where(F.col("user_key").isNotNull())
    if top is None:
        d = numbered_within(d, ("user_key",), F.desc("score"), F.col("restaurant"), name="rank", total="_n").withColumn("rank", F.col("rank").cast("int")).drop("_n")
    else:  # pruned to `top` in each task before the shuffle
        d = d.withColumn("rank", F.row_number().over(Window.partitionBy("user_key").orderBy(F.desc("score"), "restaurant"))).where(F.col("rank") <= top)
    rid = F.trim(F.col("restaurant").cast("string"))
    d = d.where(rid.rlike(r"^\d+$")).withColumn("restaurant", rid.cast("long"))
    return d.withColumns({"pipeline_version": F.lit(version), "generated_at": generated, "expires_at": generated + F.expr(f"INTERVAL {int(days)} DAYS")})


def active_recs(recs: DataFrame, models: DataFrame, limit: int) -> DataFrame:
    """Recommendations of active models, by rank, the first `limit` of each user."""
    d = recs.join(models.where("status = 'ACTIVE'").select("pipeline_version"), "pipeline_version", "left_semi")
    return d.withColumn("_rn", F.row_number().over(Window.partitionBy("user_key").orderBy("rank"))).where(F.col("_rn") <= limit).drop("_rn")
