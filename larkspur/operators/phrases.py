"""Phrase statistics: counts of words and neighbouring pairs, aspect classes, positive ratios, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import Scratch
from .sampling import numbered, uniform


def word_counts(df: DataFrame, text: str = "text", stop=(), min_len: int = 2) -> DataFrame:
    """(word, cnt)."""
    return df.select(F.explode(T.tokens(F.col(text), stop, min_len)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def bigram_counts(df: DataFrame, text: str = "text", by: tuple[str, ...] = (), stop=(), tokens: Column | None = None) -> DataFrame:
    """(*by, phrase, cnt). `tokens` plugs in another tokeniser as an array column."""
    words = T.tokens(F.col(text), stop) if tokens is None else tokens
    return df.select(*by, F.explode(T.bigrams(words)).alias("phrase")).groupBy(*by, "phrase").agg(F.count(F.lit(1)).alias("cnt"))


def top_phrases(counts: DataFrame, n: int = 2000, by: tuple[str, ...] = (), key: str = "phrase") -> DataFrame:
    """The n most frequent, ties by name; per group when `by` is given (Spark prunes groups before the shuffle)."""
    if not by:
        return counts.orderBy(F.desc("cnt"), key).limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc("cnt"), key)
    return counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def classify(counts: DataFrame, keywords: dict) -> DataFrame:
    """One row for each class of a phrase, column `category`."""
    return counts.withColumn("category", F.explode(T.phrase_classes(F.col("phrase"), keywords)))


def category_totals(counts: DataFrame, keywords: dict, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, category, total, phrases)."""
    return classify(counts, keywords).groupBy(*by, "category").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("phrases"))


def _ratio(part: Column, whole: Column, digits: int) -> Column:
    return F.coalesce(F.bround(part / F.nullif(whole, F.lit(0)), digits), F.lit(0.0))


def positive_ratios(counts: DataFrame, keywords: dict, positive: dict, by: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """(*by, <class>_total, <class>_pos, <class>_ratio): shares of positive phrases, 0 for an empty class.

    positive: class → (whole words, substrings)."""
    aggs = []
    for name in positive:
        mine = T.contains_any(F.col("phrase"), keywords[name])
        good = mine & T.is_positive(F.col("phrase"), *positive[name])
        aggs += [F.coalesce(F.sum(F.when(mine, F.col("cnt"))), F.lit(0)).alias(f"{name}_total"), F.coalesce(F.sum(F.when(good, F.col("cnt"))), F.lit(0)).alias(f"{name}_pos")]
    out = counts.groupBy(*by).agg(*aggs)
    for name in positive:
        out = out.withColumn(f"{name}_ratio", _ratio(F.col(f"{name}_pos"), F.col(f"{name}_total"), digits))
    return out


def category_share(counts: DataFrame, keywords: dict) -> DataFrame:
    """(category, total, share in percent, 2 decimals) of the phrases in a class."""
    t = category_totals(counts, keywords).where("category <> 'other'")
    return t.select("category", "total", F.bround(100.0 * F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(0))), 2).alias("share"))


def quantile_split(counts: DataFrame, by: tuple[str, ...] = (), head: float = 0.02, mid: float = 0.2, min_head: int = 10) -> DataFrame:
    """Adds pos (rank from 1) and part: head, mid or tail."""
    order = (F.desc("cnt"), F.col("phrase"))
    if by:
        ranked = counts.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    else:
        ranked = numbered(counts, *order).withColumn("pos", F.col("pos").cast("int"))
        ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("_n"))))
    n = F.col("_n")
    head_n = F.greatest(F.lit(min_head), F.least(F.floor(n * F.lit(head)), n))
    mid_n = F.greatest(head_n, F.least(F.floor(n * F.lit(mid)), n))
    return ranked.withColumn("part", F.when(F.col("pos") <= head_n, "head").when(F.col("pos") <= mid_n, "mid").otherwise("tail")).drop("_n")


def pick_seeds(split: DataFrame, by: tuple[str, ...] = (), mid_k: int = 5, tail_k: int = 1, seed: int = 42) -> DataFrame:
    """All of head, mid_k of mid drawn by weight ln(cnt + 1) without replacement, tail_k of tail.

    Weighted draws by the keys -ln(u) / weight, smallest first, with u from a hash of seed and phrase, so
    the same seeds come out whatever the partitions."""
    u = uniform(seed, "phrase")
    key = F.when(F.col("part") == "mid", -F.log(u) / F.log(F.col("cnt") + 1.0)).otherwise(u)
    w = Window.partitionBy(*by, "part").orderBy("_key", "phrase")
    drawn = split.withColumn("_key", key).withColumn("_rn", F.row_number().over(w))
    return drawn.where((F.col("part") == "head") | ((F.col("part") == "mid") & (F.col("_rn") <= mid_k)) | ((F.col("part") == "tail") & (F.col("_rn") <= tail_k))).drop("_key", "_rn")


def merge_reversed(phrases: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """"a b" and "b a" counted together under the spelling that stands first (least pos)."""
    pair = F.array_sort(F.split("phrase", " "))
    out = phrases.withColumn("_pair", pair).groupBy(*by, "_pair").agg(F.min_by("phrase", "pos").alias("phrase"), F.sum("cnt").alias("cnt"), F.min("pos").alias("pos"))
    return out.drop("_pair")


def recall_seeds(df: DataFrame, keywords: dict, by: tuple[str, ...] = (), text: str = "text", n: int = 2000, seed: int = 42) -> DataFrame:
    """Seeds for each class (and group): counts, top n, classes, split, draw, reversed pairs merged."""
    top = top_phrases(bigram_counts(df, text, by), n, by)
    group = (*by, "category")
    return merge_reversed(pick_seeds(quantile_split(classify(top, keywords), group), group, seed=seed), group)


def compare(df: DataFrame, keywords: dict, positive: dict, by: str = "source", text: str = "text", n: int = 2000) -> DataFrame:
    """Every group against the corpus: ratios (2 decimals), lift in whole percent, display lines.

    One pass over the texts gives a stored table of counts per group; the corpus counts are their sums."""
    counts = Scratch(df.sparkSession, "compare").put(bigram_counts(df, text, (by,)), "counts")
    own = positive_ratios(top_phrases(counts, n, (by,)), keywords, positive, (by,), 2)
    corpus = counts.groupBy("phrase").agg(F.sum("cnt").alias("cnt"))
    total = positive_ratios(top_phrases(corpus, n), keywords, positive, (), 4)
    size = df.where(F.length(F.col(text)) > 0).groupBy(by).agg(F.count(F.lit(1)).alias("n_reviews"))
    out = own.join(size, by).crossJoin(F.broadcast(total.select(*[F.col(f"{k}_ratio").alias(f"all_{k}") for k in positive])))
    for k in positive:
        out = out.withColumn(f"lift_{k}", lift(F.col(f"{k}_ratio"), F.col(f"all_{k}")))
        out = out.withColumn(f"line_{k}", comparison_line(k, F.col(f"lift_{k}"), F.col("n_reviews")))
    return out.select(by, "n_reviews", *[f"{k}_ratio" for k in positive], *[f"all_{k}" for k in positive], *[f"lift_{k}" for k in positive], *[f"line_{k}" for k in positive])


def lift(single: Column, total: Column) -> Column:
    """(single - total) / total * 100, half-even to a whole number; 0 where the total is not positive."""
    return F.coalesce(F.when(total > 0, F.bround((single - total) / total * 100, 0).cast("long")), F.lit(0).cast("long"))


def tone(n: Column) -> Column:
    return F.when(n >= 50, "good").when(n >= 20, "rather good").otherwise("a tendency, with few reviews")


def comparison_line(label: str, lift_pct: Column, n: Column) -> Column:
    better = F.concat(F.lit(f"{label}: about "), lift_pct.cast("string"), F.lit("% above average; rated "), tone(n))
    return F.when(lift_pct > 0, better).otherwise(F.lit(f"{label}: about average"))


def default_description(label: str, lift_pct: Column) -> Column:
    return F.when(lift_pct > 0, F.concat(F.lit(f"{label} is "), lift_pct.cast("string"), F.lit("% higher than average"))).when(lift_pct < 0, F.concat(F.lit(f"{label} is "), F.abs(lift_pct).cast("string"), F.lit("% lower than average"))).otherwise(F.lit(f"{label} is close to average"))


def multiple(single: Column, total: Column) -> Column:
    """How many times the total, 2 decimals; null where the total is not positive."""
    return F.when(total > 0, F.bround(single / total, 2))


def positive_lift_only(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(…, category, lift): a row for each category whose lift is above 0, largest first."""
    ids = [c for c in df.columns if c not in columns.values()]
    return df.unpivot(ids, list(columns.values()), "category", "lift").where("lift > 0").orderBy(F.desc("lift"), *ids, "category")
