"""Evaluation of predictions against truth: sentiment, retrieval, aspects, generated text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..scratch import shipped


def sentiment_ratios(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    """(by, total, positive, negative, neutral, ratios): percent of positive + negative, neutral of all, half-even."""
    n = lambda s: F.sum((F.col(label) == s).cast("int"))
    d = df.where(F.col(label).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("total"), n("positive").alias("positive"), n("negative").alias("negative"), n("neutral").alias("neutral"))
    pct = lambda x, y: F.coalesce(F.bround(100.0 * F.col(x) / F.nullif(y, F.lit(0)), 0).cast("long"), F.lit(0).cast("long"))
    both = F.col("positive") + F.col("negative")
    return d.select("*", pct("positive", both).alias("positive_ratio"), pct("negative", both).alias("negative_ratio"), pct("neutral", F.col("total")).alias("neutral_ratio"))


def rating_truth(df: DataFrame, by: str, positive: Column) -> DataFrame:
    """(by, positive_count, negative_count, ratios with 1 decimal in percent)."""
    d = df.groupBy(by).agg(F.sum(positive.cast("int")).alias("positive_count"), F.sum((~positive).cast("int")).alias("negative_count"))
    n = F.col("positive_count") + F.col("negative_count")
    return d.select("*", F.round(100.0 * F.col("positive_count") / n, 1).alias("positive_pct"), F.round(100.0 * F.col("negative_count") / n, 1).alias("negative_pct"))


def confusion(pred: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(class, tp, fp, fn, tn, precision, recall, f1, accuracy) over ids in both; columns pred and truth."""
    d = pred.select(key, "pred").join(truth.select(key, "truth"), key).where("pred IS NOT NULL AND truth IS NOT NULL")
    d = d.withColumn("class", F.explode(F.array(F.lit("positive"), F.lit("negative"))))
    p, t = F.col("pred") == F.col("class"), F.col("truth") == F.col("class")
    c = lambda x: F.sum(x.cast("int"))
    g = d.groupBy("class").agg(c(p & t).alias("tp"), c(p & ~t).alias("fp"), c(~p & t).alias("fn"), c(~p & ~t).alias("tn"))
    div = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))
    pr, rc = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("*", pr.alias("precision"), rc.alias("recall"), div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"))


def ratio_errors(pred: DataFrame, truth: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, <column>_error) absolute errors, for the keys in both."""
    d = pred.alias("p").join(truth.alias("t"), key)
    return d.select(key, *[F.abs(F.col(f"p.{c}") - F.col(f"t.{c}")).alias(f"{c}_error") for c in columns])


def mean_errors(errors: DataFrame, key: str) -> DataFrame:
    """One row: means of the error columns, and of them all (mae)."""
    cols = [c for c in errors.columns if c != key]
    total = F.lit(0.0)
    for c in cols:
        total = total + F.avg(c)
    return errors.agg(*[F.round(F.avg(c), 6).alias(c) for c in cols], F.round(total / len(cols), 6).alias("mae"))


def precision_recall_at_k(hits: DataFrame, truth: DataFrame, ks=(1, 3, 5, 10), query: str = "query", doc: str = "doc") -> DataFrame:
    """(k, precision, recall, precision_all, queries): means over queries with hits, and precision over all
    queries of the truth, those without hits counting 0."""
    rel = truth.select(query, F.col(doc).alias("_d")).distinct()
    n = rel.groupBy(query).agg(F.count(F.lit(1)).alias("_n"))
    d = hits.join(rel, (hits[query] == rel[query]) & (hits[doc] == F.col("_d")), "left").select(hits[query], "rank", F.col("_d").isNotNull().cast("int").alias("rel"))
    d = d.join(n, query)
    per = d.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).groupBy(query, "k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("rel")).otherwise(0)).alias("hit"), F.first("_n").alias("_n"))
    total = n.agg(F.count(F.lit(1)).alias("_q"))
    p = per.groupBy("k").agg(F.round(F.avg(F.col("hit") / F.col("k")), 6).alias("precision"), F.round(F.avg(F.col("hit") / F.col("_n")), 6).alias("recall"), F.sum(F.col("hit") / F.col("k")).alias("_s"), F.count(F.lit(1)).alias("queries"))
    return p.crossJoin(F.broadcast(total)).select("k", "precision", "recall", F.round(F.col("_s") / F.col("_q"), 6).alias("precision_all"), "queries")


def model_table(df: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """(model, p1, p3, …) from (model, k, precision)."""
    return df.groupBy("model").pivot("k", list(ks)).agg(F.first("precision")).select("model", *[F.col(f"`{k}`").alias(f"p{k}") for k in ks])


def best_model_per_k(df: DataFrame) -> DataFrame:
    """(k, model, precision): the best of each k, ties by name."""
    b = df.groupBy("k").agg(F.min(F.struct((-F.col("precision")).alias("o"), F.col("model").alias("m"))).alias("b"))
    return b.select("k", F.col("b.m").alias("model"), (-F.col("b.o")).alias("precision"))


def best_run(df: DataFrame) -> DataFrame:
    """The run with the least loss, under either spelling of the column, ties by name."""
    loss = F.coalesce("eval_loss", F.col("`eval/loss`"))
    return df.where(loss.isNotNull()).agg(F.min_by("run", F.struct(loss, "run")).alias("run"), F.min(loss).alias("loss"))


def set_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of intersection and union of two arrays."""
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def aspect_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def strength_at_k(pred: DataFrame, truth: DataFrame, ks=(1, 3, 5), key: str = "entity") -> DataFrame:
    """(k, precision, recall) of predicted aspects (entity, rank, aspect) against truth (entity, aspect)."""
    t = truth.select(key, aspect_key(F.col("aspect")).alias("a")).distinct()
    n = t.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    d = pred.select(key, "rank", aspect_key(F.col("aspect")).alias("a")).join(t.withColumn("_t", F.lit(1)), [key, "a"], "left")
    per = d.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k").groupBy(key, "k").agg(F.sum(F.coalesce("_t", F.lit(0))).alias("hit"), F.count_distinct(F.when(F.col("_t") == 1, F.col("a"))).alias("found"))
    return per.join(n, key).groupBy("k").agg(F.round(F.avg(F.col("hit") / F.col("k")), 6).alias("precision"), F.round(F.avg(F.col("found") / F.col("_n")), 6).alias("recall"))


def aspect_coverage(pred: DataFrame, truth: DataFrame, key: str = "entity") -> DataFrame:
    """(entity, matched, precision, recall, f1) of the aspect sets; entities of the truth."""
    s = lambda d, name: d.select(key, aspect_key(F.col("aspect")).alias("a")).distinct().withColumn(name, F.lit(1))
    d = s(truth, "_t").join(s(pred, "_p"), [key, "a"], "full").groupBy(key).agg(F.count("_t").alias("t"), F.count("_p").alias("p"), F.sum(F.coalesce(F.col("_t") * F.col("_p"), F.lit(0))).alias("matched")).where("t > 0")
    div = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))
    return d.select(key, "matched", div(F.col("matched"), F.col("p")).alias("precision"), div(F.col("matched"), F.col("t")).alias("recall"), div(2 * F.col("matched"), F.col("t") + F.col("p")).alias("f1"))


def false_positive_rate(pred: DataFrame, truth: DataFrame, key: str = "entity") -> DataFrame:
    """(entity, rate): share of predicted aspects that the truth lacks."""
    p = pred.select(key, aspect_key(F.col("aspect")).alias("a")).distinct()
    t = truth.select(key, aspect_key(F.col("aspect")).alias("a")).distinct().withColumn("_t", F.lit(1))
    return p.join(t, [key, "a"], "left").groupBy(key).agg(F.round(F.sum(F.col("_t").isNull().cast("int")) / F.count(F.lit(1)), 6).alias("rate"))


def evidence_overlap(pred: DataFrame, truth: DataFrame, top: int = 5, key: str = "entity") -> DataFrame:
    """(entity, aspect, precision, recall, f1, overlap) of evidence id arrays of matched aspects, for the
    first `top` predictions."""
    p = pred.where(F.col("rank") <= top).select(key, aspect_key(F.col("aspect")).alias("aspect"), F.col("evidence").alias("pe"))
    t = truth.select(key, aspect_key(F.col("aspect")).alias("aspect"), F.col("evidence").alias("te"))
    inter, union = set_overlap(F.col("pe"), F.col("te"))
    div = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))
    n, m = F.size(F.array_distinct("pe")), F.size(F.array_distinct("te"))
    return p.join(t, [key, "aspect"]).select(key, "aspect", div(inter, n).alias("precision"), div(inter, m).alias("recall"), div(2 * inter, n + m).alias("f1"), div(inter, union).alias("overlap"))


def _ngrams(c: Column, n: int) -> Column:
    """Runs of n words as texts."""
    size = F.size(c)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(c, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def _matches(df: DataFrame, a: str, b: str, key: str, n: int) -> DataFrame:
    """(key, match, na, nb) of the n-gram multisets."""
    count = lambda c, name: df.select(key, F.explode(_ngrams(F.col(c), n)).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias(name))
    both = count(a, "ca").join(count(b, "cb"), [key, "g"]).groupBy(key).agg(F.sum(F.least("ca", "cb")).alias("match"))
    sizes = df.select(key, F.greatest(F.size(a) - (n - 1), F.lit(0)).alias("na"), F.greatest(F.size(b) - (n - 1), F.lit(0)).alias("nb"))
    return sizes.join(both, key, "left").withColumn("match", F.coalesce("match", F.lit(0)))


WORDS, ASCII_WORDS = r"(?U)\w+", r"[a-z0-9]+"


def rouge(df: DataFrame, pred: str, ref: str, key: str, ascii_only: bool = False) -> DataFrame:
    """(key, rouge1, rouge2) F values over lower-cased word tokens; Unicode words by default."""
    p = F.lit(ASCII_WORDS if ascii_only else WORDS)
    t = df.select(key, *[F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), p, F.lit(0)).alias(n) for c, n in ((pred, "a"), (ref, "b"))])
    out = None
    for n in (1, 2):
        m = _matches(t, "a", "b", key, n)
        f = m.select(key, F.coalesce(F.round(2 * F.col("match") / F.nullif(F.col("na") + F.col("nb"), F.lit(0)), 6), F.lit(0.0)).alias(f"rouge{n}"))
        out = f if out is None else out.join(f, key)
    return out


def lcs_length(u: list, v: list) -> int:
    """Length of the longest common subsequence: the table's rows as the bits of one number, a row for each
    entry of u (Hyyro, "Bit-parallel LCS-length computation revisited", 2004)."""
    places: dict = {}
    for k, w in enumerate(v):
        places[w] = places.get(w, 0) | 1 << k
    every = (1 << len(v)) - 1
    row = every
    for w in u:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(v) - row.bit_count()


def rouge_l(df: DataFrame, pred: str, ref: str, key: str) -> DataFrame:
    """(key, rougeL) F value from the longest common subsequence of words, in Arrow batches."""
    shipped(df.sparkSession)

    @F.pandas_udf("double")
    def lcs_f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([2 * lcs_length(list(x), list(y)) / (len(x) + len(y)) if len(x) and len(y) else 0.0 for x, y in zip(a, b)])

    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(WORDS), F.lit(0))
    return df.select(key, F.round(lcs_f(words(pred), words(ref)), 6).alias("rougeL"))


#: Words that are compared at once.
WORDS_AT_ONCE = 1 << 20


def clipped_matches(a: pa.ListArray, b: pa.ListArray, most: int = 4) -> np.ndarray:
    """Of rows of two lists of words: a row of how many of the first's runs of 1, .., most words the second has too, each
    run as often as both have it."""
    n, sizes = len(a), [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    words = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices.to_numpy().astype(np.int64)
    text, first = np.repeat(np.arange(2 * n), np.concatenate(sizes)), int(sizes[0].sum())  # a's texts come first
    out, at, run, distinct = np.zeros((n, most), np.int64), np.arange(len(words)), words, int(words.max(initial=0)) + 1
    for m in range(most):
        if m:
            whole = text[at] == text[np.minimum(at + m, len(words) - 1)] if len(words) else at > 0
            whole &= at + m < len(words)
            at = at[whole]
            run = np.unique(run[whole] * distinct + words[at + m], return_inverse=True)[1]
        size = int(run.max(initial=0)) + 1
        key, mine = text[at] % n * size + run if n else run, at < first
        (x, cx), (y, cy) = (np.unique(key[side], return_counts=True) for side in (mine, ~mine))
        both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        out[:, m] = np.bincount(both // size, np.minimum(cx[i], cy[j]), n) if n else 0
    return out


def bleu(df: DataFrame, pred: str, ref: str, key: str, eps: float = 0.1) -> DataFrame:
    """(key, bleu): up to 4-grams of blank-separated words, zero matches count eps, brevity penalty. Matches are counted
    within the row, in Arrow batches; nothing is shuffled."""
    shipped(df.sparkSession)
    t = df.select(key, *[F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != "").alias(n) for c, n in ((pred, "_a"), (ref, "_b"))])
    names = ["m1", "m2", "m3", "m4"]

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c) for c in ("_a", "_b"))
            la, lb = (pc.list_value_length(x) for x in (a, b))
            ends = np.cumsum(np.asarray(la, np.int64) + np.asarray(lb, np.int64))
            at = 0
            while at < len(batch):
                before = int(ends[at - 1]) if at else 0
                n = max(1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, "right")) - at)
                m = clipped_matches(a.slice(at, n), b.slice(at, n))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(at, n), la.slice(at, n), lb.slice(at, n), *(pa.array(np.ascontiguousarray(m[:, i])) for i in range(4))], [key, "la", "lb", *names])
                at += n

    out = t.mapInArrow(matched, f"`{key}` {t.schema[key].dataType.simpleString()}, la int, lb int, " + ", ".join(f"{c} long" for c in names))
    logs = F.lit(0.0)
    for i, c in enumerate(names):
        logs = logs + F.log(F.when(F.col(c) > 0, F.col(c).cast("double")).otherwise(eps) / F.greatest(F.lit(1), F.col("la") - i)) / 4
    penalty = F.when(F.col("la") >= F.col("lb"), 1.0).otherwise(F.exp(1 - F.col("lb") / F.nullif(F.col("la"), F.lit(0))))
    return out.select(key, F.when((F.col("la") == 0) | (F.col("m1") == 0), 0.0).otherwise(F.round(penalty * F.exp(logs), 6)).alias("bleu"))


def judge_summary(df: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """One row: the mean of each axis and of all, 2 decimals."""
    total = F.lit(0.0)
    for a in axes:
        total = total + F.avg(a)
    return df.agg(*[F.bround(F.avg(a), 2).alias(a) for a in axes], F.bround(total / len(axes), 2).alias("overall"))


def select_samples(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ids (key, pos), in that order."""
    return df.join(ids, key).orderBy("pos")


def merge_labels(gold: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """Gold rows, and the rest's rows without a gold one; column label_source."""
    other = rest.join(gold.select(key), key, "left_anti").withColumn("label_source", F.lit("teacher"))
    return gold.withColumn("label_source", F.lit("gold")).unionByName(other, allowMissingColumns=True)


def keyword_truth(df: DataFrame, keywords: dict[str, tuple[str, ...]], entity: str, key: str, text: str, least: int) -> DataFrame:
    """(entity, aspect, support, evidence): aspects with `least` mentions, the first 3 ids as evidence, and
    a quote of 50 characters from the first."""
    rows = df.select(entity, key, text, F.explode(F.filter(F.array(*[F.when(_any(text, w), F.lit(a)) for a, w in keywords.items()]), lambda x: x.isNotNull())).alias("aspect"))
    w = Window.partitionBy(entity, "aspect").orderBy(key)
    ranked = rows.withColumn("_rn", F.row_number().over(w))
    g = ranked.groupBy(entity, "aspect").agg(F.count(F.lit(1)).alias("support"), F.sort_array(F.collect_list(F.when(F.col("_rn") <= 3, F.col(key)))).alias("evidence"), F.max(F.when(F.col("_rn") == 1, quote(F.col(text)))).alias("quote"))
    return g.where(F.col("support") >= least)


def strength_truth(df: DataFrame, rules: dict[str, tuple[tuple[str, ...], int, int]], entity: str, key: str, text: str, others: int = 3) -> DataFrame:
    """(entity, aspect, support, evidence, compared): for each aspect's (keywords, least, most), the entities whose
    positive rows mention it at least `least` times, with the first `most` ids as evidence and the
    first other entities to compare with."""
    aspects = F.filter(F.array(*[F.when(_any(text, words), F.struct(F.lit(a).alias("aspect"), F.lit(least).alias("least"), F.lit(most).alias("most"))) for a, (words, least, most) in rules.items()]), lambda x: x.isNotNull())
    rows = df.select(entity, key, F.explode(aspects).alias("a")).select(entity, key, "a.*")
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(entity, "aspect").orderBy(key)))
    g = ranked.groupBy(entity, "aspect").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"), F.max("most").alias("most"), F.sort_array(F.collect_list(F.when(F.col("_rn") <= F.col("most"), F.col(key)))).alias("evidence"))
    # The first others are among the first `others` + 1 entities, a table of that many rows.
    first = df.select(F.col(entity).alias("_o")).distinct().orderBy("_o").limit(others + 1).agg(F.sort_array(F.collect_list("_o")).alias("_first"))
    found = g.where(F.col("n") >= F.col("least")).crossJoin(F.broadcast(first))
    return found.select(entity, "aspect", F.least("n", F.col("most").cast("long")).alias("support"), "evidence", F.slice(F.filter("_first", lambda o: o != F.col(entity)), 1, others).alias("compared"))


def _any(text: str, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(F.col(text), F.lit(n))
    return out


def quote(c: Column, chars: int = 50) -> Column:
    """The first characters, with ... where some are cut off."""
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(c)


def classify_score(df: DataFrame, score: str = "score") -> DataFrame:
    return df.withColumn("label", R.sentiment_label(F.col(score)))
