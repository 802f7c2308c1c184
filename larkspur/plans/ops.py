"""Queries of operational metrics and evaluation. Events stand for requests: value is the latency in
ms, the length of its props the tokens, an `error` a failure; documents' hashed scores stand for a
classifier, labels for the truth, conversations for generated answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import opsmetrics as M
from ..operators import sampling as S
from .base import KEYWORDS, sql_any, table

NOW = "TIMESTAMP '2024-01-25 00:00:00'"


def requests(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("kind"), F.round("value", 2).alias("ms"), F.length("props").cast("long").alias("tokens"), (F.col("event_type") == "error").cast("long").alias("error_count"), F.round(F.col("value") / 4, 4).alias("ttft"), F.round(F.length("props") * 1000 / (F.col("value") + 1), 2).alias("tps"), F.when(F.col("event_type") == "error", F.when(F.col("user_id") % 3 == 0, 404).otherwise(503)).otherwise(200).alias("status"), (F.col("user_id") % 10).alias("entity"), F.to_date("ts").alias("day"))


SQL_Q = "q AS (SELECT event_id AS id, ts, event_type AS kind, round(value, 2) AS ms, length(props) AS tokens, (event_type = 'error')::BIGINT AS error_count, round(value / 4, 4) AS ttft, round(length(props) * 1000 / (value + 1), 2) AS tps, CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 3 = 0 THEN 404 ELSE 503 END ELSE 200 END AS status, user_id % 10 AS entity, ts::DATE AS day FROM events)"


def perf_stats(spark, d):
    return M.perf_stats(requests(spark, d), F.expr(NOW), 7)


def perf_stats_ext(spark, d):
    return M.perf_stats_ext(requests(spark, d))


def latency_stats(spark, d):
    return M.latency_stats(requests(spark, d), 1000)


def goodput(spark, d):
    return M.goodput(requests(spark, d), 20, ("kind",))


def goodput_recent(spark, d):
    return M.goodput_recent(requests(spark, d), 500, 20)


def goodput_rolling(spark, d):
    return M.goodput_rolling(requests(spark, d), 20, 20, "entity").select("id", "goodput_tps")


def load_summary(spark, d):
    return M.load_summary(requests(spark, d))


def bench_summary(spark, d):
    return M.bench_summary(requests(spark, d).withColumn("mode", F.col("kind")).withColumn("items", F.col("tokens")))


def compare_modes(spark, d):
    return M.compare_modes(bench_summary(spark, d), "view")


def percentiles(spark, d):
    return M.index_percentile(requests(spark, d), "ms", (50, 90, 95, 99), ("kind", "entity"))


def run_status(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "error", "failed").when((F.col("event_type") == "signup") & (F.col("user_id") % 2 == 0), "running").otherwise("done")
    return M.run_status(e.select(F.col("user_id").alias("run"), state.alias("state")))


def skip(spark, d):
    return M.should_skip(requests(spark, d).where(F.col("ts") <= F.expr(NOW)), F.expr(NOW), 60, ("entity", "kind"))


def concurrent(spark, d):
    return M.max_concurrent(requests(spark, d))


def rps(spark, d):
    return M.actual_rps(requests(spark, d))


def scored(spark, d):
    """A score in 0..1 for each document, from its text's length and words."""
    x = table(spark, d, "documents")
    return x.select("doc_id", "source", "text", F.round(F.pmod(F.col("n_chars") * 37 + F.col("doc_id") * 11, F.lit(1001)) / 1000, 3).alias("score"))


SQL_S = "sc AS (SELECT doc_id, source, text, round(((n_chars * 37 + doc_id * 11) % 1001)::DOUBLE / 1000, 3) AS score FROM documents), lb AS (SELECT *, CASE WHEN score > 0.8 THEN 'positive' WHEN score >= 0.3 AND score < 0.8 THEN 'neutral' ELSE 'negative' END AS label FROM sc)"


def score_bands(spark, d):
    return M.score_bands(scored(spark, d))


def sentiment(spark, d):
    return E.sentiment_ratios(E.classify_score(scored(spark, d)), "source")


def _truth(spark, d):
    return table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def rating_truth(spark, d):
    return E.rating_truth(scored(spark, d).join(_truth(spark, d), "doc_id"), "source", F.col("quality") == 1)


def confusion(spark, d):
    pred = E.classify_score(scored(spark, d)).select("doc_id", F.when(F.col("label") == "positive", "positive").otherwise("negative").alias("pred"))
    return E.confusion(pred, _truth(spark, d).select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("truth")), "doc_id")


def ratio_errors(spark, d):
    s = scored(spark, d).join(_truth(spark, d), "doc_id")
    pred = E.sentiment_ratios(E.classify_score(s), "source").select("source", F.col("positive_ratio").cast("double").alias("positive"), F.col("positive").cast("double").alias("count"))
    truth = E.rating_truth(s, "source", F.col("quality") == 1).select("source", F.col("positive_pct").alias("positive"), F.col("positive_count").cast("double").alias("count"))
    return E.ratio_errors(pred, truth, "source", ("positive", "count"))


def mean_errors(spark, d):
    return E.mean_errors(ratio_errors(spark, d), "source")


def hits(spark, d):
    """Ten hits for each query: benchmark items against documents by a hashed score."""
    p = table(spark, d, "labels").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 40).alias("query"), F.pmod(F.col("doc_id") * 31, F.lit(101)).alias("s"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "doc"))).where("rank <= 10 AND query % 7 > 0")


def retrieval_metrics(spark, d):
    truth = table(spark, d, "labels").where("quality = 1 AND doc_id % 3 = 0").select((F.col("doc_id") % 40).alias("query"), F.col("doc_id").alias("doc"))
    return E.precision_recall_at_k(hits(spark, d), truth)


def model_rows(spark, d):
    l = table(spark, d, "labels").select((F.col("doc_id") % 3).alias("model"), "quality", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)])).alias("k"), "doc_id")
    return l.groupBy("model", "k").agg(F.round(F.avg(F.when(F.col("doc_id") % 10 < F.col("k"), F.col("quality")).otherwise(0)), 6).alias("precision"))


def model_table(spark, d):
    return E.model_table(model_rows(spark, d))


def best_models(spark, d):
    return E.best_model_per_k(model_rows(spark, d))


def best_run(spark, d):
    r = table(spark, d, "events").groupBy(F.concat(F.lit("run"), (F.col("user_id") % 50).cast("string")).alias("run")).agg(F.round(F.avg("value"), 6).alias("v"), F.min("user_id").alias("u"))
    return E.best_run(r.select("run", F.when(F.col("u") % 2 == 0, F.col("v")).alias("eval_loss"), F.when(F.col("u") % 2 == 1, F.col("v")).alias("eval/loss")))


def aspects(spark, d, salt):
    """Aspects of each source: the events of its users, ranked by count."""
    p = table(spark, d, "documents").select(F.col("source").alias("entity"), F.concat(F.lit("Aspect  "), F.pmod(F.col("doc_id") * salt, F.lit(13)).cast("string")).alias("aspect"), "doc_id")
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("entity", "aspect").orderBy("doc_id")))
    g = p.groupBy("entity", "aspect").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("r") <= 20, F.col("doc_id")))).alias("evidence"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "aspect"))).where("rank <= 8")


def strength_at_k(spark, d):
    return E.strength_at_k(aspects(spark, d, 7), aspects(spark, d, 5))


def aspect_coverage(spark, d):
    return E.aspect_coverage(aspects(spark, d, 7), aspects(spark, d, 5))


def false_positives(spark, d):
    return E.false_positive_rate(aspects(spark, d, 7), aspects(spark, d, 5))


def evidence_overlap(spark, d):
    return E.evidence_overlap(aspects(spark, d, 7), aspects(spark, d, 5))


def answers(spark, d):
    """Each turn's text against the conversation's previous turn."""
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.row_number().over(w).cast("string")).alias("id"), F.col("text").alias("pred"), F.lag("text").over(w).alias("ref"))


def rouge(spark, d):
    return E.rouge(answers(spark, d), "pred", "ref", "id", ascii_only=True)


def rouge_l(spark, d):
    return E.rouge_l(answers(spark, d), "pred", "ref", "id")


def bleu(spark, d):
    return E.bleu(answers(spark, d), "pred", "ref", "id")


def judge_summary(spark, d):
    t = table(spark, d, "conversations")
    n = F.length("text")
    return E.judge_summary(t.select((n % 5 + 1).alias("accuracy"), (n % 3 + 2).alias("fluency"), (F.col("turn") % 5 + 1).alias("coverage")), ("accuracy", "fluency", "coverage"))


def selected(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.row_number().over(Window.orderBy(F.desc("doc_id"))).alias("pos"))
    return E.select_samples(table(spark, d, "documents").select("doc_id", "source"), ids, "doc_id")


def merged_labels(spark, d):
    l = _truth(spark, d)
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return E.merge_labels(l, docs, "doc_id")


def keyword_truth(spark, d):
    return E.keyword_truth(table(spark, d, "documents"), KEYWORDS, "source", "doc_id", "text", 3).select("source", "aspect", "support", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"), "quote")


def dataset_stats(spark, d):
    x = S.holdout_split(table(spark, d, "orders"), 0.2, "o_orderdate", "o_orderkey")
    return M.dataset_stats(x, "split", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"])


_PCT = lambda c, n="ms": f"list_sort(list({n}) FILTER ({n} IS NOT NULL{c}))"


def _p(p, cond="", n="ms"):
    return f"{_PCT(cond, n)}[1 + least(len({_PCT(cond, n)}) * {p} // 100, len({_PCT(cond, n)}) - 1)] AS p{p}"


_GOOD = "count(*) AS requests, sum((ttft < 20)::INT)::BIGINT AS met, round(avg(ttft), 6) AS avg_ttft, coalesce(round(sum(tokens) * 1000 / nullif(sum(ms), 0), 4), 0.0) AS throughput_tps, coalesce(round(coalesce(sum(tokens) FILTER (ttft < 20), 0) * 1000 / nullif(sum(ms), 0), 4), 0.0) AS goodput_tps, coalesce(round(coalesce(sum(tokens) FILTER (ttft < 20), 0) * 100 / nullif(sum(tokens), 0)::DOUBLE, 4), 0.0) AS sla_tokens_pct, round(sum((ttft < 20)::INT) * 100 / count(*)::DOUBLE, 4) AS sla_requests_pct"
_BENCH = f"bs AS (SELECT kind AS mode, count(*) AS n, round(avg(ms), 4) AS mean, round(quantile_cont(ms, 0.5), 4) AS median, round(coalesce(stddev_samp(ms), 0.0), 4) AS std, round(sum(tokens) * 1000 / nullif(sum(ms), 0), 4) AS per_second, {_p(95)}, {_p(99)} FROM q GROUP BY kind)"
_RATIO = "round_even({a}::DOUBLE * 100 / nullif({b}, 0), 0)::BIGINT"
_SENT = f"sr AS (SELECT source, total, positive, negative, neutral, coalesce({_RATIO.format(a='positive', b='(positive + negative)')}, 0) AS positive_ratio, coalesce({_RATIO.format(a='negative', b='(positive + negative)')}, 0) AS negative_ratio, coalesce({_RATIO.format(a='neutral', b='total')}, 0) AS neutral_ratio FROM (SELECT source, count(*) AS total, sum((label = 'positive')::INT)::BIGINT AS positive, sum((label = 'negative')::INT)::BIGINT AS negative, sum((label = 'neutral')::INT)::BIGINT AS neutral FROM {{t}} GROUP BY source))"
_LT = "lt AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id), js AS (SELECT lb.*, quality FROM lb JOIN lt USING (doc_id)), rt AS (SELECT source, sum((quality = 1)::INT)::BIGINT AS positive_count, sum((quality <> 1)::INT)::BIGINT AS negative_count, round(100.0::DOUBLE * sum((quality = 1)::INT) / count(*), 1) AS positive_pct, round(100.0::DOUBLE * sum((quality <> 1)::INT) / count(*), 1) AS negative_pct FROM js GROUP BY source)"
_ERR = "er AS (SELECT source, abs(positive_ratio - positive_pct) AS positive_error, abs(positive - positive_count)::DOUBLE AS count_error FROM sr JOIN rt USING (source))"
_AS = lambda n, salt: f"{n} AS (SELECT entity, aspect, evidence, lower(regexp_replace(aspect, '[ ]+', ' ', 'g')) AS a, row_number() OVER (PARTITION BY entity ORDER BY n DESC, aspect) AS rank FROM (SELECT source AS entity, 'Aspect  ' || ((doc_id * {salt}) % 13)::VARCHAR AS aspect, count(*) AS n, list_sort(list(doc_id))[1:20] AS evidence FROM documents GROUP BY ALL) QUALIFY rank <= 8)"
_AA = f"{_AS('ap', 7)}, {_AS('tr', 5)}"
_HITS = "h AS (SELECT doc_id AS doc, doc_id % 40 AS query, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY (doc_id * 31) % 101 DESC, doc_id) AS rank FROM labels QUALIFY rank <= 10 AND query % 7 > 0)"
_MODEL = "mr AS (SELECT doc_id % 3 AS model, k, round(avg(CASE WHEN doc_id % 10 < k THEN quality ELSE 0 END), 6) AS precision FROM labels, (VALUES (1), (3), (5), (10)) v(k) GROUP BY ALL)"
_NG = lambda n: f"""a{n} AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(generate_series(1, len(a) - {n - 1}), lambda i: array_to_string(a[i:i + {n - 1}], ' '))) AS g FROM w) GROUP BY ALL), b{n} AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(generate_series(1, len(b) - {n - 1}), lambda i: array_to_string(b[i:i + {n - 1}], ' '))) AS g FROM w) GROUP BY ALL), m{n} AS (SELECT id, sum(least(a{n}.c, b{n}.c)) AS m FROM a{n} JOIN b{n} USING (id, g) GROUP BY id)"""

def _bleu() -> str:
    gram = lambda c, n: f"SELECT id, g, count(*) AS k FROM (SELECT id, unnest(list_transform(generate_series(1, len({c}) - {n - 1}), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))) AS g FROM w) GROUP BY ALL"
    both = ", ".join(f"m{n} AS (SELECT id, sum(least(p.k, q.k)) AS m FROM ({gram('a', n)}) p JOIN ({gram('b', n)}) q USING (id, g) GROUP BY id)" for n in (1, 2, 3, 4))
    logs = " + ".join(f"ln(coalesce(m{n}.m::DOUBLE, 0.1::DOUBLE) / greatest(1, len(a) - {n - 1})) / 4" for n in (1, 2, 3, 4))
    return f"""WITH c AS (SELECT conv_id::VARCHAR || '-' || row_number() OVER w AS id, text AS pred, lag(text) OVER w AS ref FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
w AS (SELECT id, regexp_extract_all(coalesce(pred, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS a, regexp_extract_all(coalesce(ref, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS b FROM c), {both}
SELECT w.id, CASE WHEN len(a) = 0 OR m1.m IS NULL THEN 0.0 ELSE round((CASE WHEN len(a) >= len(b) THEN 1.0 ELSE exp(1 - len(b)::DOUBLE / len(a)) END) * exp({logs}), 6) END::DOUBLE AS bleu FROM w {" ".join(f"LEFT JOIN m{n} USING (id)" for n in (1, 2, 3, 4))}"""


#: The table of the longest common subsequence row by row, as a list that each word of the prediction updates.
_ROUGE_L = r"""WITH c AS (SELECT conv_id::VARCHAR || '-' || row_number() OVER w AS id, text AS pred, lag(text) OVER w AS ref FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
w AS (SELECT id, regexp_extract_all(lower(coalesce(pred, '')), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+') AS a, regexp_extract_all(lower(coalesce(ref, '')), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+') AS b FROM c),
f AS (SELECT id, len(a) AS n, len(b) AS m, list_transform(a, lambda x: list_transform(b, lambda y: (x = y)::INT)) AS rows FROM w WHERE len(a) > 0 AND len(b) > 0),
l AS (SELECT id, n, m, list_reduce(rows, lambda r, x: list_reduce(list_transform(generate_series(1, len(x)), lambda j: [greatest(r[j], coalesce(r[j - 1], 0) + x[j])]), lambda p, q: list_append(p, greatest(p[-1], q[1]))), list_transform(generate_series(1, m), lambda j: 0)) AS r FROM f)
SELECT w.id, coalesce(round(2 * r[-1] / (n + m)::DOUBLE, 6), 0.0) AS "rougeL" FROM w LEFT JOIN l USING (id)"""

QUERIES = {
    "perf_stats": (perf_stats, f"WITH {SQL_Q} SELECT kind, count(*) AS requests, round(avg(ms), 4) AS avg_ms, sum(tokens)::BIGINT AS tokens, sum(error_count)::BIGINT AS errors, round(sum(error_count)::DOUBLE / count(*), 6) AS error_rate FROM q WHERE ts > {NOW} - INTERVAL 7 DAY AND ts <= {NOW} GROUP BY kind"),
    "perf_stats_ext": (perf_stats_ext, f"WITH {SQL_Q} SELECT kind, count(*) AS requests, min(ms) AS min_ms, round(avg(ms), 4) AS avg_ms, max(ms) AS max_ms, min(tokens) AS min_tokens, round(avg(tokens), 4) AS avg_tokens, max(tokens) AS max_tokens, round(100 * avg((error_count > 0)::INT), 4) AS error_pct, round(100 - 100 * avg((error_count > 0)::INT), 4) AS success_pct FROM q GROUP BY kind"),
    "latency_stats": (latency_stats, f"WITH {SQL_Q}, l AS (SELECT * FROM q ORDER BY ts DESC, id DESC LIMIT 1000) SELECT count(*) AS rows, round(avg(ttft), 6) AS avg_ttft, round(avg(tps), 6) AS avg_tps, " + ", ".join(_p(p, "", c).replace(f"AS p{p}", f"AS {c}_p{p}") for c in ("ttft", "tps") for p in (95, 99)) + " FROM l"),
    "goodput": (goodput, f"WITH {SQL_Q} SELECT kind, {_GOOD} FROM q GROUP BY kind"),
    "goodput_recent": (goodput_recent, f"WITH {SQL_Q}, l AS (SELECT * FROM q ORDER BY ts DESC, id DESC LIMIT 500) SELECT {_GOOD} FROM l"),
    "goodput_rolling": (goodput_rolling, f"WITH {SQL_Q} SELECT id, coalesce(round(sum(CASE WHEN ttft < 20 THEN tokens ELSE 0 END) OVER w * 1000 / nullif(sum(ms) OVER w, 0), 4), 0.0) AS goodput_tps FROM q WINDOW w AS (PARTITION BY entity ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"),
    "load_summary": (load_summary, f"WITH {SQL_Q} SELECT count(*) AS total, sum((status = 200)::INT)::BIGINT AS success, sum((status = 404)::INT)::BIGINT AS errors_4xx, sum((status = 503)::INT)::BIGINT AS errors_5xx, round(avg(ms) FILTER (status = 200), 4) AS avg_ms, min(ms) FILTER (status = 200) AS min_ms, max(ms) FILTER (status = 200) AS max_ms, round(100 * sum((status = 200)::INT) / count(*)::DOUBLE, 4) AS success_rate, round(sum((status = 200)::INT) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))), 6) AS throughput, " + ", ".join(_p(p, " AND status = 200") for p in (50, 95, 99)) + " FROM q"),
    "bench_summary": (bench_summary, f"WITH {SQL_Q}, {_BENCH} SELECT * FROM bs"),
    "compare_modes": (compare_modes, f"WITH {SQL_Q}, {_BENCH} SELECT bs.mode, round((b.mean - bs.mean) / b.mean * 100, 4) AS latency_gain, round((bs.per_second - b.per_second) / b.per_second * 100, 4) AS throughput_gain FROM bs, (SELECT * FROM bs WHERE mode = 'view') b"),
    "index_percentiles": (percentiles, f"WITH {SQL_Q} SELECT kind, entity, {_p(50)}, {_p(90)}, {_p(95)}, {_p(99)} FROM q GROUP BY kind, entity"),
    "run_status": (run_status, "WITH s AS (SELECT user_id AS run, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 'running' ELSE 'done' END AS state FROM events) SELECT run, count(*) AS total, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state <> 'running') >= count(*) AS completed FROM s GROUP BY run"),
    "should_skip": (skip, f"WITH {SQL_Q} SELECT entity, kind, max(ts) FILTER (error_count = 0) AS last_success, coalesce(max(ts) FILTER (error_count = 0) > {NOW} - INTERVAL 60 MINUTE, false) AS skip FROM q WHERE ts <= {NOW} GROUP BY entity, kind"),
    "max_concurrent": (concurrent, f"WITH {SQL_Q}, c AS (SELECT day, count(*) OVER (PARTITION BY day ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 999999 FOLLOWING) AS n FROM q) SELECT day, max(n) AS most FROM c GROUP BY day"),
    "actual_rps": (rps, "SELECT round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(ts) - 1), 6) AS mean_gap, round(1 / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(ts) - 1)), 6) AS rps FROM events"),
    "score_bands": (score_bands, f"WITH {SQL_S} SELECT band, count(*) AS rows, band IN ('0.3-0.5', '0.5-0.8') AS ambiguous FROM (SELECT CASE WHEN score < 0.3 THEN '0.0-0.3' WHEN score < 0.5 THEN '0.3-0.5' WHEN score < 0.8 THEN '0.5-0.8' ELSE '0.8-1.0' END AS band FROM sc) GROUP BY band"),
    "sentiment_ratios": (sentiment, f"WITH {SQL_S}, {_SENT.format(t='lb')} SELECT * FROM sr"),
    "rating_truth": (rating_truth, f"WITH {SQL_S}, {_LT} SELECT * FROM rt"),
    "confusion": (confusion, f"""WITH {SQL_S}, {_LT}, c AS (SELECT class, count(*) FILTER (p = class AND t = class) AS tp, count(*) FILTER (p = class AND t <> class) AS fp, count(*) FILTER (p <> class AND t = class) AS fn, count(*) FILTER (p <> class AND t <> class) AS tn FROM (SELECT CASE WHEN label = 'positive' THEN 'positive' ELSE 'negative' END AS p, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS t FROM js), (VALUES ('positive'), ('negative')) v(class) GROUP BY class)
SELECT *, coalesce(round(tp / nullif(tp + fp, 0)::DOUBLE, 6), 0.0) AS precision, coalesce(round(tp / nullif(tp + fn, 0)::DOUBLE, 6), 0.0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6), 0.0) AS f1, coalesce(round((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 6), 0.0) AS accuracy FROM c"""),
    "ratio_errors": (ratio_errors, f"WITH {SQL_S}, {_LT}, {_SENT.format(t='js')}, {_ERR} SELECT * FROM er"),
    "mean_errors": (mean_errors, f"WITH {SQL_S}, {_LT}, {_SENT.format(t='js')}, {_ERR} SELECT round(avg(positive_error), 6) AS positive_error, round(avg(count_error), 6) AS count_error, round((avg(positive_error) + avg(count_error)) / 2, 6) AS mae FROM er"),
    "retrieval_metrics": (retrieval_metrics, f"""WITH {_HITS}, t AS (SELECT DISTINCT doc_id % 40 AS query, doc_id AS doc FROM labels WHERE quality = 1 AND doc_id % 3 = 0), n AS (SELECT query, count(*) AS n FROM t GROUP BY query),
p AS (SELECT h.query, k, count(t.doc) FILTER (rank <= k) AS hit, any_value(n) AS n FROM h JOIN n USING (query) LEFT JOIN t ON t.query = h.query AND t.doc = h.doc, (VALUES (1), (3), (5), (10)) v(k) GROUP BY h.query, k)
SELECT k, round(avg(hit / k), 6) AS precision, round(avg(hit / n), 6) AS recall, round(sum(hit / k) / (SELECT count(*) FROM n), 6) AS precision_all, count(*) AS queries FROM p GROUP BY k"""),
    "model_table": (model_table, f"WITH {_MODEL} SELECT model, " + ", ".join(f"any_value(precision) FILTER (k = {k}) AS p{k}" for k in (1, 3, 5, 10)) + " FROM mr GROUP BY model"),
    "best_models": (best_models, f"WITH {_MODEL} SELECT * FROM mr QUALIFY row_number() OVER (PARTITION BY k ORDER BY precision DESC, model) = 1"),
    "best_run": (best_run, "WITH r AS (SELECT 'run' || (user_id % 50)::VARCHAR AS run, round(avg(value), 6) AS loss FROM events GROUP BY 1) SELECT run, loss FROM r ORDER BY loss, run LIMIT 1"),
    "strength_at_k": (strength_at_k, f"WITH {_AA}, n AS (SELECT entity, count(DISTINCT a) AS n FROM tr GROUP BY entity), p AS (SELECT ap.entity, k, count(tr.a) AS hit, any_value(n) AS n FROM ap JOIN n USING (entity) LEFT JOIN tr ON tr.entity = ap.entity AND tr.a = ap.a, (VALUES (1), (3), (5)) v(k) WHERE ap.rank <= k GROUP BY ap.entity, k) SELECT k, round(avg(hit / k), 6) AS precision, round(avg(hit / n), 6) AS recall FROM p GROUP BY k"),
    "aspect_coverage": (aspect_coverage, f"WITH {_AA}, g AS (SELECT coalesce(ap.entity, tr.entity) AS entity, count(tr.a) AS t, count(ap.a) AS p, count(*) FILTER (tr.a IS NOT NULL AND ap.a IS NOT NULL) AS matched FROM tr FULL JOIN ap ON ap.entity = tr.entity AND ap.a = tr.a GROUP BY 1) SELECT entity, matched, coalesce(round(matched / nullif(p, 0)::DOUBLE, 6), 0.0) AS precision, round(matched / t::DOUBLE, 6) AS recall, round(2 * matched / (t + p)::DOUBLE, 6) AS f1 FROM g WHERE t > 0"),
    "false_positive_rate": (false_positives, f"WITH {_AA} SELECT ap.entity, round(count(*) FILTER (tr.a IS NULL) / count(*)::DOUBLE, 6) AS rate FROM ap LEFT JOIN tr ON ap.entity = tr.entity AND ap.a = tr.a GROUP BY ap.entity"),
    "evidence_overlap": (evidence_overlap, f"WITH {_AA}, j AS (SELECT ap.entity, ap.a AS aspect, len(ap.evidence) AS n, len(tr.evidence) AS m, len(list_intersect(ap.evidence, tr.evidence)) AS i FROM ap JOIN tr ON ap.entity = tr.entity AND ap.a = tr.a WHERE ap.rank <= 5) SELECT entity, aspect, round(i / n::DOUBLE, 6) AS precision, round(i / m::DOUBLE, 6) AS recall, round(2 * i / (n + m)::DOUBLE, 6) AS f1, round(i / (n + m - i)::DOUBLE, 6) AS overlap FROM j"),
    "rouge": (rouge, f"""WITH c AS (SELECT conv_id::VARCHAR || '-' || row_number() OVER w AS id, text AS pred, lag(text) OVER w AS ref FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
w AS (SELECT id, regexp_extract_all(lower(coalesce(pred, '')), '[a-z0-9]+') AS a, regexp_extract_all(lower(coalesce(ref, '')), '[a-z0-9]+') AS b FROM c), {_NG(1)}, {_NG(2)}
SELECT w.id, coalesce(round(2 * coalesce(m1.m, 0) / nullif(len(a) + len(b), 0)::DOUBLE, 6), 0.0) AS rouge1, coalesce(round(2 * coalesce(m2.m, 0) / nullif(greatest(len(a) - 1, 0) + greatest(len(b) - 1, 0), 0)::DOUBLE, 6), 0.0) AS rouge2 FROM w LEFT JOIN m1 USING (id) LEFT JOIN m2 USING (id)"""),
    "rouge_l": (rouge_l, _ROUGE_L),
    "bleu": (bleu, _bleu()),
    "judge_summary": (judge_summary, "WITH t AS (SELECT length(text) % 5 + 1 AS a, length(text) % 3 + 2 AS f, turn % 5 + 1 AS c FROM conversations) SELECT round_even(avg(a), 2) AS accuracy, round_even(avg(f), 2) AS fluency, round_even(avg(c), 2) AS coverage, round_even((avg(a) + avg(f) + avg(c)) / 3, 2) AS overall FROM t"),
    "selected_samples": (selected, "SELECT documents.doc_id, source, pos FROM documents JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS pos FROM labels WHERE toxic = 1) USING (doc_id)"),
    "merged_labels": (merged_labels, "WITH g AS (SELECT doc_id, min(quality)::INT AS quality FROM labels GROUP BY doc_id) SELECT doc_id, quality, 'gold' AS label_source FROM g UNION ALL SELECT doc_id, (n_chars % 2)::INT, 'teacher' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)"),
    "keyword_truth": (keyword_truth, "WITH k AS (" + " UNION ALL ".join(f"SELECT source, doc_id, text, '{a}' AS aspect FROM documents WHERE {sql_any('text', w)}" for a, w in KEYWORDS.items()) + ") SELECT source, aspect, count(*) AS support, array_to_string(list_sort(list(doc_id))[1:3], ',') AS evidence, arg_min(CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END, doc_id) AS quote FROM k GROUP BY source, aspect HAVING count(*) >= 3"),
    "dataset_stats": (dataset_stats, "WITH h AS (SELECT *, row_number() OVER (ORDER BY o_orderdate ASC NULLS LAST, o_orderkey) > count(*) OVER () - floor(count(*) OVER () * 0.2) AS t FROM orders), r AS (SELECT CASE WHEN t THEN 'test' ELSE 'train' END AS split, o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR || '|' || o_orderstatus AS s, row_number() OVER (PARTITION BY t ORDER BY o_orderkey) AS rn FROM h) SELECT split, count(*) AS rows, sha256(string_agg(s, chr(10) ORDER BY rn) FILTER (rn <= 100)) AS hash FROM r GROUP BY split"),
}
