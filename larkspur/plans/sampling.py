"""Queries of splits, windows, samples and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as K
from ..operators import sampling as S
from ..scratch import Scratch
from .base import table
from .features import SQL_I, interactions
from .phrases import seeded, unit


def reviews(spark, d):
    """Documents with a review time: every 11th has none."""
    x = table(spark, d, "documents")
    return x.select("doc_id", "source", "text", F.when(F.col("doc_id") % 11 != 0, F.timestamp_seconds(1_700_000_000 + F.pmod(F.col("doc_id") * 7919, F.lit(100_000)) * 60)).alias("ts"))


SQL_R = "rv AS (SELECT doc_id, source, text, CASE WHEN doc_id % 11 <> 0 THEN make_timestamp((1700000000 + (doc_id * 7919) % 100000 * 60) * 1000000) END AS ts FROM documents)"


def time_split(spark, d):
    return S.time_split(interactions(spark, d), "ts", "1996-01-01", "1997-06-01").select("ord", "line", "split")


def group_time_split(spark, d):
    return S.time_split(interactions(spark, d), "ts", "1996-01-01", "1997-06-01", "user").select("ord", "line", "split")


def holdout(spark, d):
    return S.holdout_split(reviews(spark, d), 0.2, "ts", "doc_id").select("doc_id", "split")


def seeded_holdout(spark, d):
    return S.holdout_split(reviews(spark, d), 0.2, None, "doc_id").select("doc_id", "split")


def entity_split(spark, d):
    return S.entity_split(reviews(spark, d), "source")


def review_windows(spark, d):
    w = S.review_windows(reviews(spark, d))
    return w.select("source", "window_size", "stride", "start", F.size("reviews").alias("n"), F.md5(F.array_join(F.transform("reviews", lambda x: x.cast("string")), ",")).alias("ids"))


def window_dataset(spark, d):
    """The dataset flow: windows, the split of their sources, and counts of samples per split."""
    r = reviews(spark, d)
    w = S.review_windows(r).join(S.entity_split(r, "source").select("source", "split"), "source")
    return w.groupBy("split", "window_size", "stride").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("source").alias("sources"))


def capped(spark, d):
    return S.cap_per_group(reviews(spark, d).where(F.trim("text") != ""), "source", 10, F.col("doc_id")).select("source", "doc_id")


def trimmed(spark, d):
    return S.trim_rows(reviews(spark, d), "source", "doc_id", 400).select("source", "doc_id")


def round_robin(spark, d):
    return S.assign_round_robin(reviews(spark, d), "doc_id", 7, 60).select("doc_id", "grp")


def power_law(spark, d):
    n = table(spark, d, "documents")
    groups = n.select((F.col("doc_id") % 50).cast("int").alias("grp")).distinct()
    targets = S.power_law_targets(groups, n.count(), 5, 60, {0: 120, 1: 80}, 2.5)
    return S.assign_targets(n, "doc_id", targets).groupBy("grp").agg(F.count(F.lit(1)).alias("cnt"))


def default_groups(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(S.default_groups(F.count(F.lit(1))).alias("groups"))


def truth_sample(spark, d):
    return S.sample_groups(table(spark, d, "documents"), "doc_id", 4, 25).select("doc_id", "block")


def members(spark, d):
    m, day = S.synthetic_member(F.col("doc_id"), F.lit("2026-01-01").cast("date"))
    return table(spark, d, "documents").select("doc_id", m.alias("member"), day.alias("day"))


def zipf(spark, d):
    from pyspark.sql import Window

    ranked = table(spark, d, "documents").groupBy("source").count()
    ranked = ranked.select(F.col("source").alias("entity"), F.row_number().over(Window.orderBy(F.desc("count"), "source")).alias("rank"))
    return S.zipf_scenario(ranked, 10_000).groupBy("entity").agg(F.count(F.lit(1)).alias("requests"))


def negatives(spark, d):
    rows = interactions(spark, d).select("ord", "line", "user", "item", "category", "tier", "signal", "label", "weight")
    return S.add_negatives(Scratch(spark, "interactions").put(rows, "rows"), 2, key=("ord", "line"))


def eval_lists(spark, d):
    i = interactions(spark, d).withColumn("grp", F.col("ord"))
    return S.build_eval_lists(i, 20, 10, 200)


def scored_lists(spark, d):
    """The lines of an order are a list, scored by quantity; returned parts are its positives."""
    l = table(spark, d, "lineitem")
    return l.select(F.col("l_orderkey").alias("grp"), F.col("l_suppkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("double").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.round(1 + F.col("l_discount"), 2).cast("double").alias("weight"), "l_linenumber")


def list_metrics(spark, d):
    return K.list_metrics(scored_lists(spark, d), tie="l_linenumber")


def ranking(spark, d):
    s = scored_lists(spark, d)
    return K.ranking_metrics(s, s.where("grp % 5 = 0 AND item % 3 > 0"))


def auc(spark, d):
    return K.auc(scored_lists(spark, d))


def popularity(spark, d):
    s = scored_lists(spark, d)
    return K.popularity_baseline(s.drop("score"), s.groupBy("item").agg(F.sum("label").alias("cnt")))


def random_lists(spark, d):
    return K.random_baseline(scored_lists(spark, d))


def candidates(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey").cast("string")).alias("member"), F.when(F.col("o_custkey") % 8 != 0, F.col("o_custkey").cast("string")).alias("anonymous"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("x1")).otherwise(F.col("o_orderkey").cast("string")).alias("restaurant"), F.col("o_totalprice").cast("double").alias("score"))
    return K.rank_candidates(rows, "v1", F.lit("2026-01-01").cast("timestamp"), 7)


def active_recommendations(spark, d):
    recs = candidates(spark, d).withColumn("pipeline_version", F.concat(F.lit("v"), (F.col("restaurant") % 3).cast("string")))
    models = table(spark, d, "region").select(F.concat(F.lit("v"), F.col("r_regionkey").cast("string")).alias("pipeline_version"), F.when(F.col("r_regionkey") < 2, "ACTIVE").otherwise("OLD").alias("status"))
    return K.active_recs(recs, models, 3).select("user_key", "restaurant", "rank", "pipeline_version")


_CAND = """c AS (SELECT CASE WHEN o_custkey % 4 > 0 THEN o_custkey::VARCHAR END AS member, CASE WHEN o_custkey % 8 <> 0 THEN o_custkey::VARCHAR END AS anonymous, CASE WHEN o_orderkey % 10 = 0 THEN 'x1' ELSE o_orderkey::VARCHAR END AS restaurant, o_totalprice::DOUBLE AS score FROM orders),
k AS (SELECT *, coalesce('u_' || member, 'a_' || anonymous) AS user_key FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY score DESC, restaurant) AS rank FROM k WHERE user_key IS NOT NULL),
f AS (SELECT user_key, member, anonymous, restaurant::BIGINT AS restaurant, score, rank, 'v1' AS pipeline_version, TIMESTAMP '2026-01-01' AS generated_at, TIMESTAMP '2026-01-08' AS expires_at FROM r WHERE restaurant <> 'x1')"""
_LISTS = "sl AS (SELECT l_orderkey AS grp, l_suppkey AS user, l_partkey AS item, l_quantity::DOUBLE AS score, (l_returnflag = 'R')::INT AS label, round(1 + l_discount, 2)::DOUBLE AS weight, l_linenumber FROM lineitem)"


def _metrics(score="score", tie="l_linenumber", source="sl"):
    ms = ", ".join(f"sum(label / log2(r + 1)) FILTER (r <= {k}) AS d{k}, sum(label / log2(o + 1)) FILTER (o <= {k}) AS i{k}, sum(label) FILTER (r <= {k}) AS h{k}" for k in (5, 10))
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {score} DESC, {tie}, label) AS r, row_number() OVER (PARTITION BY grp ORDER BY label DESC, {tie}) AS o FROM {source}),
mm AS (SELECT grp, sum(label) AS n, max(weight) FILTER (label = 1) AS w, {ms} FROM rk GROUP BY grp),
m AS (SELECT grp, CASE WHEN w > 0 THEN w ELSE 1.0 END AS weight, round(d5 / i5, 9) AS ndcg_5, round(d10 / i10, 9) AS ndcg_10, round(least(1.0, h5::DOUBLE / n), 9) AS recall_5, round(least(1.0, h10::DOUBLE / n), 9) AS recall_10 FROM mm WHERE n > 0)"""


_MEAN = "count(*) AS lists, " + ", ".join(f"round(sum({c} * weight) / sum(weight), 6) AS {c}" for c in ("ndcg_5", "ndcg_10", "recall_5", "recall_10"))

def sql_drawn(p: str, rows: str, row: str, names: tuple[str, ...], pool: str, n: int, look: int, seed: int, again: int) -> str:
    """CTE {p} (row, user, item, try): for each row `look` seeded draws from the pool (item, place), without what its
    user holds (hd) and repeats; rows with fewer than n have their n from the user's exact pool."""
    seeds = "[" + ", ".join(f"('0x' || substr({seeded(seed, *names)}, {at}, 8))::BIGINT % {S.PRIME}" for at in (1, 9, 17)) + "]"
    free = "NOT EXISTS (SELECT 1 FROM hd WHERE hd.user = d.user AND hd.item = q.item)"
    return f"""{p}_t AS (SELECT {row}, user, try, ((c[1] * try + c[2]) % {S.PRIME} * try + c[3]) % {S.PRIME} * (SELECT count(*) FROM {pool}) // {S.PRIME} + 1 AS place FROM (SELECT {row}, user, {seeds} AS c FROM {rows}), range(1, {look + 1}) g(try)),
{p}_o AS (SELECT {row}, d.user, q.item, min(try) AS try FROM {p}_t d JOIN {pool} q USING (place) WHERE {free} GROUP BY ALL),
{p}_s AS (SELECT * FROM {rows} WHERE {row} NOT IN (SELECT {row} FROM {p}_o GROUP BY {row} HAVING count(*) >= {n})),
{p}_f AS (SELECT d.user, q.item, row_number() OVER (PARTITION BY d.user ORDER BY {seeded(again, "d.user", "q.item")}, q.item) AS rank, count(*) OVER (PARTITION BY d.user) AS size FROM (SELECT DISTINCT user FROM {p}_s) d, {pool} q WHERE {free}),
{p}_x AS (SELECT s.{row}, s.user, f.item, try FROM {p}_s s, {p}_f f, range(1, {n + 1}) g(try) WHERE f.user = s.user AND try <= size AND rank = (floor({unit(again, *names)} * size)::BIGINT + try - 1) % size + 1),
{p} AS (SELECT {row}, user, item, try FROM {p}_o WHERE {row} NOT IN (SELECT {row} FROM {p}_s) UNION ALL SELECT {row}, user, item, try FROM {p}_x)"""


_NEGATIVES = f"""WITH {SQL_I}, z AS (SELECT ord, line, user, item, category, tier, signal, label, weight FROM x),
pr AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY ord, line, user, item, category, tier, signal, weight) AS nth FROM z WHERE label = 1), hd AS (SELECT DISTINCT user, item FROM pr),
it AS (SELECT item, min(category) AS category, min(tier) AS tier, row_number() OVER (ORDER BY item) AS place FROM z GROUP BY item),
{sql_drawn("dr", "pr", "rid", ("ord", "line", "nth"), "it", 2, 96, 42, 44)}, tk AS (SELECT rid, item FROM dr QUALIFY row_number() OVER (PARTITION BY rid ORDER BY try) <= 2)
SELECT * FROM z UNION ALL SELECT ord, line, user, it.item, it.category, it.tier, 'NO_FEEDBACK', 0, 1.0::DOUBLE FROM tk JOIN pr USING (rid) JOIN it ON it.item = tk.item"""
_EVAL = f"""WITH {SQL_I}, ps AS (SELECT ord AS grp, user, item FROM x WHERE label = 1), hd AS (SELECT DISTINCT user, item FROM ps),
pk AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {seeded(42, "grp", "item")}, item, user) = 1),
ct AS (SELECT item, sum(label) AS c FROM x GROUP BY item), pp AS (SELECT item, row_number() OVER (ORDER BY c DESC, item) AS place FROM ct WHERE c > 0 QUALIFY place <= 200), al AS (SELECT item, row_number() OVER (ORDER BY item) AS place FROM ct),
{sql_drawn("pd", "pk", "grp", ("grp",), "pp", 10, 50, 43, 43)}, {sql_drawn("ad", "pk", "grp", ("grp",), "al", 20, 80, 44, 44)},
a AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY grp ORDER BY try) <= 10), b AS (SELECT * FROM ad ANTI JOIN a USING (grp, item)),
ng AS (SELECT * FROM (SELECT *, 0 AS o FROM a UNION ALL SELECT *, 1 AS o FROM b) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY o, try) <= 20), fl AS (SELECT grp FROM ng GROUP BY grp HAVING count(*) = 20)
SELECT grp, user, item, 1 AS label FROM pk SEMI JOIN fl USING (grp) UNION ALL SELECT grp, user, item, 0 FROM ng SEMI JOIN fl USING (grp)"""
_WIN = f"""{SQL_R}, p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY ts ASC NULLS LAST, doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM rv),
cf AS (SELECT * FROM (VALUES (30, 15), (50, 25), (20, 10)) v(w, s)), st AS (SELECT source, n, w, s, unnest(generate_series(0, n - w, s)) AS start FROM (SELECT DISTINCT source, n FROM p WHERE n >= 2), cf WHERE w <= n),
wi AS (SELECT st.source, w::INT AS window_size, s::INT AS stride, start, count(*)::INT AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY p)) AS ids FROM st JOIN p ON p.source = st.source AND p.p >= start AND p.p < start + w GROUP BY ALL
UNION ALL SELECT source, n::INT, NULL, 0, n::INT, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY p)) FROM p WHERE n >= 2 GROUP BY source, n)"""
_ES = "es AS (SELECT source, n, CASE WHEN r < 0.8 THEN 'train' WHEN r < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT source, n, (row_number() OVER (ORDER BY n, source) - 0.5) / count(*) OVER () AS r FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)))"
_TS = "CASE WHEN {t} < TIMESTAMP '1996-01-01' THEN 'train' WHEN {t} < TIMESTAMP '1997-06-01' THEN 'valid' ELSE 'test' END AS split"

QUERIES = {
    "time_split": (time_split, f"WITH {SQL_I} SELECT ord, line, {_TS.format(t='ts')} FROM x"),
    "group_time_split": (group_time_split, f"WITH {SQL_I} SELECT ord, line, {_TS.format(t='max(ts) OVER (PARTITION BY user)')} FROM x"),
    "holdout_split": (holdout, f"WITH {SQL_R} SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY ts ASC NULLS LAST, doc_id) > count(*) OVER () - floor(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM rv"),
    "seeded_holdout": (seeded_holdout, f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {seeded(42, 'doc_id')}, doc_id) > count(*) OVER () - floor(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM documents"),
    "entity_split": (entity_split, f"WITH {_ES} SELECT * FROM es"),
    "review_windows": (review_windows, f"WITH {_WIN} SELECT * FROM wi"),
    "window_dataset": (window_dataset, f"WITH {_WIN}, {_ES} SELECT split, window_size, stride, count(*) AS samples, count(DISTINCT source) AS sources FROM wi JOIN es USING (source) GROUP BY ALL"),
    "capped_reviews": (capped, "SELECT source, doc_id FROM documents WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10"),
    "trimmed_reviews": (trimmed, "WITH c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, greatest(1, 400 // least(50, (SELECT count(DISTINCT source) FROM documents))) AS cap FROM documents) SELECT source, doc_id FROM c WHERE r <= cap ORDER BY source, doc_id LIMIT 400"),
    "round_robin": (round_robin, "SELECT doc_id, CASE WHEN p > 420 THEN 1 ELSE (p - 1) % 7 + 1 END AS grp FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents)"),
    "power_law_groups": (power_law, f"WITH g AS (SELECT DISTINCT (doc_id % 50)::INT AS grp FROM documents), n AS (SELECT count(*) AS n FROM documents), r AS (SELECT grp, CASE grp WHEN 0 THEN 120 WHEN 1 THEN 80 END AS h, 5 + 55 * pow({unit(42, 'grp')}, 2.5) AS r FROM g), c AS (SELECT grp, coalesce(h, greatest(1, floor(r * greatest(0, n - 200) / sum(r) FILTER (h IS NULL) OVER ())))::BIGINT AS cnt FROM r, n), e AS (SELECT grp, cnt, sum(cnt) OVER (ORDER BY grp) AS hi FROM c), a AS (SELECT grp, greatest(0, least(hi, n) - (hi - cnt)) AS cnt FROM e, n), t AS (SELECT grp, cnt + CASE WHEN grp = 0 THEN greatest(0, n - (SELECT sum(cnt) FROM c)) ELSE 0 END AS cnt FROM a, n) SELECT grp, cnt::BIGINT AS cnt FROM t WHERE cnt > 0"),
    "default_groups": (default_groups, "SELECT lang, (CASE WHEN count(*) <= 100 THEN 1 WHEN count(*) <= 1000 THEN 10 ELSE least(100, count(*) // 10) END)::INT AS groups FROM documents GROUP BY lang"),
    "truth_sample": (truth_sample, f"SELECT doc_id, (row_number() OVER (ORDER BY {seeded(42, 'doc_id')}, doc_id) - 1) // 25 + 1 AS block FROM documents QUALIFY block <= 4"),
    "synthetic_members": (members, f"SELECT doc_id, doc_id % 10000 + 1 AS member, DATE '2026-01-01' - floor({unit(42, 'doc_id')} * 365)::INT AS day FROM documents"),
    "zipf_scenario": (zipf, f"WITH c AS (SELECT source AS entity, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY source), w AS (SELECT entity, rank, sum(1 / rank::DOUBLE) OVER (ORDER BY rank) / sum(1 / rank::DOUBLE) OVER () AS hi, coalesce(sum(1 / rank::DOUBLE) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / sum(1 / rank::DOUBLE) OVER () AS lo FROM c), u AS (SELECT {unit(42, 'i')} AS u FROM range(10000) t(i)) SELECT entity, count(*) AS requests FROM u JOIN w ON u >= lo AND u < hi GROUP BY entity"),
    "negative_samples": (negatives, _NEGATIVES),
    "eval_lists": (eval_lists, _EVAL),
    "list_metrics": (list_metrics, f"WITH {_LISTS}, {_metrics()} SELECT * FROM m"),
    "ranking_metrics": (ranking, f"""WITH {_LISTS}, {_metrics(tie='item')}, f AS (SELECT grp, arg_min(user, item) AS u, min(item) AS i FROM sl WHERE label = 1 GROUP BY grp), tr AS (SELECT * FROM sl WHERE grp % 5 = 0 AND item % 3 > 0),
j AS (SELECT m.*, CASE WHEN u NOT IN (SELECT user FROM tr) THEN 'user_cold' WHEN i NOT IN (SELECT item FROM tr) THEN 'item_cold' ELSE 'warm' END AS part FROM m JOIN f USING (grp)), b AS (SELECT * FROM j UNION ALL SELECT * REPLACE ('all' AS part) FROM j) SELECT part, {_MEAN} FROM b GROUP BY part"""),
    "auc": (auc, f"WITH {_LISTS}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM sl) SELECT round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 9)::DOUBLE AS auc FROM r"),
    "popularity_baseline": (popularity, f"WITH {_LISTS}, pc AS (SELECT item, sum(label)::DOUBLE AS pop FROM sl GROUP BY item), ps AS (SELECT sl.*, pop FROM sl JOIN pc USING (item)), {_metrics('pop', 'item', 'ps')} SELECT {_MEAN} FROM m"),
    "random_baseline": (random_lists, f"WITH {_LISTS}, rs AS (SELECT * REPLACE ({unit(42, 'grp', 'item')} AS score) FROM sl), {_metrics('score', 'item', 'rs')} SELECT {_MEAN} FROM m"),
    "ranked_candidates": (candidates, f"WITH {_CAND} SELECT * FROM f"),
    "active_recommendations": (active_recommendations, f"WITH {_CAND}, a AS (SELECT user_key, restaurant, rank, 'v' || (restaurant % 3)::VARCHAR AS pipeline_version FROM f WHERE restaurant % 3 < 2) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY rank) <= 3"),
}
