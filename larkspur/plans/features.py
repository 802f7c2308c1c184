"""Queries of the feature operators. Interactions come from orders and lineitem: the user is the
customer, the item the part, its category the part's type, its tier from the retail price, its region
the supplier's nation; the return flag stands for the event."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import features as O
from .base import table

FLAGS = {"r": "REVIEW", "a": "CLICK", "n": "IMPRESSION"}
FIELDS = ["category", "tier", "region", "slot"]


def interactions(spark, d):
    l, o, p, s, n = (table(spark, d, t) for t in ("lineitem", "orders", "part", "supplier", "nation"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    hour = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(24))
    ts = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=hour.cast("int"))
    rows = j.select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("p_type").alias("category"), R.price_tier(F.col("p_retailprice") * 12).alias("tier"), F.round("p_retailprice", 2).alias("price"), F.trim("n_name").alias("region"), ts.alias("ts"), F.lower("l_returnflag").alias("flag"))
    return O.with_signals(rows, "flag", FLAGS).withColumn("slot", R.time_slot(F.col("ts")))


SQL_I = """i AS (SELECT l_orderkey AS ord, l_linenumber AS line, o_custkey AS user, l_partkey AS item, p_type AS category,
CASE WHEN p_retailprice * 12 < 10000 THEN 'LOW' WHEN p_retailprice * 12 < 20000 THEN 'MID' ELSE 'HIGH' END AS tier, round(p_retailprice, 2)::DOUBLE AS price, trim(n_name) AS region,
o_orderdate::TIMESTAMP + to_hours((l_orderkey * 7 + l_linenumber) % 24) AS ts, CASE lower(l_returnflag) WHEN 'r' THEN 'REVIEW' WHEN 'a' THEN 'CLICK' ELSE 'IMPRESSION' END AS signal
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT *, (signal <> 'IMPRESSION')::INT AS label, CASE signal WHEN 'REVIEW' THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS weight,
CASE WHEN hour(ts) < 10 THEN 'breakfast' WHEN hour(ts) < 14 THEN 'lunch' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'dinner' END AS slot FROM i)"""
SQL_TIER = "CASE tier WHEN 'LOW' THEN 0.2::DOUBLE WHEN 'HIGH' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END"
SQL_ITEMS = """t AS (SELECT item, sum(weight) AS w, sum(label) AS positives, count(*) AS n FROM x GROUP BY item),
tm AS (SELECT max(ln(1 + w)) AS mw, max(ln(1 + positives)) FILTER (positives > 0) AS mp FROM t),
items AS (SELECT item, round(ln(1 + w) / nullif(mw, 0), 9) AS popularity, round(coalesce(ln(1 + positives) / mp, 0.0), 9) AS signal_count, round(w / n, 9) AS avg_weight, positives::BIGINT AS positives FROM t, tm)"""
SQL_USERS = f"""uc AS (SELECT user, category, count(*) AS cnt FROM x WHERE label = 1 GROUP BY ALL), ur AS (SELECT user, region, count(*) AS cnt FROM x WHERE label = 1 GROUP BY ALL),
up AS (SELECT user, round(avg({SQL_TIER}), 9) AS price_mean FROM x WHERE label = 1 GROUP BY user),
ut AS (SELECT user, region AS top_region FROM ur QUALIFY row_number() OVER (PARTITION BY user ORDER BY cnt DESC, region) = 1),
us AS (SELECT up.user, price_mean, top_region FROM up LEFT JOIN ut USING (user))"""


def events_signals(spark, d):
    e = table(spark, d, "events")
    return O.with_signals(e, names={"purchase": "REVIEW", "click": "CLICK", "signup": "SAVE"}).select("event_id", "signal", "label", "weight", R.day_of_week(F.col("ts")).alias("dow"), R.time_slot(F.col("ts")).alias("slot"))


def enriched(spark, d):
    """Events joined to the last customer and last order of the key (order key as dt)."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), "event_type")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.trim("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("dt"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("dt"))
    return O.enrich_events(e, c, o, "k")


def item_stats(spark, d):
    return O.item_stats(interactions(spark, d))


def popular_items(spark, d):
    return O.item_stats(interactions(spark, d)).select("item", "positives").orderBy(F.desc("positives"), "item").limit(1000)


def user_category(spark, d):
    return O.user_counts(interactions(spark, d), "category")


def user_stats(spark, d):
    return O.user_stats(interactions(spark, d))


def vocab(spark, d):
    return O.build_vocab(interactions(spark, d), FIELDS, 2)


def encoded(spark, d):
    i = interactions(spark, d)
    return O.encode(i, O.build_vocab(i.where("label = 1"), FIELDS, 2), FIELDS).select("ord", "line", *[f"{f}_idx" for f in FIELDS])


def feature_sizes(spark, d):
    return O.feature_sizes(vocab(spark, d))


def lookups(i):
    return {"items": O.item_stats(i).drop("positives"), "categories": O.user_counts(i, "category"), "regions": O.user_counts(i, "region"), "users": O.user_stats(i)}


def exp_features(spark, d):
    i = interactions(spark, d)
    look = lookups(i)
    maxima = look["categories"].agg(F.max("cnt").alias("max_category")).crossJoin(look["regions"].agg(F.max("cnt").alias("max_region")))
    return O.exp_features(O.attach_exp(i, look), maxima).select("ord", "line", *[F.col(c).cast("double").alias(c) for c in O.EXP_FEATURES if c not in ("user_category_match", "distance_weight")])


def user_profiles(spark, d):
    u = O.user_features(interactions(spark, d))
    return u.select("user", F.array_join(F.transform(O.preferred(F.col("preferred")), lambda x: x["category"]), "|").alias("top3"), "median_price", F.round(F.try_element_at("slots", F.lit("lunch")), 6).alias("lunch"))


NOW = "TIMESTAMP '1998-06-01'"


def feedback(spark, d):
    return O.feedback_30d(interactions(spark, d), F.expr(NOW))


def rule_scores(spark, d):
    """Candidates (the last month's pairs) by the rule score."""
    i = interactions(spark, d)
    profile = O.user_features(i).select("user", F.transform(O.preferred(F.col("preferred")), lambda x: x["category"]).alias("cats"), "slots", R.price_tier(F.col("median_price") * 12).alias("avg_tier"))
    rows = i.where(F.col("ts") > F.expr(NOW)).select("ord", "line", "user", "item", "category", "tier", "slot").join(profile, "user")
    parts = {"category_match": F.array_contains("cats", F.col("category")).cast("double"), "price_match": (F.col("avg_tier") == F.col("tier")).cast("double"), "time_match": F.coalesce(F.try_element_at("slots", F.col("slot")), F.lit(0.0))}
    return rows.select("ord", "line", "user", "item", F.round(R.rule_score(parts), 12).alias("score"))


def splits(spark, d):
    i = interactions(spark, d)
    return i.withColumn("split", F.when(F.col("ts") < F.lit("1997-01-01").cast("timestamp"), "train").when(F.col("ts") < F.lit("1998-01-01").cast("timestamp"), "valid").otherwise("test"))


def feature_dist(spark, d):
    return O.feature_dist(splits(spark, d), ["weight", "price", "label"]).drop("top")


def feature_top(spark, d):
    return O.feature_dist(splits(spark, d).withColumn("quarter", F.quarter("ts")), ["weight", "label", "quarter"]).select("split", "feature", "top")


def split_meta(spark, d):
    return O.split_meta(splits(spark, d))


def contract_ids(spark, d):
    """Ids cast by contract: order priorities hold texts, keys numbers."""
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).otherwise(F.col("o_orderpriority"))
    n, bad = O.cast_user_id(raw)
    return o.select("o_orderkey", n.alias("id"), bad.alias("bad"))


def context(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.to_json(F.struct(R.day_of_week(F.col("ts")).alias("dow"), R.time_slot(F.col("ts")).alias("slot"), R.distance_bucket(F.col("value") * 20).alias("distance"))).alias("snapshot"), R.distance_score(R.distance_bucket(F.col("value") * 20)).alias("score"))


_DIST = "CASE WHEN value * 20 < 300 THEN 'NEAR' WHEN value * 20 < 700 THEN 'WALK' WHEN value * 20 < 1500 THEN 'MID' WHEN value IS NOT NULL THEN 'FAR' END"
_SLOT = "CASE WHEN hour(ts) < 10 THEN 'breakfast' WHEN hour(ts) < 14 THEN 'lunch' WHEN hour(ts) < 18 THEN 'afternoon' WHEN ts IS NOT NULL THEN 'dinner' END"
SQL_SPLIT = "s AS (SELECT *, CASE WHEN ts < TIMESTAMP '1997-01-01' THEN 'train' WHEN ts < TIMESTAMP '1998-01-01' THEN 'valid' ELSE 'test' END AS split FROM x)"
SQL_LONG = "long AS (SELECT split, unnest(['category','tier','region','slot']) AS field, unnest([category, tier, region, slot]) AS value, label FROM s)"
SQL_VOCAB = "(SELECT field, value, count(*) AS cnt, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS idx FROM long {where} GROUP BY field, value HAVING count(*) >= 2)"
_PROFILE = """cs AS (SELECT user, category, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user) AS s FROM x WHERE label = 1 GROUP BY user, category),
c3 AS (SELECT user, list(category ORDER BY round(s, 9) DESC, category)[1:3] AS cats FROM cs GROUP BY user),
ss AS (SELECT user, slot, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user), 9) AS s FROM x WHERE label = 1 GROUP BY user, slot),
mp AS (SELECT user, round(quantile_cont(price, 0.5), 6) AS median_price FROM x WHERE label = 1 GROUP BY user)"""

QUERIES = {
    "events_signals": (events_signals, f"SELECT event_id, CASE event_type WHEN 'purchase' THEN 'REVIEW' WHEN 'click' THEN 'CLICK' WHEN 'signup' THEN 'SAVE' ELSE 'IMPRESSION' END AS signal, (event_type IN ('purchase','click','signup'))::INT AS label, CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'signup' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS weight, (isodow(ts) - 1)::INT AS dow, {_SLOT} AS slot FROM events"),
    "enriched_events": (enriched, "WITH o AS (SELECT o_custkey AS k, o_orderpriority AS priority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT user_id AS k, event_id, event_type, trim(c_mktsegment) AS segment, priority FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN o ON user_id = o.k"),
    "item_stats": (item_stats, f"WITH {SQL_I}, {SQL_ITEMS} SELECT * FROM items"),
    "popular_items": (popular_items, f"WITH {SQL_I} SELECT item, sum(label)::BIGINT AS positives FROM x GROUP BY item ORDER BY positives DESC, item LIMIT 1000"),
    "user_category_counts": (user_category, f"WITH {SQL_I}, {SQL_USERS} SELECT * FROM uc"),
    "user_stats": (user_stats, f"WITH {SQL_I}, {SQL_USERS} SELECT * FROM us"),
    "vocabulary": (vocab, f"WITH {SQL_I}, {SQL_SPLIT}, {SQL_LONG} SELECT * FROM {SQL_VOCAB.format(where='')}"),
    "encoded": (encoded, f"WITH {SQL_I}, {SQL_SPLIT}, {SQL_LONG}, v AS {SQL_VOCAB.format(where='WHERE label = 1')} SELECT ord, line, " + ", ".join(f"coalesce((SELECT idx FROM v WHERE field = '{f}' AND value = x.{f}), 0)::INT AS {f}_idx" for f in FIELDS) + " FROM x"),
    "feature_sizes": (feature_sizes, f"WITH {SQL_I}, {SQL_SPLIT}, {SQL_LONG}, v AS {SQL_VOCAB.format(where='')} SELECT field, count(*) + 1 AS size FROM v GROUP BY field"),
    "exp_features": (exp_features, f"""WITH {SQL_I}, {SQL_ITEMS}, {SQL_USERS}, m AS (SELECT (SELECT max(cnt) FROM uc) AS mc, (SELECT max(cnt) FROM ur) AS mr)
SELECT ord, line, coalesce(popularity, 0.0) AS popularity, coalesce(signal_count, 0.0) AS signal_count, coalesce(avg_weight, 0.0) AS avg_weight,
round(coalesce(ln(1 + coalesce(uc.cnt, 0)) / nullif(ln(1 + mc), 0), 0.0), 9) AS user_category_count, round(coalesce(ln(1 + coalesce(ur.cnt, 0)) / nullif(ln(1 + mr), 0), 0.0), 9) AS user_region_count,
coalesce(price_mean, 0.5) AS user_price_mean, coalesce((top_region = x.region)::INT::DOUBLE, 0.0) AS user_region_match, round(least(1.0, abs({SQL_TIER} - coalesce(price_mean, 0.5)) / 3.0), 9) AS price_diff
FROM x LEFT JOIN items USING (item) LEFT JOIN uc ON uc.user = x.user AND uc.category = x.category LEFT JOIN ur ON ur.user = x.user AND ur.region = x.region LEFT JOIN us ON us.user = x.user, m"""),
    "user_profiles": (user_profiles, f"WITH {SQL_I}, {_PROFILE} SELECT user, array_to_string(cats, '|') AS top3, median_price, (SELECT round(s, 6) FROM ss WHERE ss.user = mp.user AND slot = 'lunch') AS lunch FROM mp JOIN c3 USING (user)"),
    "feedback_30d": (feedback, f"WITH {SQL_I} SELECT user, item, round(avg(weight), 9) AS feedback FROM x WHERE ts <= {NOW} AND ts > {NOW} - INTERVAL 30 DAY GROUP BY user, item"),
    "rule_scores": (rule_scores, f"WITH {SQL_I}, {_PROFILE} SELECT ord, line, x.user, item, round(list_contains(cats, category)::INT * 0.30::DOUBLE + (CASE WHEN median_price * 12 < 10000 THEN 'LOW' WHEN median_price * 12 < 20000 THEN 'MID' ELSE 'HIGH' END = tier)::INT * 0.15::DOUBLE + coalesce(s, 0.0) * 0.15::DOUBLE, 12) AS score FROM x JOIN c3 USING (user) JOIN mp USING (user) LEFT JOIN ss ON ss.user = x.user AND ss.slot = x.slot WHERE ts > {NOW}"),
    "feature_dist": (feature_dist, f"WITH {SQL_I}, {SQL_SPLIT}, l AS (SELECT split, unnest(['weight','price','label']) AS feature, unnest([weight, price, label::DOUBLE]) AS v FROM s) SELECT split, feature, count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0.0), 6) AS std FROM l GROUP BY split, feature"),
    "feature_top": (feature_top, f"WITH {SQL_I}, {SQL_SPLIT}, l AS (SELECT split, unnest(['weight','label','quarter']) AS feature, unnest([weight, label::DOUBLE, quarter(ts)::DOUBLE]) AS v FROM s), c AS (SELECT split, feature, v, count(*) AS c FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY split, feature ORDER BY c DESC, v) AS r FROM c QUALIFY r <= 5) SELECT split, feature, string_agg(round(v, 4)::VARCHAR || ':' || c::VARCHAR, ',' ORDER BY r) AS top FROM r GROUP BY split, feature"),
    "split_meta": (split_meta, f"WITH {SQL_I}, {SQL_SPLIT} SELECT split, count(DISTINCT user) AS users, count(DISTINCT item) AS items, sum(label)::BIGINT AS positives FROM s GROUP BY split"),
    "contract_ids": (contract_ids, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey END AS id, o_orderkey % 3 = 2 AS bad FROM orders"),
    "context_snapshots": (context, f"SELECT event_id, '{{' || array_to_string(list_filter(['\"dow\":' || (isodow(ts) - 1)::VARCHAR, '\"slot\":\"' || {_SLOT} || '\"', '\"distance\":\"' || {_DIST} || '\"'], lambda v: v IS NOT NULL), ',') || '}}' AS snapshot, CASE {_DIST} WHEN 'NEAR' THEN 1.0::DOUBLE WHEN 'WALK' THEN 0.8::DOUBLE WHEN 'MID' THEN 0.5::DOUBLE WHEN 'FAR' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS score FROM events"),
}
