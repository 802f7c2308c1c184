"""Queries of JSON functions and dataset building. Generated answers are built from conversations: good
JSON, JSON with the usual faults, and plain text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import rules as R
from ..operators import datasets as D
from .base import HINTS, sql_any, table, texts
from .phrases import _SENT, _norm


def answers(spark, d):
    """(id, raw): JSON of each turn, every 5th with a fault of its kind, every 7th cut off."""
    c = table(spark, d, "conversations")
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "")
    cell = lambda extra="": F.concat(F.lit('{"summary":"'), t, F.lit('","bullets":["a","b"],"evidence":[0,1]' + extra + "}"))
    good = F.concat(F.lit('{"service":'), cell(), F.lit(',"price":'), cell(), F.lit(',"food":'), cell(), F.lit(',"overall_summary":{"summary":"'), t, F.lit('"}}'))
    n = F.pmod(F.col("conv_id") * 31 + F.col("turn"), F.lit(35))
    raw = F.when(n % 7 == 6, F.substring(good, 1, 40)).when(n % 5 == 1, F.regexp_replace(good, r"\}$", ",}")).when(n % 5 == 2, F.replace(good, F.lit('"service":'), F.lit("service:"))).when(n % 5 == 3, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(n % 5 == 4, F.replace(good, F.lit('"price":'), F.lit("'price':"))).otherwise(good)
    return c.select("conv_id", "turn", F.xxhash64("conv_id", "turn", "text").alias("h"), n.alias("n"), good.alias("good"), raw.alias("raw"))


def relaxed(spark, d):
    a = answers(spark, d)
    s = J.parse_relaxed(F.col("raw"))
    return a.select("conv_id", "turn", s["price"]["summary"].alias("price"), F.size(s["food"]["bullets"]).alias("bullets"))


def repaired(spark, d):
    s = J.repair_summary(F.from_json("good", J.SUMMARY), 1, 80, 10)
    return answers(spark, d).select("conv_id", "turn", F.to_json(s["food"]).alias("food"))


def postprocessed(spark, d):
    s = J.postprocess(F.from_json("good", J.SUMMARY), {k: F.lit(i) for i, k in enumerate(J.CATEGORIES)})
    return answers(spark, d).select("conv_id", "turn", s["service"]["summary"].alias("service"), F.size(s["price"]["bullets"]).alias("price_bullets"), F.size(s["food"]["evidence"]).alias("food_evidence"))


def stripped(spark, d):
    return answers(spark, d).select("conv_id", "turn", F.to_json(J.drop_evidence(F.from_json("good", J.SUMMARY))["price"]).alias("price"))


def quality(spark, d):
    return answers(spark, d).withColumn("reason", J.quality_reason(F.col("raw"), ("the of",))).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def structure(spark, d):
    return D.structure_report(answers(spark, d), "raw", "good")


def labelled(spark, d):
    a = answers(spark, d)
    samples = a.select("h", F.struct("conv_id", "turn").alias("payload"))
    return D.label_table(samples, a.select("h", "raw"), "h")[1]


def judged(spark, d):
    c = table(spark, d, "conversations")
    good = F.concat(F.lit('{"accuracy": '), (F.length("text") % 8).cast("string"), F.lit(', "fluency": '), (F.col("turn") % 6).cast("string"), F.lit(', "reason": "r"'))
    raw = F.when(F.col("conv_id") % 3 == 0, good).otherwise(F.concat(good, F.lit("}")))
    p = J.parse_judge(F.col("raw"), ("accuracy", "fluency"))
    return c.select("conv_id", "turn", F.length("text").alias("n"), raw.alias("raw")).select("conv_id", "turn", "n", p["accuracy"].alias("accuracy"), p["fluency"].alias("fluency"), p["score"].alias("score"))


def payload(spark, d):
    p = D.category_payload(table(spark, d, "documents"), "source", "doc_id", "text", HINTS)
    return p.select("source", *[F.size(c).alias(f"n_{c}") for c in J.CATEGORIES], *[F.md5(F.array_join(c, "|")).alias(f"md5_{c}") for c in J.CATEGORIES])


def mapped(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("review_id"), F.regexp_extract("source", r"\d+", 0).alias("restaurant_id"), F.col("lang").alias("user_id"), F.col("text").alias("review"))
    return D.from_schema(D.to_schema(old)).select("review_id", "restaurant_id", "user_id", F.md5("review").alias("md5"))


def images(spark, d):
    p = table(spark, d, "pages")
    u = F.col("url")
    raw = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct(u.alias("image_url")))).when(F.col("page_id") % 3 == 1, F.to_json(F.array(F.struct(u.alias("url")), F.struct(u.alias("url"))))).otherwise(F.to_json(F.array(u)))
    return p.select("page_id", F.array_join(D.image_urls(raw), " ").alias("urls"))


def recommended(spark, d):
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") % 5).cast("int").cast("string").alias("Rating"), F.col("l_returnflag").alias("Review"))
    return D.rated_reviews(o).groupBy("is_recommended", "Rating").agg(F.count(F.lit(1)).alias("rows"))


def visits(spark, d):
    """Visit dates and places in the short forms that seed files use."""
    e = table(spark, d, "events")
    short = F.concat_ws(".", F.date_format("ts", "yy"), F.month("ts").cast("string"), (F.col("event_id") % 33).cast("string"), F.lit("x"))
    url = F.concat(F.lit("https://x.example/place/"), F.col("user_id").cast("string"), F.lit("?e=1"))
    return e.select("event_id", F.date_format(R.visit_date(short), "yyyy-MM-dd").alias("day"), R.place_id(url).alias("place"))


def preprocessed(spark, d):
    return D.preprocess(texts(spark, d)).select("doc_id", F.size("sentences").alias("n"))


def event_props(spark, d):
    """Fields of the events' JSON; broken or missing ones are null."""
    e = table(spark, d, "events")
    return e.select("event_id", F.map_keys(F.from_json("props", "map<string,string>")).alias("k")).select("event_id", F.array_join(F.array_sort("k"), ",").alias("keys"))


_T = "regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')"
_A = f"a AS (SELECT conv_id, turn, {_T} AS t, (conv_id * 31 + turn) % 35 AS n FROM conversations)"
_CLS = f"CASE WHEN {sql_any('x', [h.replace(' ', '') for h in HINTS['price']])} THEN 'price' WHEN {sql_any('x', [h.replace(' ', '') for h in HINTS['service']])} THEN 'service' ELSE 'food' END"
_FB = "CASE WHEN trim(t) = '' THEN '{f}' ELSE trim(t) END"

#: Length of a good answer without its texts.
_EMPTY = len('{"service":' + '{"summary":"","bullets":["a","b"],"evidence":[0,1]},"price":' * 2 + '{"summary":"","bullets":["a","b"],"evidence":[0,1]}' + ',"overall_summary":{"summary":""}}') - len('"price":') + len('"food":')
_LEN = f"l AS (SELECT *, length(t) * 4 + {_EMPTY} AS good, CASE WHEN n % 7 = 6 THEN 40 WHEN n % 5 = 1 THEN length(t) * 4 + {_EMPTY} + 1 WHEN n % 5 = 2 THEN length(t) * 4 + {_EMPTY} - 2 WHEN n % 5 = 3 THEN length(t) * 4 + {_EMPTY} + 12 ELSE length(t) * 4 + {_EMPTY} END AS raw FROM a)"

QUERIES = {
    "relaxed_json": (relaxed, f"WITH {_A} SELECT conv_id, turn, CASE WHEN n % 7 < 6 THEN t END AS price, CASE WHEN n % 7 < 6 THEN 2 END AS bullets FROM a"),
    "repaired_summaries": (repaired, f"WITH {_A} SELECT conv_id, turn, '{{\"summary\":\"' || substr(trim(t), 1, 10) || '\",\"bullets\":[\"a\"],\"evidence\":[0]}}' AS food FROM a"),
    "postprocessed_summaries": (postprocessed, f"WITH {_A} SELECT conv_id, turn, {_FB.format(f='Few mentions.')} AS service, 1 AS price_bullets, 2 AS food_evidence FROM a"),
    "summaries_without_evidence": (stripped, f"WITH {_A} SELECT conv_id, turn, '{{\"summary\":\"' || t || '\",\"bullets\":[\"a\",\"b\"]}}' AS price FROM a"),
    "quality_reasons": (quality, f"WITH {_A}, r AS (SELECT CASE WHEN n % 7 = 6 OR n % 5 > 0 THEN 'not_dict' WHEN length(t) * 4 + 6 < 50 THEN 'too_short' WHEN length(t) * 4 + 6 > 8000 THEN 'too_long' WHEN contains(t, 'the of') THEN 'forbidden:the of' ELSE 'ok' END AS reason FROM a) SELECT reason, count(*) AS rows FROM r GROUP BY reason"),
    "structure_report": (structure, f"WITH {_A}, {_LEN} SELECT count(*) AS rows, round(avg((n % 7 < 6 AND n % 5 = 0)::INT), 6) AS parse_rate, round(avg((n % 7 < 6 AND n % 5 = 0)::INT), 6) AS schema_rate, 1.0::DOUBLE AS schema_rate_parsed, round(avg(raw / good), 6) AS length_ratio FROM l"),
    "label_counters": (labelled, f"WITH {_A}, r AS (SELECT CASE WHEN n % 7 = 6 THEN 'not_dict' WHEN length(t) * 4 + 6 < 50 THEN 'too_short' WHEN length(t) * 4 + 6 > 8000 THEN 'too_long' ELSE 'ok' END AS reason FROM a) SELECT reason, count(*) AS rows FROM r GROUP BY reason"),
    "judge_scores": (judged, "WITH j AS (SELECT conv_id, turn, length(text) AS n, greatest(1, least(5, length(text) % 8))::INT AS accuracy, greatest(1, least(5, turn % 6))::INT AS fluency FROM conversations) SELECT *, round_even((accuracy + fluency) / 2, 2)::DOUBLE AS score FROM j"),
    "category_payload": (payload, f"WITH c AS (SELECT source, doc_id, trim(text, ' ') AS t, {_CLS} AS c FROM (SELECT *, replace(text, ' ', '') AS x FROM documents WHERE trim(text, ' ') <> '')), r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source, c ORDER BY doc_id) <= 8) SELECT source, " + ", ".join(f"count(*) FILTER (c = '{k}')::INT AS n_{k}, md5(coalesce(string_agg(t, '|' ORDER BY doc_id) FILTER (c = '{k}'), '')) AS md5_{k}" for k in J.CATEGORIES) + " FROM r GROUP BY source"),
    "schema_mapping": (mapped, "SELECT doc_id AS review_id, regexp_extract(source, '[0-9]+')::BIGINT AS restaurant_id, NULL::BIGINT AS user_id, md5(text) AS md5 FROM documents"),
    "image_urls": (images, "SELECT page_id, CASE WHEN page_id % 3 = 1 THEN url || ' ' || url ELSE url END AS urls FROM pages"),
    "rated_reviews": (recommended, "SELECT (l_quantity::INT % 5)::VARCHAR AS Rating, l_quantity::INT % 5 > 0 AS is_recommended, count(*) AS rows FROM lineitem WHERE l_quantity::INT % 5 < 3 GROUP BY ALL"),
    "visit_dates": (visits, "SELECT event_id, strftime(coalesce(try_strptime(strftime(ts, '%Y-%m-') || lpad((event_id % 33)::VARCHAR, 2, '0'), '%Y-%m-%d'), TIMESTAMP '2025-01-01'), '%Y-%m-%d') AS day, user_id AS place FROM events"),
    "preprocessed_reviews": (preprocessed, f"WITH {_norm()} SELECT doc_id, len({_SENT})::INT AS n FROM nt WHERE text <> ''"),
    "event_props": (event_props, "SELECT event_id, array_to_string(list_sort(json_keys(props::JSON)), ',') AS keys FROM events"),
}
