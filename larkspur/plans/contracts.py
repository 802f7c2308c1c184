"""Queries of sources, sinks, profile features and text rules that no other plan reaches. Files are
written by Spark from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import text as T
from ..operators import datasets as D
from ..operators import evaluation as E
from ..operators import features as O
from ..operators import sampling as S
from ..scratch import new_folder
from ..sources import readers as I
from ..sources import writers as W
from .base import KEYWORDS, sql_any, table
from .features import SQL_I, SQL_ITEMS, SQL_USERS, interactions, lookups
from .sampling import SQL_R, reviews


def stopwords(spark, d):
    """Lines with blanks around and between them, and repeats."""
    path = new_folder(spark, "plans")
    x = table(spark, d, "documents")
    x.select(F.explode(F.array(F.concat(F.lit(" "), "source", F.lit(" ")), F.lit(""), F.col("lang"))).alias("value")).where("value is not null").write.text(path)
    return I.read_stopwords(spark, path)


def seeds(spark, d):
    """Seeds of some categories stored and read; the others keep their defaults."""
    path = new_folder(spark, "plans")
    c = table(spark, d, "customer").select(F.trim("c_mktsegment").alias("category"), F.col("c_custkey").cast("long").alias("pos"), F.col("c_name").alias("phrase"))
    W.save_seeds(c.where("category < 'F'"), path)
    return I.load_seeds(spark, path, c.withColumn("phrase", F.concat(F.lit("default "), "phrase")))


def samples(spark, d):
    """Judge samples in their three shapes, at most 512 in a file."""
    path = new_folder(spark, "plans")
    x = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 512).alias("part"), F.struct(F.col("doc_id").alias("id"), F.md5("text").alias("output")).alias("s"))
    g = x.groupBy("part").agg(F.collect_list("s").alias("s"))
    meta = F.create_map(F.lit("part"), F.col("part").cast("string")).alias("meta")
    kinds = [F.to_json(F.struct(meta, F.col("s").alias("results"))), F.to_json(F.struct(meta, F.col("s").alias("samples"))), F.to_json("s")]
    g.select(F.element_at(F.array(*kinds), (F.pmod("part", F.lit(3)) + 1).cast("int")).alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    return I.read_samples(spark, path, "struct<id:bigint,output:string>").select(F.try_element_at("meta", F.lit("part")).alias("part"), "id", "output")


def feature_files(spark, d):
    """Typed features by split, read from the files of one split."""
    path = new_folder(spark, "plans")
    i = S.time_split(interactions(spark, d), "ts", "1996-01-01", "1997-06-01").select("split", "ord", "line", "item", "label", "weight", "price")
    W.write_features(i, path)
    return spark.read.parquet(path).where("split = 'valid'").select("ord", "line", "item", "label", "weight", "price")


def lookup_tables(spark, d):
    """Look-ups saved by a training run and loaded by another."""
    path = new_folder(spark, "plans")
    W.save_lookups(lookups(interactions(spark, d)), path)
    back = W.load_lookups(spark, path, ["items", "users"])
    return back["items"].join(interactions(spark, d).select("item", "user").distinct(), "item").join(back["users"], "user").select("user", "item", "popularity", "avg_weight", "price_mean", "top_region")


def split_files(spark, d):
    """Window samples written by split, and their counts."""
    r = reviews(spark, d)
    w = S.review_windows(r, whole=False).join(S.entity_split(r, "source").select("source", "split"), "source")
    return W.write_splits(w.select("split", "source", "window_size", "stride", "start", "reviews"), new_folder(spark, "plans"))


def valid_reviews(spark, d):
    x = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("id"), F.when(F.col("doc_id") % 2 > 0, F.col("doc_id")).alias("review_id"), F.when(F.col("doc_id") % 7 > 0, F.col("text")).otherwise(F.lit("  ")).alias("text"), "doc_id")
    return D.valid_review(x, "text", "id", "review_id").select("doc_id")


def valid_entities(spark, d):
    x = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit(" ")).when(F.col("c_custkey") % 5 > 1, F.col("c_name")).alias("name"))
    return D.valid_entity(x, "name").select("c_custkey")


def united(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.trim("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return O.union_all(a, b, table(spark, d, "part").select(F.col("p_partkey").alias("key")))


def profiles(spark, d):
    """A profile and a context for each order, with JSON texts as they are stored; every 9th is broken."""
    o = table(spark, d, "orders")
    broken = F.col("o_orderkey") % 9 == 4
    text = lambda c: F.when(broken, F.lit("{")).otherwise(F.to_json(c))
    struct = lambda c, w: F.struct(F.lit(c).alias("category"), w.alias("weight"))
    k = F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("row_id"), F.when(k % 4 > 0, k.cast("string")).alias("member_id"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("anonymous_id"),
        text(F.create_map(F.lit("spicy"), (k % 7).cast("double") / 4, F.lit("light"), -(k % 3).cast("double"))).alias("taste_preferences"),
        text(F.create_map(F.lit("lunch"), (k % 4).cast("double") / 4, F.lit("other"), F.lit(0.125))).alias("visit_time_distribution"),
        text(F.array(struct("a", (k % 3).cast("double")), struct("b", F.lit(3.0)), struct("c", (k % 2).cast("double")), struct("d", F.lit(0.5)))).alias("preferred_categories"),
        text(F.array(F.col("o_orderpriority"), F.lit("x"))).alias("categories"), F.to_json(F.array(F.struct(F.col("o_orderstatus").alias("tag")))).alias("comparison_tags"),
        F.when(k % 2 == 0, F.lit("LOW")).alias("avg_price_tier"), F.concat(F.lit(" "), (k % 11).cast("string")).alias("restaurant_id"), F.lit("MID").alias("price_tier"), F.date_format("o_orderdate", "E").alias("day_of_week"))


def base_features(spark, d):
    made = [*[f"taste_{x}" for x in O.TASTES], *[f"slot_{x}" for x in O.SLOTS], "is_anonymous", *[f"pref_w_{i}" for i in (1, 2, 3)]]
    return O.base_features(profiles(spark, d)).select("row_id", *made)


def categorical(spark, d):
    return O.categorical_fields(profiles(spark, d))


def scoring(spark, d):
    """The rules' inputs of each row from its profile and context."""
    p = profiles(spark, d)
    rows = p.select("row_id", O._profile_categories(3).alias("preferred"), J.first_of_json(F.col("categories")).alias("category"), F.col("avg_price_tier").alias("avg_tier"), F.when(F.col("row_id") % 3 == 0, F.lit("LOW")).alias("tier"), J.json_map(F.col("taste_preferences")).alias("tastes"), F.lit("spicy").alias("segment"), J.json_map(F.col("visit_time_distribution")).alias("slots"), F.when(F.col("row_id") % 2 == 0, F.lit("lunch")).otherwise(F.lit("night")).alias("slot"), F.when(F.col("row_id") % 5 == 0, F.lit("NEAR")).alias("distance"), F.when(F.col("row_id") % 4 == 0, F.lit("RAIN")).alias("weather"))
    rows = rows.withColumn("category", F.when(F.col("row_id") % 2 == 0, F.lit("b")).otherwise(F.col("category")))
    return O.scoring_features(rows).select("row_id", "category_match", "price_match", "taste_match", "time_match", "distance_score", "weather_score")


def first_values(spark, d):
    p = profiles(spark, d)
    return p.select("row_id", J.first_of_json(F.col("categories")).alias("category"), J.first_of_json(F.col("comparison_tags"), "tag").alias("tag"), J.first_of_json(F.col("taste_preferences")).alias("none"))


def resolved(spark, d):
    """Evidence numbers as the labels they point at, and the default text of blank cells."""
    x = table(spark, d, "documents").select("doc_id", "lang", F.col("source"))
    hits = F.array(F.struct(F.col("lang").alias("id")), F.struct(F.col("source").alias("id")))
    idx = F.array((F.col("doc_id") % 3).cast("int"), F.lit(-1), F.lit(1))
    cell = F.struct(F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.col("source")).alias("summary"), F.array(F.lit("x")).alias("bullets"))
    filled = J.with_default(cell, "Few mentions.")
    return x.select("doc_id", F.array_join(F.transform(J.resolve_evidence(idx, hits), lambda h: h["id"]), ",").alias("ids"), filled["summary"].alias("summary"), F.size(filled["bullets"]).alias("bullets"))


def overall(spark, d):
    """Overall texts: an own one, the joined texts of the categories, or one sentence."""
    k = F.col("doc_id")
    part = lambda n: F.struct(F.when(k % n == 0, F.lit("Few.")).when(k % n == 1, F.lit("")).otherwise(F.col("source")).alias("summary"))
    x = table(spark, d, "documents").select("doc_id", F.struct(*[part(n).alias(c) for c, n in zip(J.CATEGORIES, (2, 3, 4))], F.when(k % 5 == 0, F.struct(F.concat(F.lit("All "), "lang").alias("summary"))).alias("overall_summary")).alias("s"))
    return x.select("doc_id", J.overall_summary(F.col("s"), {c: "Few." for c in J.CATEGORIES}, "Nothing to say.").alias("text"))


def checked_sentences(spark, d):
    """Generated sentences that keep the rules: one sentence, one percentage, words required, forbidden and for large lifts."""
    k, n = F.col("doc_id"), F.pmod("doc_id", F.lit(60))
    pct = F.concat(n.cast("string"), F.lit("%"))
    said = F.when(k % 4 == 0, F.concat(F.lit("Well. It is "), pct, F.lit(" above average. Good"))).when(k % 4 == 1, F.concat(F.lit("The best, "), pct, F.lit(" above average."))).when(k % 4 == 2, F.concat(F.lit("A strength,  "), pct, F.lit(" above average."))).otherwise(F.concat(pct, F.lit(" and 5% above average.")))
    one = T.sentence_with_percent(said)
    x = table(spark, d, "documents").select("doc_id", one.alias("sentence"), n.alias("lift"))
    return x.select("doc_id", "sentence", T.valid_sentence(F.col("sentence"), F.col("lift"), ("average",), ("above",), ("best",), ("strength",)).alias("valid"), T.lift_band(F.col("lift")).alias("band"))


RULES = {"food": (KEYWORDS["food"], 3, 5), "service": (KEYWORDS["service"], 2, 3)}


def strengths(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    s = E.strength_truth(x, RULES, "source", "doc_id", "text")
    ids = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return s.select("source", "aspect", "support", ids(F.col("evidence")).alias("evidence"), ids(F.col("compared")).alias("compared"))


_BROKEN = "o_orderkey % 9 = 4"
_PC = "list_sort([(-(o_custkey % 3)::DOUBLE, 'a'), (-3.0::DOUBLE, 'b'), (-(o_custkey % 2)::DOUBLE, 'c'), (-0.5::DOUBLE, 'd')])[1:3]"
_PF = f"pf AS (SELECT *, CASE WHEN NOT {_BROKEN} THEN {_PC} END AS pc FROM orders), pw AS (SELECT *, list_sum(list_transform(pc, lambda x: -x[1])) AS ps FROM pf)"
_W = lambda i: f"coalesce(round(-pc[{i}][1] / ps, 9), 0.0)"
_C = lambda i: f"coalesce(pc[{i}][2], '')"
_WIN = f"""{SQL_R}, p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY ts ASC NULLS LAST, doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM rv),
cf AS (SELECT * FROM (VALUES (30, 15), (50, 25), (20, 10)) v(w, s)), st AS (SELECT source, w, s, unnest(generate_series(0, n - w, s)) AS start FROM (SELECT DISTINCT source, n FROM p WHERE n >= 2), cf WHERE w <= n),
es AS (SELECT source, CASE WHEN r < 0.8 THEN 'train' WHEN r < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT source, (row_number() OVER (ORDER BY n, source) - 0.5) / count(*) OVER () AS r FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)))"""
_SAID = "CASE doc_id % 4 WHEN 0 THEN 'It is ' || doc_id % 60 || '% above average.' WHEN 1 THEN 'The best, ' || doc_id % 60 || '% above average.' WHEN 2 THEN 'A strength, ' || doc_id % 60 || '% above average.' ELSE doc_id % 60 || '% and 5% above average.' END"
_PART = lambda n: f"CASE doc_id % {n} WHEN 0 THEN 'Few.' WHEN 1 THEN '' ELSE source END"


def _strengths() -> str:
    parts = " UNION ALL ".join(f"SELECT source, doc_id, '{a}' AS aspect, {least} AS least, {most} AS most FROM q WHERE {sql_any('text', words)}" for a, (words, least, most) in RULES.items())
    return f"""WITH q AS (SELECT source, doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), m AS ({parts}), r AS (SELECT *, row_number() OVER (PARTITION BY source, aspect ORDER BY doc_id) AS rn FROM m),
f AS (SELECT list(source ORDER BY source)[1:4] AS l FROM (SELECT DISTINCT source FROM q))
SELECT source, aspect, least(count(*), max(most)) AS support, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (rn <= most) AS evidence, array_to_string(list_filter(any_value(l), lambda o: o <> source)[1:3], ',') AS compared FROM r, f GROUP BY source, aspect HAVING count(*) >= max(least)"""


QUERIES = {
    "stopwords": (stopwords, "SELECT source AS word FROM documents WHERE source IS NOT NULL UNION SELECT lang FROM documents WHERE lang IS NOT NULL"),
    "stored_seeds": (seeds, "SELECT trim(c_mktsegment) AS category, c_custkey AS pos, CASE WHEN trim(c_mktsegment) < 'F' THEN c_name ELSE 'default ' || c_name END AS phrase FROM customer"),
    "judge_samples": (samples, "SELECT CASE WHEN doc_id // 512 % 3 < 2 THEN (doc_id // 512)::VARCHAR END AS part, doc_id AS id, md5(text) AS output FROM documents"),
    "feature_files": (feature_files, f"WITH {SQL_I} SELECT ord, line, item, label, weight, price FROM x WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-06-01'"),
    "lookup_tables": (lookup_tables, f"WITH {SQL_I}, {SQL_ITEMS}, {SQL_USERS} SELECT user, item, popularity, avg_weight, price_mean, top_region FROM (SELECT DISTINCT item, user FROM x) JOIN items USING (item) JOIN us USING (user)"),
    "split_files": (split_files, f"WITH {_WIN} SELECT split, w::INT AS window_size, s::INT AS stride, count(*) AS samples FROM st JOIN es USING (source) GROUP BY ALL"),
    "valid_reviews": (valid_reviews, "SELECT doc_id FROM documents WHERE doc_id % 7 > 0 AND trim(text, ' ') <> '' AND (doc_id % 3 > 0 OR doc_id % 2 > 0)"),
    "valid_entities": (valid_entities, "SELECT c_custkey FROM customer WHERE c_custkey % 5 > 1"),
    "united_tables": (united, "SELECT c_custkey AS key, c_name AS name, trim(c_mktsegment) AS segment, NULL::INT AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part"),
    "base_features": (base_features, f"WITH {_PF} SELECT o_orderkey AS row_id, CASE WHEN {_BROKEN} THEN 0.0 ELSE least(1.0, (o_custkey % 7)::DOUBLE / 4) END::DOUBLE AS taste_spicy, 0.0::DOUBLE AS taste_sweet, 0.0::DOUBLE AS taste_savory, 0.0::DOUBLE AS taste_light, 0.0::DOUBLE AS slot_breakfast, CASE WHEN {_BROKEN} THEN 0.0 ELSE (o_custkey % 4)::DOUBLE / 4 END::DOUBLE AS slot_lunch, 0.0::DOUBLE AS slot_afternoon, 0.0::DOUBLE AS slot_dinner, (o_custkey % 4 = 0)::INT::DOUBLE AS is_anonymous, {_W(1)} AS pref_w_1, {_W(2)} AS pref_w_2, {_W(3)} AS pref_w_3 FROM pw"),
    "categorical_fields": (categorical, f"WITH {_PF} SELECT o_orderkey AS row_id, CASE WHEN o_custkey % 4 > 0 THEN 'u_' || o_custkey ELSE '' END AS member_key, 'a_c' || o_custkey % 5 AS cohort_key, CASE WHEN o_custkey % 2 = 0 THEN 'LOW' ELSE '' END AS avg_price_tier, (o_custkey % 11)::VARCHAR AS restaurant_id, CASE WHEN {_BROKEN} THEN '' ELSE o_orderpriority END AS primary_category, {_C(1)} AS pref_cat_1, {_C(2)} AS pref_cat_2, {_C(3)} AS pref_cat_3, 'MID' AS price_tier, " + ", ".join(f"{'strftime(o_orderdate, ' + chr(39) + '%a' + chr(39) + ')' if c == 'day_of_week' else chr(39) * 2} AS {c}" for c in O.PLAIN_FIELDS if c != "price_tier") + ", '' AS first_segment, o_orderstatus AS first_tag FROM pw"),
    "scoring_features": (scoring, f"WITH {_PF} SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 2 = 0 AND NOT {_BROKEN} THEN 1.0 ELSE 0.0 END::DOUBLE AS category_match, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS price_match, CASE WHEN {_BROKEN} THEN 0.0 ELSE least(1.0, (o_custkey % 7)::DOUBLE / 4) END::DOUBLE AS taste_match, CASE WHEN {_BROKEN} THEN 0.0 WHEN o_orderkey % 2 = 0 AND o_custkey % 4 > 0 THEN (o_custkey % 4)::DOUBLE / 4 ELSE 0.125 END::DOUBLE AS time_match, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS distance_score, CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS weather_score FROM pw"),
    "first_values": (first_values, f"SELECT o_orderkey AS row_id, CASE WHEN NOT {_BROKEN} THEN o_orderpriority END AS category, o_orderstatus AS tag, NULL::VARCHAR AS none FROM orders"),
    "resolved_evidence": (resolved, "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ',' || source WHEN 1 THEN source || ',' || source ELSE source END AS ids, CASE WHEN doc_id % 2 = 0 THEN 'Few mentions.' ELSE source END AS summary, (doc_id % 2)::INT AS bullets FROM documents"),
    "overall_summaries": (overall, f"WITH s AS (SELECT doc_id, lang, {_PART(2)} AS a, {_PART(3)} AS b, {_PART(4)} AS c FROM documents), l AS (SELECT *, list_filter([a, b, c], lambda x: x <> '') AS parts FROM s) SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'All ' || lang WHEN a = 'Few.' AND b = 'Few.' AND c = 'Few.' OR len(parts) = 0 THEN 'Nothing to say.' ELSE array_to_string(parts, ' ') END AS text FROM l"),
    "checked_sentences": (checked_sentences, f"SELECT doc_id, {_SAID} AS sentence, doc_id % 4 = 0 OR doc_id % 4 = 2 AND doc_id % 60 >= 30 AS valid, CASE WHEN doc_id % 60 < 10 THEN 'small' WHEN doc_id % 60 < 30 THEN 'some' ELSE 'large' END AS band FROM documents"),
    "strength_truth": (strengths, _strengths()),
}
