"""Dataset building: category payloads, label tables, structure reports, schema mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import text as T


def valid_review(df: DataFrame, text: str, *ids: str) -> DataFrame:
    """Rows with text and one of the ids."""
    return df.where((F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0) & F.coalesce(*[F.col(i).cast("string") for i in ids]).isNotNull())


def valid_entity(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) > 0)


def rated_reviews(df: DataFrame, rating: str = "Rating", text: str = "Review") -> DataFrame:
    """Rating 0, 1 or 2 and some text; is_recommended for 1 and 2."""
    r = F.trim(F.col(rating).cast("string"))
    return df.where(r.isin("0", "1", "2") & (F.length(F.trim(F.col(text))) > 0)).withColumn("is_recommended", r.isin("1", "2"))


#: Current column: older names, and whether it is a number.
SCHEMA = {"id": (("id", "review_id"), True), "restaurant_id": (("restaurant_id",), True), "member_id": (("member_id", "user_id"), True), "group_id": (("group_id", "group"), True), "content": (("content", "review"), False), "created_at": (("created_at", "datetime"), False)}


def to_schema(df: DataFrame) -> DataFrame:
    """Older and current review columns as the current ones; number-like ids become numbers."""
    out = []
    for name, (names, number) in SCHEMA.items():
        have = [F.col(n).cast("string") for n in names if n in df.columns]
        c = F.coalesce(*have) if have else F.lit(None).cast("string")
        out.append((c.try_cast("long") if number else c).alias(name))
    return df.select(*out)


def from_schema(df: DataFrame) -> DataFrame:
    """Current columns under the older names."""
    return df.select(F.col("id").alias("review_id"), "restaurant_id", F.col("member_id").alias("user_id"), F.col("group_id").alias("group"), F.col("content").alias("review"), F.col("created_at").alias("datetime"))


def image_urls(c: Column) -> Column:
    """URLs from JSON text: an object, a list of objects, or a list of texts."""
    one = F.from_json(c, "struct<image_url:string,url:string>")
    many = F.from_json(c, "array<struct<image_url:string,url:string>>")
    texts = F.from_json(c, "array<string>")
    list_urls = F.filter(F.transform(many, lambda x: F.coalesce(x["image_url"], x["url"])), lambda x: x.isNotNull())
    plain = F.filter(texts, lambda x: x.isNotNull() & ~x.startswith("{"))
    single = F.when(F.coalesce(one["image_url"], one["url"]).isNotNull(), F.array(F.coalesce(one["image_url"], one["url"])))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(F.ltrim(c).startswith("{"), single), F.when(F.size(list_urls) > 0, list_urls), F.when(F.size(plain) > 0, plain), empty)


def preprocess(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds clean (normalised) and sentences; rows whose clean text is empty are dropped."""
    return df.withColumn("clean", T.normalize_text(F.col(text))).where("clean <> ''").withColumn("sentences", T.sentences(F.col("clean")))


def category_payload(df: DataFrame, sample: str, order: str, text: str, hints: dict, n: int = 8) -> DataFrame:
    """(sample, service, price, food): the first n texts of each class, in order. Texts beyond n are cut by a
    row number before they are gathered."""
    d = df.where(F.trim(text) != "").select(sample, order, F.trim(text).alias("t"), T.review_class(F.col(text), hints).alias("c"))
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(sample, "c").orderBy(order))).where(F.col("_rn") <= n)
    lists = [F.transform(F.sort_array(F.collect_list(F.when(F.col("c") == c, F.struct("_rn", "t")))), lambda x: x["t"]).alias(c) for c in J.CATEGORIES]
    return d.groupBy(sample).agg(*lists)


def label_table(samples: DataFrame, outputs: DataFrame, key: str, forbidden: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(labels, counters): samples (key, payload struct) with the generated texts (key, raw) that pass the
    quality filter, and the number of rows for each reason."""
    j = samples.join(outputs, key).withColumn("output", J.relaxed_json(F.col("raw")))
    j = j.withColumn("reason", J.quality_reason(F.col("output"), forbidden))
    labels = j.where("reason = 'ok'").select(key, F.to_json("payload").alias("instruction"), "output", F.lit("teacher").alias("label_source"))
    return labels, j.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def structure_report(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """One row: share that parses, has the schema (of all, of the parsed), and the mean length ratio."""
    parsed = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(pred))).startswith("OBJECT"), F.lit(False))
    ok = parsed & J.schema_ok(F.col(pred))
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    n, p, s = F.count(F.lit(1)), F.sum(parsed.cast("int")), F.sum(ok.cast("int"))
    return df.agg(n.alias("rows"), share(p, n).alias("parse_rate"), share(s, n).alias("schema_rate"), share(s, p).alias("schema_rate_parsed"), F.round(F.avg(F.length(pred) / F.nullif(F.length(ref), F.lit(0))), 6).alias("length_ratio"))
