"""Feature building: enrichment, vocabularies, item and user statistics, encoded features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by `order`; of equal ones the first by the other columns."""
    w = Window.partitionBy(key).orderBy(F.desc(order), *[F.col(c) for c in df.columns if c not in (key, order) and df.schema[c].dataType.typeName() != "map"])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def enrich_events(events: DataFrame, items: DataFrame, menus: DataFrame, key: str = "restaurant_id", order: str = "dt") -> DataFrame:
    """Events with the last row of each item and menu. Spark broadcasts a side it has measured as small."""
    return events.join(last_per_key(items, key, order).drop(order), key, "left").join(last_per_key(menus, key, order).drop(order), key, "left")


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of all, missing columns null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def with_signals(df: DataFrame, event: str = "event_type", names: dict = R.EVENT_SIGNAL) -> DataFrame:
    """Adds signal, label and weight."""
    s = R.signal_of(F.col(event), names)
    return df.withColumn("signal", s).withColumn("label", R.resolve_label(F.lit(None), s)).withColumn("weight", R.sample_weight(s))


def build_vocab(df: DataFrame, fields: list[str], cutoff: int = 0) -> DataFrame:
    """(field, value, cnt, idx): values by frequency, ties by value, idx from 1 in each field."""
    long = df.select([F.trim(F.col(f).cast("string")).alias(f) for f in fields]).unpivot([], fields, "field", "value").where("value <> ''")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= cutoff)
    return counts.withColumn("idx", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("cnt"), "value")))


def encode(df: DataFrame, vocab: DataFrame, fields: list[str]) -> DataFrame:
    """Each field's index as <field>_idx; 0 where the value is unknown."""
    for f in fields:
        one = vocab.where(F.col("field") == f).select(F.col("value").alias("_v"), F.col("idx").alias(f"{f}_idx"))
        df = df.join(one, F.trim(F.col(f).cast("string")) == F.col("_v"), "left").drop("_v").withColumn(f"{f}_idx", F.coalesce(f"{f}_idx", F.lit(0)))
    return df


def feature_sizes(vocab: DataFrame) -> DataFrame:
    """(field, size): the values and the unknown."""
    return vocab.groupBy("field").agg((F.count(F.lit(1)) + 1).alias("size"))


def item_stats(df: DataFrame, item: str = "item") -> DataFrame:
    """(item, popularity, signal_count, avg_weight, positives): log1p over its maximum, for weights and positives."""
    t = df.groupBy(item).agg(F.sum("weight").alias("w"), F.sum("label").alias("positives"), F.count(F.lit(1)).alias("n"))
    top = t.agg(F.max(F.log1p("w")).alias("mw"), F.max(F.when(F.col("positives") > 0, F.log1p("positives"))).alias("mp"))
    t = t.crossJoin(F.broadcast(top))
    return t.select(item, F.round(F.log1p("w") / F.nullif(F.col("mw"), F.lit(0.0)), 9).alias("popularity"), F.round(F.coalesce(F.log1p("positives") / F.col("mp"), F.lit(0.0)), 9).alias("signal_count"), F.round(F.col("w") / F.col("n"), 9).alias("avg_weight"), F.col("positives").cast("long").alias("positives"))


def user_counts(df: DataFrame, attribute: str, user: str = "user") -> DataFrame:
    """(user, attribute, cnt) of positive rows."""
    return df.where((F.col("label") == 1) & F.col(attribute).isNotNull()).groupBy(user, attribute).agg(F.count(F.lit(1)).alias("cnt"))


def user_stats(df: DataFrame, user: str = "user", region: str = "region", tier: str = "tier") -> DataFrame:
    """(user, price_mean, top_region) of positive rows; of equal regions the first by name."""
    pos = df.where("label = 1")
    price = pos.groupBy(user).agg(F.round(F.avg(R.tier_to_num(F.col(tier))), 9).alias("price_mean"))
    counts = user_counts(df, region, user)
    top = counts.groupBy(user).agg(F.min(F.struct((-F.col("cnt")).alias("n"), F.col(region).alias("r"))).alias("b")).select(user, F.col("b.r").alias("top_region"))
    return price.join(top, user, "left")


def attach_exp(df: DataFrame, lookups: dict[str, DataFrame], user: str = "user", item: str = "item", category: str = "category", region: str = "region") -> DataFrame:
    """Joins item_stats, (user, category), (user, region) and user_stats, with defaults 0 and 0.5."""
    d = df.join(lookups["items"], item, "left")
    d = d.join(lookups["categories"].withColumnRenamed("cnt", "category_cnt"), [user, category], "left")
    d = d.join(lookups["regions"].withColumnRenamed("cnt", "region_cnt"), [user, region], "left")
    d = d.join(lookups["users"], user, "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("popularity", "signal_count", "avg_weight")}
    return d.withColumns({**zero, "category_cnt": F.coalesce("category_cnt", F.lit(0)), "region_cnt": F.coalesce("region_cnt", F.lit(0)), "price_mean": F.coalesce("price_mean", F.lit(0.5))})


EXP_FEATURES = ("popularity", "signal_count", "avg_weight", "user_category_count", "user_region_count", "user_price_mean", "user_category_match", "user_region_match", "price_diff", "distance_weight")


def exp_features(df: DataFrame, maxima: DataFrame, names=EXP_FEATURES) -> DataFrame:
    """The derived features of attach_exp's rows; maxima has one row (max_category, max_region)."""
    d = df.crossJoin(F.broadcast(maxima))
    ratio = lambda n, top: F.coalesce(F.log1p(n) / F.nullif(F.log1p(top), F.lit(0.0)), F.lit(0.0))
    made = {
        "user_category_count": F.round(ratio("category_cnt", "max_category"), 9),
        "user_region_count": F.round(ratio("region_cnt", "max_region"), 9),
        "user_price_mean": F.col("price_mean"),
        "user_category_match": F.coalesce(F.array_contains("preferred", F.col("category")).cast("double"), F.lit(0.0)) if "preferred" in df.columns else F.lit(0.0),
        "user_region_match": F.coalesce((F.col("top_region") == F.col("region")).cast("double"), F.lit(0.0)),
        "price_diff": F.round(F.least(F.lit(1.0), F.abs(R.tier_to_num(F.col("tier")) - F.col("price_mean")) / 3.0), 9),
        "distance_weight": R.distance_weight(F.col("distance")) if "distance" in df.columns else F.lit(1.0 / 3),
    }
    return d.withColumns(made).drop(*[n for n in EXP_FEATURES if n not in names])


def preferred(c: Column, k: int = 3) -> Column:
    """The k heaviest of an array of (category, weight), weights divided by their sum: array of the same."""
    top = F.slice(F.array_sort(F.transform(c, lambda x: F.struct((-x["weight"]).alias("o"), x["category"].alias("category"), x["weight"].alias("weight")))), 1, k)
    total = F.aggregate(top, F.lit(0.0), lambda s, x: s + x["weight"])
    return F.transform(top, lambda x: F.struct(x["category"].alias("category"), F.when(total > 0, F.round(x["weight"] / total, 9)).otherwise(0.0).alias("weight")))


def user_features(df: DataFrame, user: str = "user") -> DataFrame:
    """(user, preferred, median_price, slots): shares of categories, median price, shares of time slots."""
    pos = df.where("label = 1")

    def shares(by: str, key: str) -> DataFrame:
        n = pos.where(F.col(by).isNotNull()).groupBy(user, by).agg(F.count(F.lit(1)).alias("c"))
        share = F.round(F.col("c") / F.sum("c").over(Window.partitionBy(user)), 9)
        return n.withColumn("s", share).groupBy(user).agg(F.sort_array(F.collect_list(F.struct(by, "s"))).alias(key))

    price = pos.groupBy(user).agg(F.percentile("price", F.lit(0.5)).alias("median_price"))
    return price.join(shares("category", "_c"), user, "left").join(shares("slot", "_s"), user, "left").select(user, F.transform("_c", lambda x: F.struct(x["category"].alias("category"), x["s"].alias("weight"))).alias("preferred"), F.round("median_price", 6).alias("median_price"), F.map_from_entries("_s").alias("slots"))


def feedback_30d(df: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(user, item, feedback): mean weight of the last days before `now`."""
    recent = df.where((F.col("ts") <= now) & (F.col("ts") > now - F.expr(f"INTERVAL {int(days)} DAYS")))
    return recent.groupBy("user", "item").agg(F.round(F.avg("weight"), 9).alias("feedback"))


def scoring_features(df: DataFrame) -> DataFrame:
    """Matches in 0..1 of rows with preferred, category, avg_tier, tier, tastes, segment, slots, slot, distance, weather."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    slot = F.coalesce(F.nullif(F.try_element_at("slots", F.col("slot")), F.lit(0.0)), F.try_element_at("slots", F.lit("other")), F.lit(0.0))
    return df.withColumns({
        "category_match": F.coalesce(F.exists("preferred", lambda x: x["category"] == F.col("category")), F.lit(False)).cast("double"),
        "price_match": F.coalesce(F.col("avg_tier") == F.col("tier"), F.lit(False)).cast("double"),
        "taste_match": clip(F.coalesce(F.try_element_at("tastes", F.col("segment")), F.lit(0.0))),
        "time_match": clip(slot),
        "distance_score": R.distance_score(F.col("distance")),
        "weather_score": F.when(F.coalesce(F.trim("weather"), F.lit("")) == "", 0.5).otherwise(1.0),
    })


#: The keys of a profile's JSON objects, and the categorical fields in order.
TASTES, SLOTS = ("spicy", "sweet", "savory", "light"), ("breakfast", "lunch", "afternoon", "dinner")
PLAIN_FIELDS = ("price_tier", "region_gu", "region_dong", "geohash", "day_of_week", "time_slot", "admin_dong", "distance_bucket", "weather_bucket", "dining_type")


def _profile_categories(k: int) -> Column:
    return preferred(F.from_json("preferred_categories", "array<struct<category:string,weight:double>>"), k)


def base_features(df: DataFrame, k: int = 3) -> DataFrame:
    """Adds taste_<key>, slot_<key>, is_anonymous and pref_w_1..k, all within 0..1, from the profile's JSON texts
    taste_preferences, visit_time_distribution and preferred_categories, and member_id; what is
    missing or broken is 0."""
    def shares(column: str, prefix: str, keys) -> dict[str, Column]:
        m = F.from_json(column, "map<string,string>")
        return {f"{prefix}_{x}": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_element_at(m, F.lit(x)).try_cast("double"), F.lit(0.0)))) for x in keys}

    weights = {f"pref_w_{i + 1}": F.coalesce(F.get(_profile_categories(k), F.lit(i))["weight"], F.lit(0.0)) for i in range(k)}
    anonymous = (F.coalesce(F.trim(F.col("member_id").cast("string")), F.lit("")) == "").cast("double")
    return df.withColumns({**shares("taste_preferences", "taste", TASTES), **shares("visit_time_distribution", "slot", SLOTS), "is_anonymous": anonymous, **weights})


def categorical_fields(df: DataFrame) -> DataFrame:
    """The 20 categorical fields of a row as texts, empty where there is no value. Columns that df lacks count as null."""
    get = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    key = lambda prefix, c: F.when(text(c) != "", F.concat(F.lit(prefix), c)).otherwise("")
    first = lambda c: F.coalesce(F.get(F.from_json(get(c), "array<string>"), F.lit(0)), F.lit(""))
    tag = F.coalesce(F.get(F.from_json(get("comparison_tags"), "array<struct<tag:string>>"), F.lit(0))["tag"], first("comparison_tags"))
    cats = _profile_categories(3)
    return df.select(
        *[c for c in ("split", "row_id") if c in df.columns],
        key("u_", get("member_id")).alias("member_key"), key("a_", F.coalesce(F.nullif(get("anonymous_cohort_id"), F.lit("")), get("anonymous_id"))).alias("cohort_key"),
        text(get("avg_price_tier")).alias("avg_price_tier"), text(get("restaurant_id")).alias("restaurant_id"), first("categories").alias("primary_category"),
        *[F.coalesce(F.trim(F.get(cats, F.lit(i))["category"]), F.lit("")).alias(f"pref_cat_{i + 1}") for i in range(3)],
        *[text(get(c)).alias(c) for c in PLAIN_FIELDS], first("positive_segments").alias("first_segment"), tag.alias("first_tag"))


def feature_dist(df: DataFrame, features: list[str], by: str = "split", top: int = 5) -> DataFrame:
    """(by, feature, n, min, max, mean, std, top): figures of numeric features, and their commonest values."""
    long = df.select(by, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([by], features, "feature", "x")
    figures = long.groupBy(by, "feature").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), 6).alias("std"))
    values = long.groupBy(by, "feature", "x").agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(Window.partitionBy(by, "feature").orderBy(F.desc("c"), "x"))
    best = values.withColumn("r", rank).where(F.col("r") <= top).groupBy(by, "feature").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "x", "c"))), lambda s: F.concat_ws(":", F.round(s["x"], 4).cast("string"), s["c"].cast("string"))), ",").alias("top"))
    return figures.join(best, [by, "feature"])


def split_meta(df: DataFrame) -> DataFrame:
    """(split, users, items, positives) counts, without collecting sets."""
    return df.groupBy("split").agg(F.count_distinct("user").alias("users"), F.count_distinct("item").alias("items"), F.sum("label").cast("long").alias("positives"))


def context_snapshot(df: DataFrame, columns: list[str]) -> Column:
    """The columns as a JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns))


def cast_user_id(c: Column) -> tuple[Column, Column]:
    """(long id or null, whether the text is not an integer)."""
    s = F.trim(c.cast("string"))
    n = F.when(s.rlike(r"^-?\d+(\.0+)?$"), F.regexp_replace(s, r"\.0+$", "").try_cast("long"))
    return n, s.isNotNull() & (s != "") & n.isNull()
