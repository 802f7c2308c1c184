"""Column rules of events, prices, dates, scores and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Event name to signal, the positive signals, and the sample weights of signals.
EVENT_SIGNAL = {"review": "REVIEW", "click": "CLICK", "view": "IMPRESSION", "impression": "IMPRESSION", "call": "CALL", "route": "ROUTE", "save": "SAVE", "share": "SHARE"}
POSITIVE_SIGNALS = ("REVIEW", "CALL", "ROUTE", "SAVE", "SHARE", "CLICK")
SIGNAL_WEIGHT = {"REVIEW": 1.0, "CALL": 0.8, "ROUTE": 0.7, "SAVE": 0.6, "SHARE": 0.4, "CLICK": 0.2}
NO_SIGNALS = ("", "NO_FEEDBACK", "NONE", "IMPRESSION")
#: Weights of the rule score.
RULE_WEIGHTS = {"category_match": 0.30, "price_match": 0.15, "taste_match": 0.20, "time_match": 0.15, "distance": 0.10, "weather": 0.05, "feedback": 0.05}


def lookup(c: Column, values: dict) -> Column:
    """values[c] as an expression; null where missing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def coalesce_blank(*cs: Column) -> Column:
    """The first that is neither null, blank nor "nan"."""
    return F.coalesce(*[F.when((F.trim(c) != "") & (F.lower(F.trim(c)) != "nan"), F.trim(c)) for c in cs])


def signal_of(event: Column, names: dict = EVENT_SIGNAL) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(event)), names), F.lit("IMPRESSION"))


def resolve_label(label: Column, signal: Column) -> Column:
    """The explicit label, else 1 for a signal that is feedback."""
    return F.coalesce(label.cast("int"), (~F.upper(F.trim(F.coalesce(signal, F.lit("")))).isin(*NO_SIGNALS)).cast("int"))


def sample_weight(signal: Column) -> Column:
    """By signal; 1.0 without one or without feedback, 0.2 for others."""
    s = F.upper(F.trim(F.coalesce(signal, F.lit(""))))
    return F.when(s.isin("", "NO_FEEDBACK", "NONE"), 1.0).otherwise(F.coalesce(lookup(s, SIGNAL_WEIGHT), F.lit(0.2)))


def user_key(member: Column, anonymous: Column) -> Column:
    """u_<member>, else a_<anonymous>, else null."""
    m, a = coalesce_blank(member.cast("string")), coalesce_blank(anonymous.cast("string"))
    return F.coalesce(F.concat(F.lit("u_"), m), F.concat(F.lit("a_"), a))


def group_key(recommendation: Column, generated: Column, member: Column, anonymous: Column) -> Column:
    return F.coalesce(coalesce_blank(recommendation.cast("string")), coalesce_blank(generated.cast("string")), user_key(member, anonymous), F.lit("single"))


def day_of_week(ts: Column) -> Column:
    """0 is Monday."""
    return F.weekday(ts)


def time_slot(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 10, "breakfast").when(h < 14, "lunch").when(h < 18, "afternoon").when(h.isNotNull(), "dinner")


def price_tier(mean: Column) -> Column:
    """LOW under 10000, MID under 20000, else HIGH; a text is kept in upper case."""
    x = mean.cast("string").try_cast("double")
    return F.when(x.isNull(), F.nullif(F.upper(F.trim(mean.cast("string"))), F.lit(""))).when(x < 10000, "LOW").when(x < 20000, "MID").otherwise("HIGH")


def tier_to_num(tier: Column) -> Column:
    """0..1: numbers above 1 by fifths, low .2, mid .5, high .8, anything else .5."""
    s = F.trim(F.coalesce(tier.cast("string"), F.lit("")))
    x, name = s.try_cast("double"), F.lower(s)
    number = F.when(x > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / 5.0))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return F.when(x.isNotNull(), number).when(name.isin("low", "l"), 0.2).when(name.isin("high", "h"), 0.8).otherwise(0.5)


def visit_date(c: Column, default_year: int = 2025) -> Column:
    """A timestamp from "YY.M.D" at the start; 1 January of the default year if it isn't a date."""
    p = r"^\s*(\d{2,4})\.(\d{1,2})\.(\d{1,2})"
    part = lambda k: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, k), F.lit("")).cast("int")
    year = F.when(part(1) < 100, part(1) + 2000).otherwise(part(1))
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(part(2).cast("string"), 2, "0"), F.lpad(part(3).cast("string"), 2, "0"))
    found = F.when(year.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.coalesce(found, F.lit(f"{default_year}-01-01").cast("timestamp"))


def place_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/place/(\d+)", 1), F.lit("")).cast("long")


def point_id(restaurant: Column, review: Column) -> Column:
    """md5 of "<restaurant>:<review>"."""
    return F.md5(F.concat_ws(":", restaurant.cast("string"), review.cast("string")))


#: Fixed value: the URL name space of RFC 4122.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name: Column, space: str = URL_SPACE) -> Column:
    """A version 5 (SHA-1) UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "utf-8")))
    high = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(high.bitwiseAND(3).bitwiseOR(8))), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def age_weight(ts: Column, now: Column) -> Column:
    """1.0 up to 365 days, 0.8 up to 730, else 0.6; 1.0 without a time."""
    days = F.datediff(now, ts)
    return F.when(days.isNull() | (days <= 365), 1.0).when(days <= 730, 0.8).otherwise(0.6)


def sentiment_label(score: Column, hi: float = 0.8, lo: float = 0.3) -> Column:
    """Above hi positive; from lo to below hi neutral; the rest, hi itself too, negative."""
    return F.when(score > hi, "positive").when((score >= lo) & (score < hi), "neutral").when(score.isNotNull(), "negative")


def binary_label(name: Column) -> Column:
    """A model's label as positive or negative; null for others."""
    s = F.lower(F.trim(name))
    return F.when(s.isin("positive", "pos", "label_1", "1"), "positive").when(s.isin("negative", "neg", "label_0", "0"), "negative")


def distance_bucket(metres: Column, edges=(300, 700, 1500)) -> Column:
    out = F.when(metres < edges[0], "NEAR")
    for name, e in zip(("WALK", "MID"), edges[1:]):
        out = out.when(metres < e, name)
    return out.when(metres.isNotNull(), "FAR")


#: Scores and indices of the distance buckets.
DISTANCE_SCORE = {"NEAR": 1.0, "WALK": 0.8, "MID": 0.5, "FAR": 0.2}
DISTANCE_INDEX = {"NEAR": 0, "WALK": 1, "MID": 2, "FAR": 3}


def distance_score(bucket: Column) -> Column:
    return F.coalesce(lookup(F.upper(F.trim(bucket)), DISTANCE_SCORE), F.lit(0.5))


def distance_weight(bucket: Column) -> Column:
    """1 / (index + 1); an unknown bucket counts as the third."""
    return 1.0 / (F.coalesce(lookup(F.upper(F.trim(bucket)), DISTANCE_INDEX), F.lit(2)) + 1)


def rule_score(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for name, weight in RULE_WEIGHTS.items():
        if name in parts:
            out = out + parts[name] * weight
    return out
