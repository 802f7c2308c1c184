"""Column expressions over review text. All are built-in expressions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionary

#: What a token is made of.
TOKEN = "[가-힣A-Za-z0-9]+"


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """Only word characters, white space and .,!? stay; a character repeated three times or more becomes one."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w\s가-힣.,!?]", "")
    return squeeze(F.regexp_replace(kept, r"(?s)(.)\1{2,}", "$1"))


def tokens(c: Column, stop: tuple[str, ...] = (), min_len: int = 2) -> Column:
    """Tokens of at least min_len characters that are not stopwords, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= min_len) & (~t.isin(*stop) if stop else F.lit(True)))


def bigrams(words: Column) -> Column:
    """Neighbouring words as phrases "a b", without pairs of equals. The words come in through a lambda, so that
    they are found once, not for each place where the expression names them."""

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.when(a != b, F.concat(a, F.lit(" "), b)))

    return F.filter(F.flatten(F.transform(F.array(words), pairs)), lambda p: p.isNotNull())


def sentences(c: Column) -> Column:
    """Parts after . ! ? and white space, trimmed, empty ones dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?]\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 0)


#: With more needles than this a text is passed once through an automaton of them all.
MANY = 64


def contains_any(c: Column, needles) -> Column:
    """Whether one of the needles is part of the text; null for null, if there are needles."""
    if len(needles) > MANY:
        return dictionary.contains(c, needles)
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def phrase_classes(c: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    """Every class of which a keyword is part of the phrase; `other` if there is none."""
    found = F.filter(F.array(*[F.when(contains_any(c, words), F.lit(name)) for name, words in keywords.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def is_positive(c: Column, whole: tuple[str, ...] = (), part: tuple[str, ...] = ()) -> Column:
    """One of the phrase's words is in `whole`, or one of `part` stands in the phrase."""
    out = contains_any(c, part)
    return out | F.arrays_overlap(F.split(c, " "), F.array(*[F.lit(w) for w in whole])) if whole else out


def has_signal(c: Column, hints) -> Column:
    """A hint occurs when spaces are left out."""
    return contains_any(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")), [h.replace(" ", "") for h in hints])


def review_class(c: Column, hints: dict[str, tuple[str, ...]], default: str = "food") -> Column:
    """The first class, in the order given, of which a hint occurs."""
    out = None
    for name, words in hints.items():
        out = F.when(has_signal(c, words), name) if out is None else out.when(has_signal(c, words), name)
    return out.otherwise(default)


def est_tokens(c: Column, rule: str = "words") -> Column:
    """floor(words * 1.3), or (characters + 1) // 2 for rule="chars"."""
    text = F.coalesce(c, F.lit(""))
    if rule == "chars":
        return F.floor((F.length(text) + 1) / 2)
    return F.floor(F.regexp_count(text, F.lit(r"(?U)\S+")) * F.lit(1.3))


def clip_items(c: Column, n: int = 8) -> Column:
    """The first n items that are not blank, trimmed."""
    return F.slice(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (F.length(x) > 0)), 1, n)


def fit_items(lists: list[Column], limit: int, n: int = 8) -> Column:
    """The largest k <= n for which the first k items of all lists stay within `limit` estimated tokens; 1 at least, and
    1 where no list has an item."""
    def cost(k):
        chars = F.lit(0)
        for xs in lists:
            chars = chars + F.aggregate(F.slice(xs, F.lit(1), k), F.lit(0), lambda s, x: s + F.length(x))
        return F.floor((chars + 1) / 2)

    some = F.lit(False)
    for xs in lists:
        some = some | (F.size(xs) > 0)
    ok = F.filter(F.sequence(F.lit(1), F.lit(n)), lambda k: cost(k) <= limit)
    return F.when(some, F.coalesce(F.array_max(ok), F.lit(1))).otherwise(F.lit(1))


def sentence_with_percent(c: Column) -> Column:
    """One sentence: the whole if there is one, else the first with a percentage, else the first; ends with a stop."""
    parts = F.filter(F.split(squeeze(c), r"(?<=[.!?])\s+"), lambda p: F.length(p) > 0)
    first = F.coalesce(F.get(F.filter(parts, lambda p: p.rlike(r"\d+(\.\d+)?\s*%")), F.lit(0)), F.get(parts, F.lit(0)), F.lit(""))
    return F.when(F.size(parts) <= 1, squeeze(c)).otherwise(F.when(first.rlike(r"[.!?]$"), first).otherwise(F.concat(first, F.lit("."))))


def valid_sentence(c: Column, lift: Column, required: tuple[str, ...], one_of: tuple[str, ...], forbidden: tuple[str, ...], strong: tuple[str, ...] = ()) -> Column:
    """Exactly one percentage, all required words, one of the markers, no forbidden word; words of `strong` need a lift of 30."""
    s = squeeze(F.coalesce(c, F.lit("")))
    ok = (F.length(s) > 0) & (F.regexp_count(s, F.lit(r"\d+(?:\.\d+)?\s*%")) == 1) & ~contains_any(s, forbidden)
    for w in required:
        ok = ok & F.contains(s, F.lit(w))
    if one_of:
        ok = ok & contains_any(s, one_of)
    return ok & ~((F.abs(lift) < 30) & contains_any(s, strong))


def lift_band(lift: Column) -> Column:
    return F.when(F.abs(lift) < 10, "small").when(F.abs(lift) < 30, "some").otherwise("large")
