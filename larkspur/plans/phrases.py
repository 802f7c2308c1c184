"""Queries of the phrase operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import phrases as P
from .base import HINTS, KEYWORDS, POSITIVE, sql_any, sql_bigrams, sql_positive, sql_tokens, texts


def docs(spark, d):
    return texts(spark, d)


def _classes(column: str = "phrase") -> str:
    whens = ", ".join(f"CASE WHEN {sql_any(column, w)} THEN '{k}' END" for k, w in KEYWORDS.items())
    return f"CASE WHEN len(list_filter([{whens}], lambda x: x IS NOT NULL)) > 0 THEN list_filter([{whens}], lambda x: x IS NOT NULL) ELSE ['other'] END"


def _ratios(by: str, source: str, digits: int) -> str:
    parts = []
    for k in POSITIVE:
        mine, good = sql_any("phrase", KEYWORDS[k]), sql_positive(k)
        total, pos = f"coalesce(sum(cnt) FILTER ({mine}), 0)", f"coalesce(sum(cnt) FILTER ({mine} AND {good}), 0)"
        parts.append(f"{total}::BIGINT AS {k}_total, {pos}::BIGINT AS {k}_pos, coalesce(round_even({pos}::DOUBLE / nullif({total}, 0), {digits}), 0.0) AS {k}_ratio")
    return f"SELECT {by + ', ' if by else ''}{', '.join(parts)} FROM {source}" + (f" GROUP BY {by}" if by else "")


TOP = "SELECT * FROM g QUALIFY row_number() OVER (ORDER BY cnt DESC, phrase) <= 2000"
TOP_BY = "SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY cnt DESC, phrase) <= 2000"


def word_counts(spark, d):
    return P.word_counts(docs(spark, d))


def top_words(spark, d):
    return P.top_phrases(P.word_counts(docs(spark, d)), 50, key="word")


def bigram_counts(spark, d):
    return P.bigram_counts(docs(spark, d))


def top_phrases(spark, d):
    return P.top_phrases(P.bigram_counts(docs(spark, d)))


def top_phrases_by_source(spark, d):
    return P.top_phrases(P.bigram_counts(docs(spark, d), by=("source",)), 20, ("source",))


def category_totals(spark, d):
    return P.category_totals(top_phrases(spark, d), KEYWORDS)


def corpus_ratios(spark, d):
    return P.positive_ratios(top_phrases(spark, d), KEYWORDS, POSITIVE)


def source_ratios(spark, d):
    return P.positive_ratios(P.top_phrases(P.bigram_counts(docs(spark, d), by=("source",)), 2000, ("source",)), KEYWORDS, POSITIVE, ("source",), 2)


def aspect_metrics(spark, d):
    r = corpus_ratios(spark, d)
    return r.select((F.col("service_total") + F.col("price_total")).alias("overall_total"), *r.columns)


def category_share(spark, d):
    return P.category_share(top_phrases(spark, d), KEYWORDS)


def compare(spark, d):
    return P.compare(docs(spark, d), KEYWORDS, POSITIVE)


def positive_lift(spark, d):
    c = compare(spark, d)
    return P.positive_lift_only(c.select("source", "lift_service", "lift_price"), {"service": "lift_service", "price": "lift_price"})


def lift_texts(spark, d):
    c = compare(spark, d)
    return c.select("source", P.default_description("service", F.col("lift_service")).alias("text"), P.multiple(F.col("service_ratio"), F.col("all_service")).alias("times"))


def phrase_split(spark, d):
    return P.quantile_split(P.classify(top_phrases(spark, d), KEYWORDS), ("category",)).select("category", "phrase", "cnt", "pos", "part")


def recall_seeds(spark, d):
    return P.recall_seeds(docs(spark, d), KEYWORDS)


def source_seeds(spark, d):
    return P.recall_seeds(docs(spark, d), KEYWORDS, ("source",))


def merged_phrases(spark, d):
    ranked = P.quantile_split(top_phrases(spark, d))
    return P.merge_reversed(ranked).select("phrase", "cnt", "pos")


def phrase_tests(spark, d):
    top = top_phrases(spark, d)
    return top.select("phrase", F.array_join(T.phrase_classes(F.col("phrase"), KEYWORDS), ",").alias("classes"), *[T.is_positive(F.col("phrase"), *POSITIVE[k]).alias(f"{k}_positive") for k in POSITIVE])


def text_measures(spark, d):
    """Per document: tokens, sentences, class by hints, estimated tokens by both rules."""
    c = F.col("text")
    return docs(spark, d).select("doc_id", F.size(T.tokens(c)).alias("n_tokens"), F.size(T.sentences(c)).alias("n_sentences"), T.review_class(c, HINTS).alias("review_class"), T.has_signal(c, HINTS["price"]).alias("price_signal"), T.est_tokens(c).cast("long").alias("est_words"), T.est_tokens(c, "chars").cast("long").alias("est_chars"), F.md5(T.squeeze(c)).alias("squeezed_md5"))


def normalized_text(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


def clipped_sentences(spark, d):
    """Per document the first 8 sentences, and how many of them fit 200 estimated tokens."""
    s = T.clip_items(T.sentences(F.col("text")))
    return docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), T.fit_items([F.col("s")], 200).cast("int").alias("k"), F.md5(F.array_join("s", "|")).alias("md5"))


def _norm() -> str:
    """CTE nt (doc_id, text) of the normalised texts: characters by place, their runs, then trimmed words."""
    return r"""kp AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\s\x0B\x{85}\p{Z}.,!?]', '', 'g') AS k FROM documents),
ch AS (SELECT doc_id, unnest(regexp_extract_all(k, '(?s).')) AS c, generate_subscripts(regexp_extract_all(k, '(?s).'), 1) AS i FROM kp),
gr AS (SELECT doc_id, c, i, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM ch),
ru AS (SELECT doc_id, c, min(i) AS i, count(*) AS n FROM gr GROUP BY doc_id, c, g),
jn AS (SELECT doc_id, string_agg(CASE WHEN n >= 3 THEN c ELSE repeat(c, n::INT) END, '' ORDER BY i) AS t FROM ru GROUP BY doc_id),
nt AS (SELECT doc_id, trim(regexp_replace(coalesce(t, ''), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'), ' ') AS text FROM kp LEFT JOIN jn USING (doc_id))"""


def seeded(seed, *columns: str) -> str:
    """SQL of operators.sampling.shuffled."""
    return f"md5('{seed}' || " + " || ".join(f"':' || coalesce(({c})::VARCHAR, '')" for c in columns) + ")"


def unit(seed, *columns: str) -> str:
    """SQL of operators.sampling.uniform."""
    return f"((('0x' || substr({seeded(seed, *columns)}, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def _seeds(by: str = "") -> str:
    """CTE sd (*by, category, phrase, cnt, pos): the drawn seeds, reversed pairs merged."""
    k = f"{by}, " if by else ""
    top = TOP_BY if by else TOP
    key = f"CASE WHEN part = 'mid' THEN -ln({unit(42, 'phrase')}) / ln(cnt + 1.0::DOUBLE) ELSE {unit(42, 'phrase')} END"
    return f"""{sql_bigrams(by)}, tp AS ({top}), cl AS (SELECT {k}phrase, cnt, unnest({_classes()}) AS category FROM tp),
rk AS (SELECT *, row_number() OVER (PARTITION BY {k}category ORDER BY cnt DESC, phrase) AS pos, count(*) OVER (PARTITION BY {k}category) AS n FROM cl),
hd AS (SELECT *, greatest(10, least(floor(n * 0.02), n)) AS h FROM rk), pt AS (SELECT *, CASE WHEN pos <= h THEN 'head' WHEN pos <= greatest(h, least(floor(n * 0.2), n)) THEN 'mid' ELSE 'tail' END AS part FROM hd),
dr AS (SELECT *, row_number() OVER (PARTITION BY {k}category, part ORDER BY {key}, phrase) AS rn FROM pt),
pk AS (SELECT *, list_sort(string_split(phrase, ' ')) AS pair FROM dr WHERE part = 'head' OR part = 'mid' AND rn <= 5 OR part = 'tail' AND rn <= 1),
sd AS (SELECT {k}category, arg_min(phrase, pos) AS phrase, sum(cnt)::BIGINT AS cnt, min(pos) AS pos FROM pk GROUP BY {k}category, pair)"""


SEEDS = _seeds()


def _hint(h):
    return sql_any("replace(text, ' ', '')", [x.replace(" ", "") for x in h])


_WS = "[ \\t\\n\\r\\f\\v]"
_SENT = "list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?][ \\t\\n\\r\\f\\v]+'), lambda s: trim(s, ' ')), lambda s: length(s) > 0)"
_LINE = lambda k, lift: f"CASE WHEN {lift} > 0 THEN '{k}: about ' || {lift}::VARCHAR || '% above average; rated ' || CASE WHEN n_reviews >= 50 THEN 'good' WHEN n_reviews >= 20 THEN 'rather good' ELSE 'a tendency, with few reviews' END ELSE '{k}: about average' END"
_COMPARE = f"""WITH {sql_bigrams('source')},
own AS ({_ratios('source', f'({TOP_BY})', 2)}),
c AS (SELECT phrase, sum(cnt)::BIGINT AS cnt FROM g GROUP BY phrase),
ct AS (SELECT * FROM c QUALIFY row_number() OVER (ORDER BY cnt DESC, phrase) <= 2000),
tot AS ({_ratios('', 'ct', 4)}),
n AS (SELECT source, count(*) AS n_reviews FROM documents WHERE length(text) > 0 GROUP BY source),
j AS (SELECT own.source, n_reviews, own.service_ratio, own.price_ratio, tot.service_ratio AS all_service, tot.price_ratio AS all_price,
coalesce(CASE WHEN tot.service_ratio > 0 THEN round_even((own.service_ratio - tot.service_ratio) / tot.service_ratio * 100, 0)::BIGINT END, 0) AS lift_service,
coalesce(CASE WHEN tot.price_ratio > 0 THEN round_even((own.price_ratio - tot.price_ratio) / tot.price_ratio * 100, 0)::BIGINT END, 0) AS lift_price
FROM own JOIN n USING (source), tot),
cmp AS (SELECT *, {_LINE('service', 'lift_service')} AS line_service, {_LINE('price', 'lift_price')} AS line_price FROM j)"""
_SPLIT = f"""WITH {sql_bigrams()}, t AS ({TOP}), k AS (SELECT *, unnest({_classes()}) AS category FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY cnt DESC, phrase) AS pos, count(*) OVER (PARTITION BY category) AS n FROM k),
q AS (SELECT *, greatest(10, least(floor(n * 0.02::DOUBLE), n)) AS h, least(floor(n * 0.2::DOUBLE), n) AS m0 FROM r)
SELECT category, phrase, cnt, pos, CASE WHEN pos <= h THEN 'head' WHEN pos <= greatest(h, m0) THEN 'mid' ELSE 'tail' END AS part FROM q"""

QUERIES = {
    "word_counts": (word_counts, f"SELECT word, count(*) AS cnt FROM (SELECT unnest({sql_tokens()}) AS word FROM documents) GROUP BY word"),
    "top_words": (top_words, f"SELECT word, count(*) AS cnt FROM (SELECT unnest({sql_tokens()}) AS word FROM documents) GROUP BY word ORDER BY cnt DESC, word LIMIT 50"),
    "bigram_counts": (bigram_counts, f"WITH {sql_bigrams()} SELECT * FROM g"),
    "top_phrases": (top_phrases, f"WITH {sql_bigrams()} {TOP}"),
    "top_phrases_by_source": (top_phrases_by_source, f"WITH {sql_bigrams('source')} SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY cnt DESC, phrase) <= 20"),
    "category_totals": (category_totals, f"WITH {sql_bigrams()}, t AS ({TOP}), k AS (SELECT *, unnest({_classes()}) AS category FROM t) SELECT category, sum(cnt)::BIGINT AS total, count(*) AS phrases FROM k GROUP BY category"),
    "corpus_ratios": (corpus_ratios, f"WITH {sql_bigrams()} {_ratios('', f'({TOP})', 4)}"),
    "source_ratios": (source_ratios, f"WITH {sql_bigrams('source')} {_ratios('source', f'({TOP_BY})', 2)}"),
    "aspect_metrics": (aspect_metrics, f"WITH {sql_bigrams()}, r AS ({_ratios('', f'({TOP})', 4)}) SELECT service_total + price_total AS overall_total, * FROM r"),
    "category_share": (category_share, f"WITH {sql_bigrams()}, t AS ({TOP}), k AS (SELECT *, unnest({_classes()}) AS category FROM t), s AS (SELECT category, sum(cnt)::BIGINT AS total FROM k WHERE category <> 'other' GROUP BY category) SELECT category, total, round_even(100.0::DOUBLE * total / sum(total) OVER (), 2) AS share FROM s"),
    "compare": (compare, f"{_COMPARE} SELECT * FROM cmp"),
    "positive_lift": (positive_lift, f"{_COMPARE} SELECT source, 'lift_service' AS category, lift_service AS lift FROM cmp WHERE lift_service > 0 UNION ALL SELECT source, 'lift_price', lift_price FROM cmp WHERE lift_price > 0"),
    "lift_texts": (lift_texts, f"{_COMPARE} SELECT source, CASE WHEN lift_service > 0 THEN 'service is ' || lift_service::VARCHAR || '% higher than average' WHEN lift_service < 0 THEN 'service is ' || abs(lift_service)::VARCHAR || '% lower than average' ELSE 'service is close to average' END AS text, CASE WHEN all_service > 0 THEN round_even(service_ratio / all_service, 2) END AS times FROM cmp"),
    "phrase_split": (phrase_split, _SPLIT),
    "recall_seeds": (recall_seeds, f"WITH {SEEDS} SELECT category, phrase, cnt, pos FROM sd"),
    "source_seeds": (source_seeds, f"WITH {_seeds('source')} SELECT source, category, phrase, cnt, pos FROM sd"),
    "merged_phrases": (merged_phrases, f"WITH {sql_bigrams()}, t AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, phrase) AS pos FROM g QUALIFY pos <= 2000), s AS (SELECT *, list_sort(string_split(phrase, ' ')) AS pair FROM t) SELECT arg_min(phrase, pos) AS phrase, sum(cnt)::BIGINT AS cnt, min(pos) AS pos FROM s GROUP BY pair"),
    "phrase_tests": (phrase_tests, f"WITH {sql_bigrams()}, t AS ({TOP}) SELECT phrase, array_to_string({_classes()}, ',') AS classes, {sql_positive('service')} AS service_positive, {sql_positive('price')} AS price_positive FROM t"),
    "text_measures": (text_measures, f"""SELECT doc_id, len({sql_tokens()})::INT AS n_tokens, len({_SENT})::INT AS n_sentences,
CASE WHEN {_hint(HINTS['price'])} THEN 'price' WHEN {_hint(HINTS['service'])} THEN 'service' WHEN {_hint(HINTS['food'])} THEN 'food' ELSE 'food' END AS review_class, {_hint(HINTS['price'])} AS price_signal,
floor(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) * 1.3::DOUBLE)::BIGINT AS est_words, ((length(text) + 1) // 2)::BIGINT AS est_chars, md5(trim(regexp_replace(text, '{_WS}+', ' ', 'g'), ' ')) AS squeezed_md5 FROM documents"""),
    "normalized_text": (normalized_text, f"WITH {_norm()} SELECT doc_id, text FROM nt"),
    "clipped_sentences": (clipped_sentences, f"""WITH s AS (SELECT doc_id, ({_SENT})[1:8] AS s FROM documents), n AS (SELECT doc_id, s, list_filter([1,2,3,4,5,6,7,8], lambda k: (list_sum(list_transform(s[1:k], lambda x: length(x))) + 1) // 2 <= 200) AS ok FROM s)
SELECT doc_id, len(s)::INT AS n, coalesce(list_max(ok), 1)::INT AS k, md5(array_to_string(s, '|')) AS md5 FROM n"""),
}
