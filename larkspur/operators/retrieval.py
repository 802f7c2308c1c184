"""Retrieval: encoders, BM25 postings, dense, sparse and hybrid top-k, cascades, representative vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..scratch import Scratch, shipped
from .nearest import nearest
from .sampling import shuffled


def hashing_encoder(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A factory of encoders: signed hashed word counts, scaled to unit length."""

    def make():
        import hashlib

        memo: dict[str, tuple[int, float]] = {}

        def place(w: str) -> tuple[int, float]:
            if w not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                memo[w] = (h % dim, 1.0 if h >> 63 else -1.0)
            return memo[w]

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in (t or "").lower().split():
                    j, s = place(w)
                    out[i, j] += s
            n = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.maximum(n, 1e-12)

        return encode

    return make


def embed(df: DataFrame, text: str = "text", encoder: Callable = hashing_encoder(), name: str = "vector") -> DataFrame:
    """Adds a vector; the encoder is made once in each worker and fed Arrow batches."""
    shipped(df.sparkSession)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for s in batches:
            yield pd.Series(list(encode(s.tolist())))

    return df.withColumn(name, run(F.col(text)))


def hashed_vectors(df: DataFrame, key: str, text: str = "text", dim: int = 64) -> DataFrame:
    """(key, vector): signed counts of a text's words (lower case, cut at white space), scaled to unit length, in
    DataFrame functions only. A word's place and sign are digits of its md5, so SQL can repeat them. Keys must
    not repeat; a text without words, or null, has zeros."""
    word = F.explode(F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != ""))
    h = F.md5(F.col("w").cast("binary"))
    place = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") >= 8, 1.0).otherwise(-1.0)
    places = df.select(key, word.alias("w")).select(key, place.alias("i"), sign.alias("x")).groupBy(key, "i").agg(F.sum("x").alias("x"))
    made = places.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    value = lambda i: F.coalesce(F.try_divide(F.coalesce(F.try_element_at("m", i), F.lit(0.0)), F.col("norm")), F.lit(0.0))
    return df.select(key).join(made, key, "left").select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("vector"))


def dense_topk(queries: DataFrame, docs: DataFrame, k: int, min_score: float = -1.0, query_block: int = 2048, by: tuple[str, ...] = (), doc_block: int = 8192, digits: int = 9, others_only: bool = False) -> DataFrame:
    """(*by, query, doc, score, rank) of a stated query set (query, *by, vector) against all docs (doc, *by,
    vector): cosine in double precision, rounded; ties by doc. `by` restricts a query to the docs of
    its entity or category; others_only leaves out the doc of the query's own id.

    Docs are dealt by hash into blocks, as many as their number (within `by`, if given) asks for, and shuffled
    once; each query goes to all blocks of its own. A task holds one block, scores
    at most `query_block` queries at once and gives its best k of each. For a set of queries of any size over very many docs see `vector_index`."""
    sizes = docs.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(doc_block)).cast("int").alias("_n"))
    sizes = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.greatest("_n", F.lit(1)).alias("_n"))

    def with_blocks(t: DataFrame) -> DataFrame:
        if not by:
            return t.crossJoin(F.broadcast(sizes))  # one row
        same = F.lit(True)
        for c in by:
            same = same & t[c].eqNullSafe(sizes[f"_by_{c}"])
        return t.join(sizes, same).drop(*[f"_by_{c}" for c in by])

    q = with_blocks(queries.select(*by, "query", "vector")).select(*by, "query", "vector", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"))
    d = with_blocks(docs.select(*by, "doc", "vector")).select(*by, "doc", "vector", F.pmod(F.xxhash64("doc"), F.col("_n")).cast("int").alias("_b"))
    return _ranked(nearest(q, d, [*by, "_b"], list(by), k, min_score, digits, others_only, query_block), k, (*by, "query"))


def _ranked(hits: DataFrame, k: int, group: tuple[str, ...] = ("query",)) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "doc")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_index(docs: DataFrame, text: str = "text", doc: str = "doc_id", k1: float = 1.2, b: float = 0.75, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, term, doc, weight): postings with BM25 weights (idf within), terms in lower case."""
    words = T.tokens(F.lower(F.col(text)))
    # Stored, as the statistics and the counts both read it.
    d = Scratch(docs.sparkSession, "bm25").put(docs.select(*by, F.col(doc).alias("doc"), words.alias("w")), "words").withColumn("len", F.size("w"))
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    tf = d.select(*by, "doc", "len", F.explode("w").alias("term")).groupBy(*by, "doc", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    j = tf.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return j.select(*by, "term", "doc", F.round(weight, 9).alias("weight"))


def sparse_topk(queries: DataFrame, index: DataFrame, k: int, on: tuple[str, ...] = ()) -> DataFrame:
    """(*on, query, doc, score, rank): the query's distinct terms joined with the postings; columns query, text
    (and `on`, the entity or category that restricts a query)."""
    q = queries.select("query", *on, F.explode(F.array_distinct(T.tokens(F.lower(F.col("text"))))).alias("term"))
    hits = q.join(index, ["term", *on]).groupBy(*on, "query", "doc").agg(F.round(F.sum("weight"), 6).alias("score"))
    return _ranked(hits, k, (*on, "query"))


def fuse(dense: DataFrame, sparse: DataFrame, limit: int, k: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists."""
    both = dense.select(*by, "query", "doc", "rank").unionByName(sparse.select(*by, "query", "doc", "rank"))
    return _ranked(both.groupBy(*by, "query", "doc").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score")), limit, (*by, "query"))


def hybrid_topk(queries: DataFrame, docs: DataFrame, index: DataFrame | Callable[[DataFrame, int], DataFrame], limit: int, dense_n: int = 200, sparse_n: int = 300, fallback_min_score: float = 0.2, k: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """Fused hits of queries (query, *by, text, vector); a query without sparse hits gets its dense ones of at
    least the fallback score. `by` restricts both sides to the query's entity or category. index: postings, or
    a search that gives the sparse hits of (queries, number). Both lists are stored, as each is read more than once."""
    scratch = Scratch(docs.sparkSession, "hybrid")
    dense = scratch.put(dense_topk(queries, docs, dense_n, by=by), "dense")
    sparse = scratch.put(index(queries, sparse_n) if callable(index) else sparse_topk(queries, index, sparse_n, by), "sparse")
    keys = [*by, "query"]
    known = sparse.select(*keys).distinct()
    fused = fuse(dense.join(known, keys, "left_semi"), sparse, limit, k, by)
    alone = dense.join(known, keys, "left_anti").where((F.col("score") >= fallback_min_score) & (F.col("rank") <= limit))
    return fused.unionByName(alone.select(fused.columns))


def seed_queries(seeds: DataFrame, n: int = 10, by: tuple[str, ...] = ("category",)) -> DataFrame:
    """(*by, text): the first n phrases by pos, joined by a space."""
    top = seeds.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("pos"))).where(F.col("_rn") <= n)
    return top.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "phrase"))), lambda x: x["phrase"]), " ").alias("text"))


def hit_ratio(hits: DataFrame, keywords: dict[str, tuple[str, ...]], top: int = 8, category: str = "category", text: str = "text") -> DataFrame:
    """(query, ratio): share of the first `top` texts with one of the category's keywords."""
    found = F.lit(False)
    for name, words in keywords.items():
        found = found | ((F.col(category) == name) & T.contains_any(F.col(text), words))
    return hits.where((F.col("rank") <= top) & (F.trim(text) != "")).groupBy("query").agg(F.round(F.avg(found.cast("double")), 6).alias("ratio"))


def dedupe_hits(hits: DataFrame, by: tuple[str, ...] = ("query",), key: str = "doc") -> DataFrame:
    """The first hit of each key (else of each text), order kept."""
    k = F.coalesce(F.col(key).cast("string"), F.col("text") if "text" in hits.columns else F.lit(None))
    return hits.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, k).orderBy("rank"))).where("_rn = 1").drop("_rn")


def choose_hits(dense: DataFrame, hybrid: DataFrame, ratios_dense: DataFrame, ratios_hybrid: DataFrame, k_min: int = 3) -> DataFrame:
    """For each query the dense or the hybrid list. Hybrid is looked at only where dense is weak: fewer than
    k_min hits, keyword ratio below .25, best score below .25, or the first five within .02; it wins by a
    higher keyword ratio, or if dense has too few hits and it has as many."""
    s = dense.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.max(F.when(F.col("rank") == 5, F.col("score"))).alias("fifth"))
    h = hybrid.groupBy("query").agg(F.count(F.lit(1)).alias("hn"))
    d = s.join(h, "query", "full").join(ratios_dense.withColumnRenamed("ratio", "dr"), "query", "left").join(ratios_hybrid.withColumnRenamed("ratio", "hr"), "query", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    weak = (zero("n") < k_min) | (zero("dr") < 0.25) | (zero("top") < 0.25) | F.coalesce(F.col("top") - F.col("fifth") < 0.02, F.lit(False))
    take = weak & (zero("hn") > 0) & ((zero("hr") > zero("dr")) | ((zero("n") < k_min) & (zero("hn") >= zero("n"))))
    pick = d.select("query", F.coalesce(take, F.lit(False)).alias("_h"))
    both = dense.withColumn("mode", F.lit("dense")).unionByName(hybrid.withColumn("mode", F.lit("hybrid")))
    return both.join(pick, "query").where((F.col("mode") == "hybrid") == F.col("_h")).drop("_h")


def map_evidence(hits: DataFrame, allowed: DataFrame | None = None, min_score: float = 0.35, max_reuse: int = 1) -> DataFrame:
    """(entity, category, bullet, doc, rank): for each bullet in order the best allowed hit whose document
    is not used up. hits: (entity, category, bullet, doc, score, rank). Greedy within an entity: the n-th
    of its bullets needs its first n hits at most, so only those are gathered; entities run side by side."""
    h = hits.where(F.col("score") >= min_score)
    if allowed is not None:
        h = h.join(allowed, ["entity", "category", "doc"], "left_semi")
    bullets = h.select("entity", "category", "bullet").distinct().withColumn("_nth", F.row_number().over(Window.partitionBy("entity").orderBy("category", "bullet")))
    h = h.join(bullets, ["entity", "category", "bullet"]).withColumn("_rn", F.row_number().over(Window.partitionBy("entity", "category", "bullet").orderBy("rank", "doc"))).where("_rn <= _nth")

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, done = None, {}, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                entity, category, bullet, doc, _ = row
                if (entity,) != now:
                    now, used, done = (entity,), {}, None
                if (category, bullet) != done and used.get(doc, 0) < max_reuse:
                    used[doc] = used.get(doc, 0) + 1
                    done = (category, bullet)
                    out.append(row)
            yield pd.DataFrame(out, columns=pdf.columns).astype(pdf.dtypes.to_dict()) if out else pdf.iloc[:0]

    # Rows of an entity are streamed in order past a table of its used documents, never gathered.
    some = h.select("entity", "category", "bullet", "doc", "rank")
    some = some.repartition("entity").sortWithinPartitions("entity", "category", "bullet", "rank", "doc")
    return some.mapInPandas(greedy, some.schema)


def entity_vectors(df: DataFrame, entity: str, vector: str = "vector", weight: Column | None = None) -> DataFrame:
    """(entity, vector): weighted mean. Sums run per dimension with partial aggregation, so a hot entity is no list."""
    w = F.lit(1.0) if weight is None else weight
    long = df.select(entity, w.alias("w"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    s = long.groupBy(entity, "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    return s.groupBy(entity).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: F.round(x["m"], 9)).alias("vector"))


def similar_entities(vectors: DataFrame, n: int, entity: str = "entity", block: str | None = None) -> DataFrame:
    """(entity, other, score, rank): the n nearest others by cosine, within the same `block` if one is given."""
    by = (block,) if block else ()
    hits = dense_topk(vectors.select(F.col(entity).alias("query"), *by, "vector"), vectors.select(F.col(entity).alias("doc"), *by, "vector"), n, by=by, digits=6, others_only=True)
    return hits.select(F.col("query").alias(entity), F.col("doc").alias("other"), "score", "rank")


def unique_strengths(target: DataFrame, others: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows of target (entity, id, vector) whose nearest phrase among the same entity's comparison phrases
    (entity, vector) stays below the threshold; all, if there is nothing to compare."""
    near = dense_topk(target.select("entity", F.col("id").alias("query"), "vector"), others.select("entity", F.xxhash64("vector").alias("doc"), "vector"), 1, by=("entity",))
    near = near.select("entity", F.col("query").alias("id"), F.col("score").alias("best"))
    return target.select("entity", "id").join(near, ["entity", "id"], "left").where(F.coalesce("best", F.lit(-1.0)) < threshold).select("entity", "id")


def recent_reviews(df: DataFrame, entity: str, n: int, ts: str = "ts", key: str = "doc_id") -> DataFrame:
    """The latest n of each entity, rows without a time last."""
    w = Window.partitionBy(entity).orderBy(F.col(ts).desc_nulls_last(), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sample_reviews(df: DataFrame, n: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """n rows by a seeded hash (a top-n, pruned in each task)."""
    return df.orderBy(shuffled(seed, key), key).limit(n)


def age_weighted(df: DataFrame, entity: str, now: Column, ts: str = "ts", vector: str = "vector") -> DataFrame:
    return entity_vectors(df, entity, vector, R.age_weight(F.col(ts), now))


def build_points(df: DataFrame, restaurant: str, review: str, text: str = "text", encoder: Callable = hashing_encoder()) -> DataFrame:
    """Review points: md5 id, metadata and the dense vector of non-empty texts."""
    rows = df.where(F.length(F.trim(F.col(text))) > 0).withColumn("point_id", R.point_id(F.col(restaurant), F.col(review)))
    return embed(rows, text, encoder)
