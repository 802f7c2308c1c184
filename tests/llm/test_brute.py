"""Operators and pipeline stages against plain counterparts that look at every pair, place or cut."""

import random
import re
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import pytest

from larkspur.llm import language_id, mixing, quality, secrets, url_filter
from larkspur.llm.decontaminate import overlaps

from . import helpers as H
from ..conftest import SF

TOKENS = re.compile("[^\x00-/:-@\\[-`{-\x7f]+")


def test_quality_cut_has_the_fewest_errors():
    rng = np.random.default_rng(3)
    for _ in range(20):
        y = rng.integers(0, 2, 60)
        x = rng.normal(size=(60, 4)) + y[:, None] * rng.uniform(0, 2, 4)
        m = quality.fit(x, y)
        s = m.score(x)
        errors = lambda cut: int(((s >= cut) != (y == 1)).sum())
        assert errors(m.cut) == min(errors(c) for c in [*s, 2.0])


def test_quality_of_ties_and_of_long_texts(spark):
    rng = random.Random(5)
    good, poor = [H.prose(rng, 80) for _ in range(20)], ["zz! " * rng.randint(5, 40) for _ in range(20)]
    long = H.prose(rng, 200_000)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + poor + [good[0], good[0], long])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int")
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.rank_quality(docs, labels).collect()}
    assert got[40] == got[41] == got[0] and got[42][1] == 1
    assert all(got[i][1] == (i < 20) for i in range(40)) and all(p == (s >= 0.3) for s, p in got.values())
    assert {r["predicted"] for r in quality.rank_quality(docs, labels.where("quality = 1")).collect()} == {1}


def test_quality_threshold_and_fit_use_every_labelled_row(spark):
    rng = random.Random(11)
    rows = []
    for i in range(9_000):
        junk = min(1.0, max(0.0, rng.gauss(0.35 if i % 2 else 0.55, 0.2)))
        rows.append((i, " ".join(rng.choice(["zz!", "7#7", "QQ"]) if rng.random() < junk else H.prose(rng, 1) for _ in range(12)), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.rank_quality(docs, labels).collect()}
    y = np.array([rows[i][2] for i in sorted(got)])
    s = np.array([got[i][0] for i in sorted(got)])
    v, at = np.unique(s, return_inverse=True)
    # Errors if everything below the k-th score is called poor, and if everything is.
    wrong = (y == 0).sum() + np.concatenate(([0], np.cumsum(np.bincount(at, 2 * y - 1))))
    assert len(got) == 9_000 and sum(got[i][1] != rows[i][2] for i in got) == wrong.min() < 4_000


def _labelled(rng, good, poor):
    x = np.abs(rng.normal(size=(good + poor, quality.WIDTH))).astype(np.float32) * (rng.random((good + poor, quality.WIDTH)) < 0.1)
    y = np.array([1] * good + [0] * poor)
    x[:, 5] += (y + rng.normal(size=len(y))).astype(np.float32)
    return x, y


def _found(spark, x, y, n):
    return spark.createDataFrame([(i, i * 7, int(q), int(k), v.tolist()) for i, (q, k, v) in enumerate(zip(y, n, x))], "doc_id long, h long, quality int, n long, x array<float>")


def test_quality_fit_in_blocks_equals_the_plain_one(spark):
    rng = np.random.default_rng(2)
    x, y = _labelled(rng, 150, 60)
    n = np.where(np.arange(len(y)) % 50 == 0, 3, 1)
    want = quality.fit(np.repeat(x, n, axis=0), np.repeat(y, n))
    got = [quality.fit_blocks(_found(spark, x, y, n).repartition(k), quality.Scratch(spark, "test")) for k in (1, 5)]
    assert np.array_equal(got[0].weights, got[1].weights) and (got[0].at, got[0].scale) == (got[1].at, got[1].scale)
    assert np.allclose(got[0].weights, want.weights, atol=1e-4) and np.isclose(got[0].at, want.at, atol=1e-2) and np.isclose(got[0].scale, want.scale, rtol=1e-3)


@pytest.mark.parametrize("seed", range(4))
def test_quality_threshold_of_tied_cuts(spark, seed):
    rng = random.Random(seed)
    rows = [(float(i), rng.randint(0, 2), rng.randint(0, 2)) for i in range(12)] + [(20.0, 1, 1)] if seed else [(1.0, 0, 2), (2.0, 3, 0)]
    rows = rows if seed < 3 else [(-s, g + 5 * (s > 6), p) for s, g, p in rows]
    wrong = [sum(p for _, _, p in rows)] + [sum(g for s, g, _ in rows if s <= c) + sum(p for s, _, p in rows if s > c) for c in sorted(r[0] for r in rows)]
    edges = [min(rows)[0] - 1, *sorted(r[0] for r in rows), max(rows)[0] + 1]
    best = [k for k, x in enumerate(wrong) if x == min(wrong)]
    k = best[len(best) // 2]
    median = lambda j: sorted(r[0] for r in rows for _ in range(r[j]))[(sum(r[j] for r in rows) - 1) // 2]
    got = quality.threshold(spark.createDataFrame(rows, "s double, good long, poor long"), quality.Scratch(spark, "test"))
    assert got == ((edges[k] + edges[k + 1]) / 2, median(1) - median(2))


@pytest.mark.parametrize("good,poor", [(2_600, 20), (300, 2_000), (1_500, 1_400), (10, 7)])
def test_quality_blocks_hold_every_row_and_both_labels(spark, good, poor):
    x, y = np.zeros((good + poor, 2)), np.array([1] * good + [0] * poor)
    rows = quality.blocks_of(_found(spark, x, y, y + 1), {0: poor, 1: good}, quality.Scratch(spark, "test")).selectExpr("*", "input_file_name() AS file").collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in rows if r["nth"] == 0} == set(range(good + poor))
    assert len({(r["doc_id"], r["block"]) for r in rows}) == len(rows) <= 2 * (good + poor)
    for block in {r["block"] for r in rows}:
        mine = [r for r in rows if r["block"] == block]
        count = Counter(r["quality"] for r in mine)
        assert len({r["file"] for r in mine}) == 1 and max(count.values()) < 700 and min(count.values()) >= min(good, poor, 30)
    order = [(r["file"], r["block"]) for r in rows]
    assert sum(a != b for a, b in zip(order, order[1:])) == len(set(order)) - 1


@pytest.mark.parametrize("seed", range(3))
def test_contamination_equals_every_diagonal(spark, seed):
    rng = random.Random(seed)
    words = [H.prose(rng, 1) + str(k) for k in range(30)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = {n: text(n) for n in (1, 2, 3, 4, 6, 9, 11, 13, 17, 30, 45)}
    docs = {}
    for i in range(120):
        t = text(rng.randint(0, 12))
        w = list(rng.choice(list(items.values())))
        a = rng.randint(0, len(w) - 1)
        w = w[a : a + rng.randint(1, 40)]
        for k in rng.sample(range(len(w)), min(len(w), rng.randint(0, 4))):
            w[k] = "swap"
        docs[i] = t + w + text(rng.randint(0, 12)) if i % 7 else w
    want = set()
    for i, t in docs.items():
        for n, u in items.items():
            w = min(13, n)
            need = max(1, ceil(0.8 * w - 1e-9))
            hit = t == u if n < 3 else any(sum(x == y for x, y in zip(t[p : p + w], u[q : q + w])) >= need for p in range(len(t) - w + 1) for q in range(n - w + 1))
            if hit:
                want.add((i, n))
    got = overlaps(spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string"), least=1)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want


def test_a_long_text_with_many_hits(spark):
    """A passage said over and over: every diagonal is looked at, none drags the whole text along."""
    rng = random.Random(8)
    item = H.prose(rng, 20)
    docs = spark.createDataFrame([(1, (item + " ") * 2000), (2, H.prose(rng, 50_000)), (3, H.prose(rng, 30_000) + " " + item)], "doc_id long, text string")
    got = overlaps(docs, spark.createDataFrame([(5, item)], "item_id long, text string"), least=1)
    assert {r["doc_id"] for r in got.collect()} == {1, 3}


def test_languages_equal_exact_sets(spark):
    """The bit masks against sets of n-grams: the same languages wherever the counts differ at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    counts = defaultdict(Counter)

    def grams(text):
        b = text.encode()
        g, doc = language_id._grams(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))
        return g.tolist()

    for r in rows:
        if r["text"] and r["lang"]:
            counts[r["lang"]].update(grams(r["text"]))
    total = {k: sum(c.values()) for k, c in counts.items()}
    rate = {k: {g: n / total[k] for g, n in c.items()} for k, c in counts.items()}
    top = Counter()
    for c in rate.values():
        for g, x in c.items():
            top[g] = max(top[g], x)
    sets = {k: {g for g, n in c.items() if n >= 2 and rate[k][g] >= 0.2 * top[g]} for k, c in counts.items()}
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    for r in rows:
        if r["text"] and re.search(r"[^\W\d_]", r["text"]):
            g = grams(r["text"])
            share = sorted(((sum(x in s for x in g) / max(1, len(g)), k) for k, s in sets.items()), reverse=True)
            if share[0][0] > share[1][0] + 0.02:
                assert got[r["doc_id"]] == share[0][1]


def test_signs_that_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "ein Haus und ein Garten", "de"), (2, "½ ² ①", None), (3, "12 _ !", None), (4, "漢字", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert got == {1: "de", 2: "und", 3: "und", 4: "de"}


def test_language_of_a_long_text(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(1, "der und die das nicht ein " * 20, "de"), (2, "the and of that with is " * 20, "en"), (3, " ".join(rng.choice(["the", "and", "that"]) for _ in range(300_000)), None), (4, None, "de"), (4, None, "de")], "doc_id long, text string, lang string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs).collect())
    assert got == [(1, "de"), (2, "en"), (3, "en"), (4, "und"), (4, "und")]


def test_equal_vectors_and_ids_with_two_vectors(spark):
    """Of an id's vectors the first counts; equal vectors link with each other and share their links."""
    from larkspur.llm.embedding_dedup import near_duplicates

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), *[(i, [3.0, 0.1]) for i in range(10, 40)], (50, [3.0, 0.2]), (60, [0.0, 2.0]), (60, [0.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=8).collect()}
    assert got[1] == (1, 1) and got[60] == (1, 1)
    assert all(got[i] == (30, 10) for i in range(10, 40)) and got[50] == (30, 10) and len(got) == 33


def test_many_base_spans_and_keys_in_one_text():
    text = " ".join(f"password=abcdef{k} {'a1b2c3d4e5f6g7h8i9j0' + str(k)}" for k in range(20_000))
    base = secrets.base_spans(text)
    found = secrets._weak(text, base)
    assert len(base) == 20_000 and len(found) == 20_000
    spans = sorted(random.Random(2).sample(range(1000), 60))
    base = [(a, a + 7) for a in spans]
    for a in range(1000):
        for n in (1, 5):
            assert secrets._meets(secrets._merged(base), a, a + n) == any(x < a + n and a < y for x, y in base)


@pytest.mark.parametrize("host,suffix,domain", [("a.b.co.uk", "co.uk", "b.co.uk"), ("b.com", "com", "b.com"), ("10.0.0.1:80", "10.0.0.1", "10.0.0.1"), ("[::1]:8080", "[::1]", "[::1]"), ("x.y.ck", "y.ck", "x.y.ck"), ("a.www.ck", "ck", "www.ck"), ("localhost", "localhost", "localhost"), ("u@x.gov.uk", "gov.uk", "x.gov.uk"), ("", "", ""), ("co.uk", "co.uk", "co.uk")])
def test_suffixes_domains_and_addresses(spark, host, suffix, domain):
    from pyspark.sql import functions as F

    s, d = url_filter.domain_parts(F.lit(host))
    r = spark.range(1).select(s.alias("s"), d.alias("d")).first()
    assert (r["s"], r["d"]) == (suffix, domain)


def test_urls_of_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/fr/x")] * 3 + [(2, "http://a.com/q"), (None, None)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS n")
    got = Counter((r["page_id"], r["verdict"]) for r in url_filter.filter_urls(pages.select("page_id", "url")).collect())
    assert got == {(1, "allow"): 3, (2, "allow"): 1, (None, "allow"): 1}


def test_mix_of_many_equal_rows(spark):
    """Equal rows are documents of their own, numbered in parts of bounded length."""
    same = spark.range(30_000).selectExpr("7L AS doc_id", "'a b c' AS text", "'s' AS source")
    other = spark.range(10_000).selectExpr("id AS doc_id", "repeat('w ', int(id % 50) + 1) AS text", "if(id % 3 = 0, null, 't') AS source")
    out = mixing.mix(same.unionByName(other)).cache()
    assert out.count() == 40_000 and out.where("doc_id = 7 and source = 's'").selectExpr("taken").distinct().count() > 1
    for r in out.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"]
    again = mixing.mix(same.unionByName(other).repartition(5))
    assert out.select("doc_id", "source", "size", "taken").exceptAll(again.select("doc_id", "source", "size", "taken")).count() == 0
    assert out.where("taken > 3 * size").count() == 0


def test_pipeline_stages_on_awkward_rows(spark):
    """Each stage on nulls, blanks, copies and null ids, against what its rule says of every row."""
    import corpus_pipeline as P

    docs = H.awkward(spark)
    bench = spark.createDataFrame([(1, H.prose(random.Random(31), 30))], "item_id long, text string")
    path = f"{__import__('tempfile').mkdtemp(prefix='spark-larkspur-')}"
    bench.write.parquet(f"{path}/benchmark.parquet")
    rows = docs.collect()
    kept = P.language(spark, docs, path)
    pred = {(r["doc_id"], r["row"]): (r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()}
    left = kept.collect()
    assert all(re.search(r"[^\W\d_]", r["text"]) for r in left) and len(left) == sum(p != "und" and s >= 0.3 for (p, s) in (pred[k] for k in pred for _ in range(sum(1 for r in rows if (r["doc_id"], r["text"]) == (7, "Word")) if k[0] == 7 else 1)))
    kept = P.STAGES[1][1](spark, kept, path)
    ids = [(r["doc_id"], r["text"]) for r in left]
    comp = H.similar(ids, 5, 4, 5)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in ids if i is None or comp[i] == i)
    clean = P.STAGES[2][1](spark, kept, path)
    dirty = {(r["doc_id"]) for r in overlaps(kept, bench, least=1).collect()}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r["doc_id"] for r in kept.collect() if r["doc_id"] not in dirty)
    masked = P.STAGES[3][1](spark, clean, path)
    assert masked.columns == docs.columns and masked.count() == clean.count()
    mixed = P.STAGES[4][1](spark, masked, path)
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in masked.collect())
    empty = H.empty(spark)
    for _, stage in P.STAGES:
        assert stage(spark, empty, path).count() == 0
