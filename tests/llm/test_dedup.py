import random

import numpy as np
import pytest

from larkspur.llm.components import components
from larkspur.llm.common import Scratch
from larkspur.llm.embedding_dedup import near_duplicates
from larkspur.llm.jaccard_join import one_of_each, similar_sets
from larkspur.llm.substring_dedup import remove_repeats

from . import helpers as H
from ..conftest import SF


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def test_components_of_a_chain_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in (200, 201, 202)}}


@pytest.mark.parametrize("size,num,t", [(3, 90, 0.9), (5, 80, 0.8)])
def test_jaccard_equals_brute_force(spark, size, num, t):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = H.similar([tuple(r) for r in docs.collect()], size, num, 100)
    got = similar_sets(docs, size, t).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["n_shingles"] == len(H.shingle_set(texts[r["doc_id"]], size)) for r in got)


def test_jaccard_of_groups_that_differ_around_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for g in range(6):
        w = H.prose(rng, 120 + 40 * g).split()
        for c in range(8):
            v = list(w)
            for _ in range(c):
                v[rng.randrange(len(v))] = H.prose(rng, 1) + "x"
            rows.append((len(rows), " ".join(v)))
    passage = H.prose(rng, 60)
    rows += [(100 + i, H.prose(rng, 15) + " " + passage) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar_sets(docs).collect()}
    assert got == H.similar(rows, 3, 90, 100)


def test_jaccard_awkward_and_empty(spark):
    docs = H.awkward(spark)
    got = similar_sets(docs).collect()
    assert len(got) == docs.count()
    want = H.similar([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 90, 100)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    kept = [r["doc_id"] for r in one_of_each(docs).select("doc_id").collect()]
    assert sorted(kept, key=str) == sorted([1, 4, 5, 6, 7, 7, 8, 9, 10, 12, 13, None], key=str)
    assert one_of_each(docs).columns == docs.columns
    assert similar_sets(H.empty(spark)).count() == 0 and one_of_each(H.empty(spark)).count() == 0


def test_repeats_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 20000")
    rows = docs.collect()
    want = sorted((r["doc_id"], *x) for r, x in zip(rows, H.removed([r["text"] for r in rows], 400)))
    assert rows_of(remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize("limit", [1 << 20, 700])
def test_repeats_at_every_boundary(spark, limit):
    rng = random.Random(9)
    part = H.prose(rng, 120)
    texts = [part[:160], part[:159], "x" + part[:160] + "y", part, part[37:], part[:300] + "q" + part[300:], "ab" * 400, "z" * 500, None, "", H.prose(rng, 300) + part[100:400] + H.prose(rng, 300) + part[90:420], "é" * 150, "aé" * 90]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = rows_of(remove_repeats(docs, 160, limit), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((i, *x) for i, x in enumerate(H.removed(texts, 160))), key=repr)


def test_repeats_awkward_and_empty(spark):
    docs = H.awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *x) for r, x in zip(rows, H.removed([r["text"] for r in rows], 400))), key=repr)
    assert rows_of(remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert remove_repeats(H.empty(spark)).count() == 0


def test_repeats_of_adversarial_bytes(spark):
    """Thue-Morse strings share polynomial hashes modulo powers of two; the prime ones part them."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    rng = random.Random(4)
    docs = [(i, t) for i, t in enumerate([a[:2048], b[:2048], H.prose(rng, 50) + a[1000:1700], "ab" * 700, "z" * 9000, "z" * 500])]
    got = rows_of(remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((i, *x) for (i, _), x in zip(docs, H.removed([t for _, t in docs], 400))), key=repr)


def test_passages_shared_with_another_row(spark):
    """255 bytes that another row has show; less than 192 do not, nor what one row repeats itself."""
    rng = random.Random(6)
    text = [H.prose(rng, 200) for _ in range(12)]
    rows = [(0, text[0] + text[1][40:295] + text[2]), (1, text[3] + text[1] + text[4]), (2, text[5] + text[6][10:200] + text[7]), (3, text[6]), (4, text[8] + text[9] + text[8]), (5, text[10]), (5, text[10]), (6, text[11][:255]), (7, text[11]), (8, None), (9, "")]
    got = {(r["doc_id"], r["n_passages"] > 0) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, True), (1, True), (2, False), (3, False), (4, False), (5, True), (6, True), (7, True), (8, False), (9, False)}


def brute_cosine(rows, t=0.9):
    ids = [i for i, e in rows]
    ok = [e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e in rows]
    unit = [np.array(e, float) / np.linalg.norm(e) if o else None for (_, e), o in zip(rows, ok)]
    links = [(ids[a], ids[b]) for a in range(len(rows)) for b in range(a) if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= t]
    comp, n = H.components(ids, links), {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], comp[i], comp[i] == i) for i in ids)


@pytest.mark.parametrize("block", [4096, 16])
def test_embeddings_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(30):
        c = rng.normal(size=16)
        for _ in range(rng.integers(1, 30)):
            rows.append((len(rows) * 3 + 1, (c + rng.normal(size=16) * 0.25).astype(np.float32).tolist()))
    rows += [(0, None), (2, [0.0] * 16), (5, [float("nan")] * 16), (8, [float("inf")] + [1.0] * 15), (11, [1.0, None] + [0.0] * 14), (14, [1.0, 2.0]), (17, [2.0, 4.0]), (20, [])]
    v = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS cell", "2 AS home", "3 AS n", "4 AS i")
    got = rows_of(near_duplicates(v, per_cell=40, block=block), "vec_id", "n_links", "component_id", "kept")
    want = sorted(brute_cosine(rows), key=repr)
    # An index: at least nine tenths of the links, none below the threshold; here it finds all.
    assert got == want


def test_embeddings_repeated_null_and_empty(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert rows_of(near_duplicates(v), "vec_id", "n_links", "component_id", "kept") == sorted([(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)], key=repr)
    assert near_duplicates(v.limit(0)).count() == 0
