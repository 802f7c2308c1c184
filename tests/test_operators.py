"""Hand-computed edge cases, and invariants of what has random parts or state."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import jsonx as J
from larkspur.functions import rules as R
from larkspur.functions import text as T
from larkspur.operators import datasets as D
from larkspur.operators import evaluation as E
from larkspur.operators import features as X
from larkspur.operators import opsmetrics as M
from larkspur.operators import phrases as P
from larkspur.operators import ranking as K
from larkspur.operators import retrieval as Q
from larkspur.operators import sampling as S
from larkspur.operators import upsert as U
from larkspur.plans.features import interactions
from larkspur.sources import readers as I

from .conftest import SF


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("a a b", []), ("ab ab cd", ["ab cd"]), ("", []), (None, []), ("가나 ab, cd", ["가나 ab", "ab cd"])])
def test_bigrams(spark, text, want):
    assert one(spark, T.bigrams(T.tokens(F.col("t"))), t=text) == want


def test_text_functions(spark):
    assert one(spark, T.normalize_text(F.lit("so  goooood!!! ☆ 맛있어요요요"))) == "so god! 맛있어요"
    assert one(spark, T.phrase_classes(F.lit("good price"), {"p": ("price",), "g": ("good",), "x": ("zz",)})) == ["p", "g"]
    assert one(spark, T.phrase_classes(F.lit("none"), {"p": ("price",)})) == ["other"]
    assert one(spark, T.est_tokens(F.lit("a b c"))) == 3 and one(spark, T.est_tokens(F.lit("abc"), "chars")) == 2
    ok = lambda s, lift: one(spark, T.valid_sentence(F.lit(s), F.lit(lift), ("average",), ("above",), ("best",), ("strength",)))
    assert ok("About 12% above average.", 12) and not ok("12% and 13% above average", 12) and not ok("best 12% above average", 12)
    assert ok("a strength, 40% above average", 40) and not ok("a strength, 12% above average", 12)
    assert one(spark, T.sentence_with_percent(F.lit("One. Two 5% here. Three."))) == "Two 5% here."


@pytest.mark.parametrize("score,want", [(0.0, "negative"), (0.299, "negative"), (0.3, "neutral"), (0.799, "neutral"), (0.8, "negative"), (0.801, "positive"), (1.0, "positive")])
def test_sentiment_border(spark, score, want):
    assert one(spark, R.sentiment_label(F.lit(score))) == want


def test_rules(spark):
    day = lambda s: str(one(spark, R.visit_date(F.lit(s))))[:10]
    assert [day(s) for s in ("25.9.19.x", "25.2.30", "x", "2024.1.2")] == ["2025-09-19", "2025-01-01", "2025-01-01", "2024-01-02"]
    assert [one(spark, R.tier_to_num(F.lit(s))) for s in ("low", "3", "0.4", "", "HIGH", "odd", "9")] == [0.2, 0.6, 0.4, 0.5, 0.8, 0.5, 1.0]
    assert [one(spark, R.price_tier(F.lit(s))) for s in ("9999", "10000", "20000", " mid ")] == ["LOW", "MID", "HIGH", "MID"]
    assert one(spark, R.user_key(F.lit(" "), F.lit("x"))) == "a_x" and one(spark, R.user_key(F.lit("nan"), F.lit(None).cast("string"))) is None
    assert one(spark, R.name_uuid(F.lit("python.org"))) == str(__import__("uuid").uuid5(__import__("uuid").NAMESPACE_URL, "python.org"))
    assert one(spark, R.signal_of(F.lit("odd"))) == "IMPRESSION" and one(spark, R.sample_weight(F.lit("view"))) == 0.2


@pytest.mark.parametrize("text,want", [('{"a": 1}', {"a": 1}), ('x {"a": 1,} y', {"a": 1}), ("{a: 1}", {"a": 1}), ("{'a': 'b'}", {"a": "b"}), ('```json\n[1, 2]\n```', [1, 2]), ("{", None), ("", None), (None, None), ("{'a': 'b', c: [1,],}", {"a": "b", "c": [1]}), ('{"a": "}{"} x', {"a": "}{"}), ('{"a": [1, 2', None), ('{"a": {"b": "it\'s"}}', {"a": {"b": "it's"}}), ("12", 12), ("no", None), ("{'a' 1}", None), ('{"a": 1e3, b: -2.5, c: null, d: true}', {"a": 1000.0, "b": -2.5, "c": None, "d": True}), ("[{'a': 1}, 2]", [{"a": 1}, 2]), ("see [1] and {a: 1}", {"a": 1}), ('{"a": "x\ny"}', None)])
def test_relaxed_json(text, want):
    assert J.relaxed(text) == want


def test_summary_schema(spark):
    good = '{"service":{"summary":"s","bullets":[],"evidence":[]},"price":{"summary":"s","bullets":["b"],"evidence":[1]},"food":{"summary":"","bullets":[],"evidence":[]},"overall_summary":{"summary":"o"}}'
    ok = lambda s, **k: one(spark, J.schema_ok(F.col("t"), **k), t=s)
    assert ok(good) and not ok(good.replace("[1]", '["1"]')) and ok(good.replace(',"evidence":[]', "").replace(',"evidence":[1]', ""), evidence=False)
    assert not ok(good.replace('"summary":"o"', '"summary":1')) and not ok("{") and not ok("[]")
    r = one(spark, J.repair_summary(F.from_json(F.lit('{"food":{"examples":["x"," ","y"],"evidence":["2","z"]}}'), J.SUMMARY)))
    assert r["food"]["bullets"] == ["x", "y"] and r["food"]["evidence"] == [2, 0] and r["price"]["summary"] == ""
    assert one(spark, J.quality_reason(F.lit('{"service":{}}'))) == "missing_price"


def test_quantile_split_of_few(spark):
    df = spark.createDataFrame([(f"p{i}", 9) for i in range(5)], "phrase string, cnt long")
    assert {r["part"] for r in P.quantile_split(df).collect()} == {"head"}
    big = spark.createDataFrame([(f"p{i:04d}", 2000 - i) for i in range(1000)], "phrase string, cnt long")
    n = {r["part"]: r["count"] for r in P.quantile_split(big).groupBy("part").count().collect()}
    assert n == {"head": 20, "mid": 180, "tail": 800}
    seeds = P.pick_seeds(P.quantile_split(big)).collect()
    assert len(seeds) == 26 and sorted(seeds) == sorted(P.pick_seeds(P.quantile_split(big.repartition(7))).collect())


def test_reversed_phrases(spark):
    df = spark.createDataFrame([("b a", 5, 1), ("a b", 3, 2), ("c d", 1, 3)], "phrase string, cnt long, pos int")
    assert sorted(tuple(r) for r in P.merge_reversed(df).select("phrase", "cnt").collect()) == [("b a", 8), ("c d", 1)]


def test_auc_of_ties_and_one_class(spark):
    auc = lambda rows: K.auc(spark.createDataFrame(rows, "score double, label int")).first()["auc"]
    assert auc([(0.5, 1), (0.5, 0)]) == 0.5 and auc([(0.9, 1), (0.1, 0)]) == 1.0 and auc([(0.9, 1)]) == 0.0


def test_negatives_are_never_positives(spark):
    i = interactions(spark, SF).select("ord", "line", "user", "item", "category", "tier", "signal", "label", "weight")
    out = S.add_negatives(i, 2)
    neg, pos = out.where("signal = 'NO_FEEDBACK'"), i.where("label = 1")
    assert neg.join(pos, ["user", "item"], "left_semi").count() == 0
    whole = pos.dropDuplicates()
    assert 1.9 * whole.count() <= neg.count() <= 2 * whole.count()
    key = lambda d: sorted((r["ord"], r["line"], r["item"]) for r in d.where("signal = 'NO_FEEDBACK'").collect())
    assert key(out) == key(S.add_negatives(i.repartition(3), 2))


def test_hot_users_get_their_whole_pool(spark):
    row = lambda u, i, label: (u, i, "c", "t", "S", label, 1.0)
    schema = "user long, item long, category string, tier string, signal string, label int, weight double"
    hot = spark.createDataFrame([row(1, i, int(i >= 5)) for i in range(1000)] + [row(2, i, int(i >= 999)) for i in range(1000)] + [row(3, i, int(i > 0)) for i in range(1000)], schema)
    got = {}
    for r in S.add_negatives(hot, 2).where("signal = 'NO_FEEDBACK'").collect():
        got.setdefault(r["user"], []).append(r["item"])
    assert len(got[1]) == 2 * 995 and set(got[1]) == set(range(5)) and len(got[2]) == len(set(got[2])) == 2 and got[3] == [0] * 999


def test_negatives_are_the_stated_draws(spark):
    """Against plain Python: first look, further draws (users with most of the items) and exact pools."""
    import hashlib

    number = lambda *p: (int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    n, k, seed = 200, 2, 42
    rows = [(1000 * u + i, u, i, "c", "t", "S", int(i >= free), 1.0) for u, free in ((1, 150), (2, 12), (3, 3), (4, 1), (5, 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "ord long, user long, item long, category string, tier string, signal string, label int, weight double")
    held = {}
    for _, u, i, *_rest in rows:
        held.setdefault(u, set()).update([i] if _rest[3] else [])
    want, looks = {}, [0, 0, 0]
    for o, u, i, *_rest in rows:
        if not _rest[3]:
            continue
        found, needed = [], 0
        a, b, c = (int(hashlib.md5(f"{seed}:{o}:1".encode()).hexdigest()[j : j + 8], 16) % S.PRIME for j in (0, 8, 16))
        for t in range(1, 16 * k + 65):
            at = ((a * t + b) % S.PRIME * t + c) % S.PRIME * n // S.PRIME
            if at not in held[u] and at not in found:
                found.append(at)
                needed = t if len(found) == k else needed
        if len(found) < k:
            pool = sorted(set(range(n)) - held[u], key=lambda x: hashlib.md5(f"{seed + 2}:{u}:{x}".encode()).hexdigest())
            first = int(number(seed + 2, f"{o}:1") * len(pool))
            found = [pool[(first + t) % len(pool)] for t in range(min(k, len(pool)))]
        looks[2 if not needed else needed > 2 * k + 4] += 1
        want[o] = sorted(found[:k])
    got = {o: [] for o in want}
    for r in S.add_negatives(df, k, key=("ord",)).where("signal = 'NO_FEEDBACK'").collect():
        got[r["ord"]].append(r["item"])
    assert min(looks) > 10 and {o: sorted(x) for o, x in got.items()} == want


def test_draws_are_even(spark):
    """First draws, later ones and pairs of them fall on every part of the range alike."""
    rows = spark.range(40_000).select(S.seeds(7, "id").alias("s"))
    tenth = lambda t: S.nth_place(F.col("s"), F.lit(t).cast("long"), F.lit(1000).cast("long"))
    got = rows.select(*[F.floor((tenth(t) - 1) / 100).alias(f"t{t}") for t in (1, 2, 96)], tenth(1).alias("p"))
    assert got.agg(F.min("p"), F.max("p")).first()[:] == (1, 1000)
    for c in ("t1", "t2", "t96"):
        n = {r[0]: r[1] for r in got.groupBy(c).count().collect()}
        assert sorted(n) == list(range(10)) and all(3700 < x < 4300 for x in n.values())
    pairs = [r["count"] for r in got.groupBy("t1", "t2").count().collect()]
    assert len(pairs) == 100 and 300 < min(pairs) and max(pairs) < 500


def test_eval_lists_of_hot_users_are_whole(spark):
    rows = [(g, u, i, int(i >= free)) for g, (u, free) in enumerate([(1, 200), (2, 100), (3, 99)]) for i in range(1000)]
    lists = S.build_eval_lists(spark.createDataFrame(rows, "grp long, user long, item long, label int"), 100, 50, 1000).collect()
    for g, free in ((0, 200), (1, 100)):
        neg = [r["item"] for r in lists if r["grp"] == g and r["label"] == 0]
        assert len(neg) == len(set(neg)) == 100 and max(neg) < free
    assert {r["grp"] for r in lists} == {0, 1}


def test_eval_lists_have_one_positive(spark):
    i = interactions(spark, SF).withColumn("grp", F.col("user"))
    lists = S.build_eval_lists(i, 20, 10, 50)
    r = lists.groupBy("grp").agg(F.sum("label").alias("p"), F.count("*").alias("n"), F.count_distinct("item").alias("d")).collect()
    assert r and all((x["p"], x["n"], x["d"]) == (1, 21, 21) for x in r)
    assert lists.where("label = 0").join(i.where("label = 1").select("user", "item"), ["user", "item"], "left_semi").count() == 0


@pytest.mark.parametrize("n,windows", [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)])
def test_windows_at_the_borders(spark, n, windows):
    df = spark.createDataFrame([("a", i, None) for i in range(n)], "source string, doc_id long, ts timestamp")
    w = S.review_windows(df, ((3, 2),), whole=False).collect()
    assert len(w) == windows and all(len(r["reviews"]) == 3 for r in w)


def test_positions_without_one_task(spark):
    df = spark.range(5000).withColumn("h", F.xxhash64("id"))
    got = S.numbered(df, F.col("h")).orderBy("h").select("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 5001))


@pytest.mark.parametrize("partitions", [8, 200])
def test_positions_of_wide_rows(spark, partitions):
    """Every row once, positions 1..n, however adaptive execution deals wide and narrow rows."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        df = spark.range(300_000).withColumn("h", F.xxhash64("id")).withColumn("wide", F.repeat(F.md5(F.col("id").cast("string")), 5))
        r = S.numbered(df, F.col("h")).agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.count_distinct("pos").alias("d"), F.count_distinct("id").alias("i")).first()
        assert tuple(r) == (300_000, 1, 300_000, 300_000, 300_000)
        split = S.holdout_split(df, 0.25, None, "id").groupBy("split").count().collect()
        assert {x["split"]: x["count"] for x in split} == {"train": 225_000, "test": 75_000}
        assert S.assign_round_robin(df, "id", 7).count() == 300_000
        sums = S.cumulated(df.select("id", (F.col("id") % 3).alias("v")), "v", F.col("id"), name="s")
        assert sums.where("s <> id div 3 * 3 + if(id % 3 = 0, 0, if(id % 3 = 1, 1, 3))").count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_equal_positive_rows_have_negatives_of_their_own(spark):
    row = lambda u, i, label: (u, i, "c", "t", "S", label, 1.0)
    df = spark.createDataFrame([row(1, 0, 1)] * 5000 + [row(2, i, 0) for i in range(5000)], "user long, item long, category string, tier string, signal string, label int, weight double")
    neg = S.add_negatives(df, 2).where("signal = 'NO_FEEDBACK'")
    assert neg.count() == 10_000 and neg.select("item").distinct().count() > 2000 and neg.where("item = 0").count() == 0


def test_targets_fill_groups_in_order(spark):
    df, targets = spark.range(5000), spark.createDataFrame([(1, 10), (2, 3000), (3, 0), (4, 1500)], "grp int, cnt long")
    got = {r["grp"]: r["count"] for r in S.assign_targets(df, "id", targets).groupBy("grp").count().collect()}
    assert got == {1: 10 + 490, 2: 3000, 4: 1500}


def test_complete_partitions_of_a_stream(spark, tmp_path):
    from larkspur.streaming import jobs as J2

    def land(day, n, done):
        spark.range(n).write.parquet(f"{tmp_path}/in/raw/dt={day}")
        marker = tmp_path / "in" / "raw" / f"dt={day}" / "_SUCCESS"
        marker.touch() if done else marker.unlink()

    def run():
        s = J2.stream_complete(spark, f"{tmp_path}/in", "raw", spark.range(1).schema)
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return {r["dt"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("dt").count().collect()}

    assert J2.stream_complete(spark, f"{tmp_path}/in", "raw", spark.range(1).schema) is None
    land("2026-01-01", 5, True)
    land("2026-01-02", 7, False)
    assert run() == {"2026-01-01": 5}
    (tmp_path / "in" / "raw" / "dt=2026-01-02" / "_SUCCESS").touch()
    assert run() == {"2026-01-01": 5, "2026-01-02": 7}


def test_percentiles_of_one_row_and_many(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert tuple(M.index_percentile(df, "v", (50, 95, 99)).first()) == (6.0, 10.0, 10.0)
    assert tuple(M.index_percentile(df.where("v = 3"), "v", (50, 99)).first()) == (3.0, 3.0)


def test_goodput_of_nothing(spark):
    df = spark.createDataFrame([], "ms double, tokens long, ttft double")
    r = M.goodput(df, 10).first()
    assert r["requests"] == 0 and r["throughput_tps"] == 0.0


def test_vocabulary_ties_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (" ",)], "f string")
    v = X.build_vocab(df, ["f"])
    assert sorted((r["value"], r["idx"]) for r in v.collect()) == [("a", 2), ("b", 3), ("c", 1)]
    assert [r["f_idx"] for r in X.encode(spark.createDataFrame([("z",), ("c",)], "f string"), v, ["f"]).orderBy("f").collect()] == [1, 0]


def test_preferred_categories(spark):
    p = X.preferred(F.from_json(F.lit('[{"category":"a","weight":1},{"category":"b","weight":3},{"category":"c","weight":0},{"category":"d","weight":0}]'), "array<struct<category:string,weight:double>>"))
    assert [(x["category"], x["weight"]) for x in one(spark, p)] == [("b", 0.75), ("a", 0.25), ("c", 0.0)]


def test_upsert_actions(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 4), (3, "c", 2)], "id long, v string, version long")
    changes = spark.createDataFrame([(1, "A", None), (2, "B", 3), (3, "C", 2), (4, "D", None)], "id long, v string, expected long")
    table, report = U.upsert(base, changes, "id")
    assert sorted(tuple(r) for r in table.collect()) == [(1, "A", 2), (2, "b", 4), (3, "C", 3), (4, "D", 1)]
    assert {r["id"]: r["action"] for r in report.collect()} == {1: "updated", 2: "skipped", 3: "updated", 4: "inserted"}


def test_evidence_is_not_reused(spark):
    h = spark.createDataFrame([(1, "food", 0, 7, 0.9, 1), (1, "food", 1, 7, 0.8, 1), (1, "food", 1, 8, 0.7, 2), (1, "food", 2, 9, 0.1, 1)], "entity long, category string, bullet long, doc long, score double, rank int")
    assert sorted((r["bullet"], r["doc"]) for r in Q.map_evidence(h).collect()) == [(0, 7), (1, 8)]


def test_dense_topk_in_blocks(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    q = v.where("doc % 5 = 0").select(F.col("doc").alias("query"), "vector")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(Q.dense_topk(q, v, 4)) == rows(Q.dense_topk(q, v.repartition(3), 4, query_block=7))


def test_rouge_and_bleu(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b", "c d"), (3, "", "x"), (4, "the cat lay on a mat now", "the cat sat on the mat")], "id long, p string, r string")
    r = {x["id"]: x for x in E.rouge(df, "p", "r", "id").join(E.rouge_l(df, "p", "r", "id"), "id").join(E.bleu(df, "p", "r", "id"), "id").collect()}
    assert (r[1]["rouge1"], r[1]["rouge2"], r[1]["rougeL"], r[1]["bleu"]) == (1.0, 1.0, 1.0, 1.0)
    assert r[2]["rouge1"] == r[2]["rougeL"] == r[2]["bleu"] == r[3]["bleu"] == 0.0
    assert r[4]["rougeL"] == round(2 * 4 / 13, 6)


def test_rouge_l_equals_the_plain_table(spark):
    import random

    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))
    rows = [(i, text(), text()) for i in range(60)]

    def plain(p, r):
        a, b = p.split(), r.split()
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return round(2 * t[-1][-1] / (len(a) + len(b)), 6) if a and b else 0.0

    got = {r["id"]: r["rougeL"] for r in E.rouge_l(spark.createDataFrame(rows, "id long, p string, r string"), "p", "r", "id").collect()}
    assert got == {i: pytest.approx(plain(p, r), abs=1.1e-6) for i, p, r in rows}


def test_bigrams_of_another_tokeniser(spark):
    df = spark.createDataFrame([("x-y-z x-y",), (None,)], "text string")
    got = {r["phrase"]: r["cnt"] for r in P.bigram_counts(df, tokens=F.split("text", "[- ]")).collect()}
    assert got == {"x y": 2, "y z": 1, "z x": 1}


def test_weighted_groups_and_images(spark):
    urls = lambda s: one(spark, D.image_urls(F.lit(s)))
    assert urls('{"image_url":"u"}') == ["u"] and urls('[{"url":"u"},{"image_url":"v"}]') == ["u", "v"] and urls('["u"]') == ["u"] and urls("x") == []


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "content": "x"}, {"review_id": 2, "text": "y"}]')
    (tmp_path / "b.json").write_text('{"reviews": [{"id": 3, "content": "z"}]}')
    assert sorted((r["id"], r["content"]) for r in I.read_reviews_json(spark, str(tmp_path)).collect()) == [(1, "x"), (2, "y"), (3, "z")]
    assert one(spark, I.blocks(F.lit("a\nb\n \n\nc"))) == ["a b", "c"]
    df = I.normalize_columns(spark.createDataFrame([(1, 2, 3)], "userId int, user_id int, eventName int"))
    assert df.columns == ["user_id", "event_name"] and df.first()["user_id"] == 2
    for dt, done in (("2026-01-01", True), ("2026-01-02", False)):
        p = tmp_path / "raw" / f"dt={dt}"
        p.mkdir(parents=True)
        (p / "x.csv").write_text("event_id,event_name\n1,click\n")
        (p / "y.json").write_text('[{"event_id": "2", "event_name": "view"}]')
        if done:
            (p / "_SUCCESS").write_text("")
    schema = spark.createDataFrame([], "event_id string, event_name string").schema
    got = I.read_raw(spark, str(tmp_path), "raw", schema).collect()
    assert sorted((r["event_id"], str(r["dt"])) for r in got) == [("1", "2026-01-01"), ("2", "2026-01-01")]
