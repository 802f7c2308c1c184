"""Queries on small tables that are odd in one way, against their SQL."""

import random
import tempfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur import registry
from larkspur.operators import evaluation as E

from .test_queries import plain

ALL = registry._all()


def against_sql(spark, name, **tables):
    """(rows of the query, rows of its SQL) over tables, as counts."""
    duckdb = pytest.importorskip("duckdb")
    con, folder = duckdb.connect(), tempfile.mkdtemp(prefix="spark-larkspur-")
    con.execute("SET timezone='UTC'")
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    fn, sql = ALL[name]
    df = fn(spark, folder)
    cols = sorted(df.columns)
    q = con.execute(sql)
    names = [c[0] for c in q.description]
    assert sorted(names) == cols
    rows = lambda found: Counter(repr([plain(r[k]) for k in found[0]]) for r in found[1])
    return rows((cols, df.collect())), rows(([names.index(c) for c in cols], q.fetchall()))


def test_texts_without_a_sentence(spark):
    texts = ["", None, " ", "! ? . ", "...", "One. Two! Three", "x" * 399 + ". y", "x" * 401 + ". y", "é. " * 9]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got, want = against_sql(spark, "clipped_sentences", documents=docs)
    assert got == want


def test_skip_by_whole_seconds(spark):
    """Gaps within half a second of the hour, several events in one second, and halves."""
    rng, rows = random.Random(5), []
    for user in range(60):
        t = 1_704_067_200_000_000 + rng.randint(0, 10**6)
        for _ in range(12):
            rows.append((len(rows), t, user))
            rows.append((len(rows), t + rng.choice([0, 400_000, 500_000]), user))
            t += 3_600_000_000 + rng.choice([-1_000_000, -500_000, -499_999, -300_000, 0, 300_000, 500_000]) - rng.choice([0, t % 1_000_000])
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long").select("event_id", F.timestamp_micros("t").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    got, want = against_sql(spark, "stream_skip", events=events)
    assert got == want


def test_bleu_shuffles_no_runs_of_words(spark, monkeypatch):
    """Matches by brute force, and none of them counted by an exchange."""
    rng, rows = random.Random(9), []
    for i in range(400):
        text = lambda: rng.choice([None, "", " "]) if rng.random() < 0.05 else " \t".join(rng.choice("ab cd é 漢 x,".split()) for _ in range(rng.randint(1, 30)))
        rows.append((i, text(), text()))
    a, b = ([(t or "").split() for t in x] for x in list(zip(*rows))[1:])
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    want = [[sum((grams(x, n) & grams(y, n)).values()) for n in (1, 2, 3, 4)] for x, y in zip(a, b)]
    assert E.clipped_matches(pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string()))).tolist() == want
    assert E.clipped_matches(pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.string()))).shape == (0, 4)
    df = spark.createDataFrame(rows, "id long, p string, r string")
    out = E.bleu(df, "p", "r", "id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    whole = {r["id"]: r["bleu"] for r in out.collect()}
    monkeypatch.setattr(E, "WORDS_AT_ONCE", 7)
    assert len(whole) == 400 and {r["id"]: r["bleu"] for r in E.bleu(df, "p", "r", "id").collect()} == whole
