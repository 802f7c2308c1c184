"""Alignment, the Merkle manifest and the chunk codec against plain versions of what they compute."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from larkspur.llm.chunk_codec import encode_decode
from larkspur.llm.merkle import manifest, op12_sql
from larkspur.llm.token_alignment import align_and_count, groups

from .helpers import DOCS, awkward, empty

BYTES, PIECES = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- alignment


def alignment(texts):
    """For each text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    letter = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    spell_a = lambda i: bytes(letter[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, links = [], Counter()
    for t in texts:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        xa, xb = [spell_a(i) for i in ia], [spell_b(i) for i in ib]
        if not t or b"".join(xa) != (" " + t).encode() or b"".join(xb) != (" " + t).encode():
            found.append(([], [], [], []))
            continue
        ends_a, ends_b = ([sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (xa, xb))
        both = sorted(set(ends_a) & set(ends_b))
        text = ";".join(",".join(str(i) for i, e in zip(ia, ends_a) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(ib, ends_b) if lo < e <= hi) for lo, hi in zip([0, *both], both))
        mine = [(i, j) for i, e in zip(ia, ends_a) for j, f in zip(ib, ends_b) if e == f]
        links.update(mine)
        found.append((ia, ib, mine, [text, len(both)]))
    most = Counter()
    for (i, j), n in links.items():
        most[j] = max(most[j], n)
    return [(len(ia), len(ib), x[1] if x else 0, len(m), sum(links[p] == most[p[1]] for p in m), sum(links[p] for p in m), sha(x[0]) if x else "") for ia, ib, m, x in found]


def test_alignment_equals_brute_force(spark):
    rng = random.Random(5)
    parts = ["the", " cat", "s", "  ", "\n", "naïve", "漢字", "🎉", "<s>", "</s>", "<unk>", "<|endoftext|>", "▁", "don't", "1234", "\t", "ﬁ", " ", "zzqx"]
    texts = [None, "", " ", "<s>", "a", "▁"] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30))) for _ in range(80)] + ["Plain words, plain words. " * 40]
    df = spark.createDataFrame([(i, t, "x", None, 0) for i, t in enumerate(texts)], DOCS).repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in align_and_count(df, BYTES, PIECES).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert [got[i] for i in range(len(texts))] == alignment(texts)


def test_alignment_of_awkward_and_empty_tables(spark):
    rows = awkward(spark).select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, alignment([r["text"] for r in rows])))
    got = align_and_count(awkward(spark), BYTES, PIECES).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(map(tuple, got.collect())) == want
    assert align_and_count(empty(spark), BYTES, PIECES).count() == 0


def test_very_long_texts(spark):
    """Texts of two million characters, with and without spaces, beside a short one."""
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(350_000)), "ab1-" * 500_000, "short"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in encode_decode(df, BYTES).collect()}
    assert [got[i] for i in range(3)] == encoded(texts)
    out = {r["doc_id"]: r for r in align_and_count(df, BYTES, PIECES).collect()}
    assert [out[i]["n_a"] for i in range(3)] == [n for n, _, _ in encoded([" " + t for t in texts])]
    assert all(0 < out[i]["n_groups"] == out[i]["n_links"] <= min(out[i]["n_a"], out[i]["n_b"]) for i in range(3))


def test_groups_of_two_tilings():
    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n - 1)), n})) for _ in range(2))
        both = np.intersect1d(a, b)
        la, lb = groups(a, b)
        assert (b[la] == both[np.searchsorted(both, a)]).all() and (b[lb] == both[np.searchsorted(both, b)]).all()


# ---------------------------------------------------------------- encoding and decoding


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(len(i), sha(",".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for i in ids]


def joined_texts():
    """Texts that share passages, with special strings, contractions and spaces where chunks may end."""
    rng = random.Random(11)
    parts = ["a", "the", " ", "  ", "\n", "'", "'s", "'re", "<|endoftext|>", "<|", "|>", "é", "漢", "1", "23", ".", "...", " word ", " don't", "supercalifragilistic"]
    passages = ["".join(rng.choice(parts) for _ in range(rng.randint(5, 120))) for _ in range(12)]
    return [None, "", " ", "'", "<|endoftext|>" * 30, "x" * 30_000, "x" * 30_000 + " y", " " * 5000] + ["".join(rng.choice(passages + parts) for _ in range(rng.randint(1, 9))) for _ in range(150)]


@pytest.mark.parametrize("cut", [{}, {"window": 4, "log2": 2, "most": 64}, {"window": 8, "log2": 5, "most": 7}])
def test_codec_equals_library(spark, cut):
    texts = joined_texts()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in encode_decode(df, BYTES, **cut).collect()}
    assert [got[i] for i in range(len(texts))] == encoded(texts)


def test_codec_with_a_full_filter(spark):
    """A filter that says yes to everything sends every chunk the long way, with the same rows."""
    texts = joined_texts()[:60]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in encode_decode(df, BYTES, window=4, log2=2, most=64, filter_bits=3).collect()}
    assert [got[i] for i in range(len(texts))] == encoded(texts)


def test_codec_of_awkward_and_empty_tables(spark):
    rows = awkward(spark).select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, encoded([r["text"] for r in rows])))
    assert Counter(map(tuple, encode_decode(awkward(spark), BYTES).collect())) == want
    assert encode_decode(empty(spark), BYTES).count() == 0


# ---------------------------------------------------------------- Merkle manifest


def manifest_of(rows):
    """Rows (doc_id, text, lang, source, n_chars) as the manifest's, level by level from the whole lists."""
    import zlib

    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, t: sha(part(r[0]) + part(r[3]) + part(r[2]) + part(r[4]) + part(t))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def path(all_levels, i):
        out = []
        for level in all_levels[:-1]:
            low = i - i % 8
            out.append((level[low:i], level[i + 1 : low + 8]))
            i //= 8
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for x in langs]
    trees = [levels([leaf(r, r[1]) for r in p]) for p in parts]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, p in enumerate(parts):
        for i, r in enumerate(p):
            steps = path(trees[k], i) + path(top, k)
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            digest = leaf(r, r[1].translate(lower) if chosen else r[1])
            for before, after in steps:
                digest = sha("".join(before) + digest + "".join(after))
            out.append((r[0], leaf(r, r[1]), trees[k][-1][0], top[-1][0], sha("".join("".join(b + a) for b, a in steps)), digest, digest == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("sizes", [[1], [2, 1, 8], [9, 64, 65, 0, 513], [700, 1, 3, 73] + [1] * 70])
@pytest.mark.parametrize("tall", [1, 2, 3])
def test_manifest_equals_whole_lists(spark, sizes, tall):
    """One language and many, ragged ends of every kind, partitions of 8, 64 and 512 leaves."""
    rng = random.Random(sum(sizes))
    rows = [(rng.randint(0, 10**9), rng.choice(["Text", "text", "Ünï", None, ""]) , None if k == 1 else f"l{k}", rng.choice(["s", None]), rng.choice([3, None])) for k, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert Counter(map(tuple, manifest(df, tall).collect())) == manifest_of(rows)


def test_manifest_of_awkward_and_empty_tables(spark):
    df = awkward(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert Counter(map(tuple, manifest(df).collect())) == manifest_of(rows)
    assert manifest(empty(spark)).count() == 0


def test_manifest_sql(spark):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    names = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert Counter(con.execute(f"SELECT {names} FROM ({op12_sql()})").fetchall()) == manifest_of(rows)
