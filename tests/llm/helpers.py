"""Brute-force counterparts, in plain Python, and small documents with awkward rows."""

import hashlib
import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "te", "lo", "ri", "mu", "so", "ke"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward(spark, extra=True):
    """Nulls, blanks, a long text, copies, near copies, repeated rows, a null id; columns that might clash."""
    rng = random.Random(3)
    base, passage = prose(rng, 200), prose(rng, 90)
    w = base.split()
    near = " ".join(w[:100] + ["changed"] + w[101:])
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", None, None), (4, None, "en", "b", 0), (5, "", "de", "b", 0), (6, " \n\t ", None, "b", 3), (7, "Word", "en", "a", 4),
            (8, prose(rng, 3000), "de", "c", 9), (9, prose(rng, 40) + " " + passage + " " + prose(rng, 30), "fr", "c", 9), (10, prose(rng, 25) + " " + passage, "fr", "a", 9), (11, base.upper(), "en", "a", 1), (7, "Word", "en", "a", 4), (None, base, "en", "a", 1), (12, "Ünïcode ñandú 漢字 🎉 " * 3, "es", "d", 5), (13, passage, "fr", "d", 2)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("row", "key", "n", "a", "b", "keys", "u", "v", "k", "size", "score", "spans", "base"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text, k):
    w = WORDS.findall((text or "").translate(LOWER))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar(rows, k, num, den):
    """rows (doc_id, text) with ids → (component by id, links)."""
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and den * len(s & t) >= num * len(s | t)]
    return components([i for i, _ in sets], links)


def removed(texts, length):
    """For each text (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out
