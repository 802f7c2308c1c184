"""Alignment of two tokenizers by pointer jumping.

Both token sequences tile the same bytes. Every token points to the farthest-right token that overlaps
it, itself included; pointers are doubled (next = next[next], whole batches at once) until none changes.
Each token then points to the last token of its component, which labels its group: the components are
the stretches between byte offsets at which tokens of both kinds end.

How often two ids are linked over the whole corpus is counted exactly in an array of fixed size. Tokens
whose ranges end together have bytes of which the shorter is the end of the longer, so a pair is
named by its longer token and the length of the shorter one; there are no more such names than bytes
in the two vocabularies (about 600,000). So no link is shuffled: tasks add arrays, the executors sum
them, and the sums go back to the tasks that hold the links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Encoder, encoder
from .common import PARTIALS, Scratch, list_array, lists, merged, over_text, partials, texts_of


class Pieces:
    """A sentencepiece model: ids of texts, and the bytes of ids (U+2581 is a space, <0xHH> a byte)."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        names = self.sp.id_to_piece(list(range(n)))
        self.byte = np.array([self.sp.is_byte(i) for i in range(n)])
        self.control = np.array([self.sp.is_control(i) or self.sp.is_unknown(i) for i in range(n)])
        self.bytes = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(names, self.byte)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)


class Pairs:
    """Numbers for the pairs of ids (a, b) whose bytes end alike."""

    def __init__(self, a: list[bytes], b: list[bytes], byte: np.ndarray, control: np.ndarray):
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        self.byte = byte
        plain = {}
        for i, x in enumerate(b):
            if not byte[i] and not control[i] and plain.setdefault(x, i) != i:
                raise ValueError(f"two pieces of the bytes {x!r}")
        names = {x: i for i, x in enumerate(a)}
        if len(names) != len(a):
            raise ValueError("two ids of the same bytes")
        self.first_a = np.concatenate(([0], np.cumsum(self.len_a + 1)))
        self.first_b = self.first_a[-1] + np.concatenate(([0], np.cumsum(self.len_b + 1)))
        self.size = int(self.first_b[-1])
        # The B id of each number, where there is one.
        self.b_of = np.full(self.size, -1, np.int64)
        single = {x: i for i, x in enumerate(b) if byte[i]}
        for i, x in enumerate(a):
            at = self.first_a[i]
            self.b_of[at] = single.get(x[-1:], -1)
            for n in range(1, len(x) + 1):
                self.b_of[at + n] = plain.get(x[len(x) - n :], -1)
        self.b_of[self.first_b[0] :] = np.repeat(np.arange(len(b)), self.len_b + 1)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of ids: the longer one's first number and the shorter one's length (0 for a byte
        piece, which may have the bytes of another piece)."""
        la, lb = self.len_a[a], self.len_b[b]
        return np.where(lb <= la, self.first_a[a] + np.where(self.byte[b], 0, lb), self.first_b[b] + la)


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last B token of the group of each A token and of each B token, of two sequences of tokens that
    tile the same bytes, given where they end."""
    if not len(end_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start_a, start_b = (np.concatenate(([0], e[:-1])) for e in (end_a, end_b))
    n = len(end_a)
    # The last token of the other kind that starts before this one ends reaches as far as any that overlaps.
    to_b = np.searchsorted(start_b, end_a, "left") - 1
    to_a = np.searchsorted(start_a, end_b, "left") - 1
    # Where both end together the B token stands for both.
    after = np.concatenate((n + to_b, np.where(end_a[to_a] > end_b, to_a, n + np.arange(len(end_b)))))
    while True:
        further = after[after]
        if np.array_equal(further, after):
            return after[:n] - n, after[n:] - n
        after = further


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>"
#: Bytes of text that are aligned at once (a longer text is, as one), and tokens that are written out at once.
BLOCK, PART = 1 << 20, 1 << 18


def align(docs: DataFrame, byte_level_file: str, piece_file: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) for every row of docs (doc_id, text, ...).

    A encodes space + text by the byte-level file, with the strings of special tokens as plain text; B
    encodes text by the sentencepiece model, which adds the space. n_a and n_b count tokens, n_groups the
    groups, n_links the pairs of an A and a B token that end together (one for each group). groups_sha256 is of
    `a1,a2|b1;a3|b2,b3`; links has the number (`Pairs.number`) of each link's pair of ids. A text that is
    null, empty, or not what the tokens of A or B spell has no tokens: zeros, '' and no links. Rows
    that repeat stay; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(byte_level_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        held = spark.sparkContext.broadcast((f.read(), g.read()))

    def run(batches):
        a, b = encoder(held.value[0], specials=False), Pieces(held.value[1])
        pairs = Pairs(a.bytes, b.bytes, b.byte, b.control)
        words = [[f"{i}{c}" for i in range(max(len(a.bytes), len(b.bytes)))] for c in ",|;"]
        words = [x for each in zip(*words) for x in each]

        def aligned(ids: list, texts: list) -> pa.RecordBatch:
            raw = [(" " + t).encode() if t else b"" for t in texts]
            two = b.ids([t or "" for t in texts])
            one = [a.ids(a.pieces(" " + t)).astype(np.int64) if t else np.zeros(0, np.int64) for t in texts]
            spelt = [int(pairs.len_a[x].sum()) == len(r) and b"".join(map(b.bytes.__getitem__, y)) == r for x, y, r in zip(one, two, raw)]
            one = [x if s else x[:0] for x, s in zip(one, spelt)]
            two = [np.array(y if s else [], np.int64) for y, s in zip(two, spelt)]
            n_a, n_b = (np.array([len(x) for x in t], np.int64) for t in (one, two))
            ia, ib = np.concatenate(one), np.concatenate(two)
            end_a = np.cumsum(pairs.len_a[ia])
            last_a, last_b = groups(end_a, np.cumsum(pairs.len_b[ib]))
            closing = np.flatnonzero(last_b == np.arange(len(ib)))  # a group's last B token
            partner = np.searchsorted(last_a, closing, "right") - 1  # its last A token
            n_groups = np.diff(np.searchsorted(closing, np.concatenate(([0], np.cumsum(n_b)))))
            # A group's A tokens stand before its B tokens; after each stands what ends it.
            place_a = np.arange(len(ia)) + np.concatenate(([0], closing + 1))[np.searchsorted(closing, last_a)]
            place_b = np.arange(len(ib)) + (partner + 1)[np.searchsorted(closing, last_b)]
            code = np.empty(len(ia) + len(ib), np.int64)
            code[place_a], code[place_b] = ia * 3, ib * 3
            code[place_a[partner]] += 1
            code[place_b[closing]] += 2
            digests, at = [], 0
            for n in (n_a + n_b).tolist():
                h = hashlib.sha256()
                for low in range(at, at + n, PART):
                    text = "".join(map(words.__getitem__, code[low : min(low + PART, at + n)].tolist()))
                    h.update((text[:-1] if low + PART >= at + n else text).encode())
                digests.append(h.hexdigest() if n else "")
                at += n
            numbers = pairs.number(ia[partner], ib[closing]).astype(np.int32)
            links = list_array(np.split(numbers, np.cumsum(n_groups)[:-1]), pa.int32())
            counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_groups)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts, pa.array(digests, pa.string()), links], [c.split()[0] for c in ALIGNED.split(", ")])

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= BLOCK:
                    yield aligned(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield aligned(ids, texts)

    return over_text(texts_of(docs), run, ALIGNED)


def pair_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """How many links of the whole table have each number; tasks' arrays are summed on the executors."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            values, at = lists(batch.column(0))
            total += np.bincount(values[at[0] : at[-1]], minlength=size)
        yield from partials({0: total})

    return merged(aligned.select("links").mapInArrow(count, PARTIALS), size, np.int64).get(0, np.zeros(size, np.int64))


def align_and_count(docs: DataFrame, byte_level_file: str, piece_file: str) -> DataFrame:
    """What `align` has of each row, but for links: n_best, the links whose pair's count is the highest that
    their B id has in the corpus (ties included), and count_sum, the sum of the links' counts."""
    spark = docs.sparkSession
    stored = Scratch(spark, "alignment").put(align(docs, byte_level_file, piece_file), "aligned")
    with open(byte_level_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        a, b = Encoder(f.read(), specials=False, most=1), Pieces(g.read())
    pairs = Pairs(a.bytes, b.bytes, b.byte, b.control)
    counts = pair_counts(stored, pairs.size)
    highest = np.zeros(len(b.bytes), np.int64)
    real = np.flatnonzero((pairs.b_of >= 0) & (counts > 0))
    np.maximum.at(highest, pairs.b_of[real], counts[real])
    best = np.zeros(pairs.size, bool)
    best[real] = counts[real] == highest[pairs.b_of[real]]
    held = spark.sparkContext.broadcast((counts, best))

    def add(batches):
        counts, best = held.value
        for batch in batches:
            values, at = lists(batch.column("links"))
            sums = [np.concatenate(([0], np.cumsum(x[values], dtype=np.int64)))[at] for x in (best, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.diff(s), pa.int64()) for s in sums)], [*batch.schema.names[:-1], "n_best", "count_sum"])

    return stored.mapInArrow(add, ALIGNED.replace(", links array<int>", "") + ", n_best long, count_sum long")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = align_and_count(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
