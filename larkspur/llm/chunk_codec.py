"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes says so, so equal passages are cut alike wherever
they stand. Chunks that occur more than once are encoded once, whoever has them; what stands between
them in a document is encoded there. An encoding of a chunk on its own is wrong only near its ends.
Joining a document's pieces, the text around each join is encoded again, a growing stretch at a time,
until the pre-tokens of the running text and those of the chunk alone end at the same place; from
there on the chunk's own tokens hold. How far a pre-token's end can depend on the text after it is
bounded (`Encoder.reach`), so the agreement is exact and not a guess.

A document without shared chunks is finished in the task that reads it. Of the others, the pieces are
shuffled once: the texts between as they are, of shared chunks a 128-bit name, which is joined with the
encodings. A Bloom filter of fixed size tells which names are shared; a false hit only sends a chunk the
longer way. Beyond its room (some 8 million shared chunks for each 16 MB; `filter_bits`) more chunks go
that way, at most all: one shuffle of the text and one of its tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder
from .common import Scratch, bits_of, log2_bits, longs, over_text, powers, prefix_sums, runs, texts_of, utf8

#: Bytes that decide on a cut; a chunk of about 2^LOG2 bytes is expected, and none is longer than MOST
#: (and the rest of a character).
WINDOW, LOG2, MOST = 32, 9, 1 << 13


def cuts(buf: np.ndarray, window: int = WINDOW, log2: int = LOG2) -> np.ndarray:
    """Places where a chunk may start: at a character whose `window` bytes before hash to zeros."""
    if len(buf) <= window:
        return np.zeros(0, np.int64)
    s = prefix_sums(buf)
    h = (s[window:-1] - s[: -window - 1]) * powers(len(s))[1][: len(buf) - window] * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero((h >> np.uint64(64 - log2)) == 0) + window
    return at[(buf[at] & 0xC0) != 0x80]


def edges(at: np.ndarray, buf: np.ndarray, start: int, end: int, window: int, most: int) -> list[int]:
    """Edges of the chunks of the text buf[start:end], of the places at its cuts."""
    inner = at[np.searchsorted(at, start + window) : np.searchsorted(at, end)].tolist()
    out = [start]
    for to in [*inner, end]:
        while to - out[-1] > most:
            cut = out[-1] + most
            while cut < to and buf[cut] & 0xC0 == 0x80:
                cut += 1
            if cut == to:
                break
            out.append(cut)
        if to > out[-1]:
            out.append(to)
    return out


def chunked(batches, window: int, log2: int, most: int) -> Iterator[tuple]:
    """(batch, row, bytes of the text, edges, names as an array of two longs for each chunk) of all texts."""
    for batch in batches:
        data, starts, ends = utf8(batch.column("text"))
        for i, j in runs(starts, ends):
            low = int(starts[i])
            buf = data[low : int(ends[j - 1])]
            at = cuts(buf, window, log2)
            for row in range(i, j):
                a, b = int(starts[row]) - low, int(ends[row]) - low
                e = edges(at, buf, a, b, window, most)
                raw = buf[a:b].tobytes()
                names = b"".join([hashlib.blake2b(raw[x - a : y - a], digest_size=16).digest() for x, y in zip(e, e[1:])])
                yield batch, row, raw, [x - a for x in e], np.frombuffer(names, np.int64).reshape(-1, 2)


def shared_chunks(docs: DataFrame, window: int = WINDOW, log2: int = LOG2, most: int = MOST) -> DataFrame:
    """(a, b): names of the chunks that occur more than once in docs (doc_id, text)."""

    def names(batches):
        held: list[np.ndarray] = []
        for _, _, _, _, n in chunked(batches, window, log2, most):
            held.append(n)
            if len(held) >= 2000:
                x, held = np.concatenate(held), []
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])
        if held:
            x = np.concatenate(held)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    found = over_text(texts_of(docs), names, "a long, b long")
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")


PIECES = "kind int, row long, pos int, doc_id long, a long, b long, text string, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Digest:
    """Token ids and decoded text of one document, taken in stretches."""

    def __init__(self, coder: Encoder):
        self.coder, self.n, self.ids, self.text = coder, 0, hashlib.sha256(), hashlib.sha256()

    def take(self, ids: np.ndarray) -> None:
        if len(ids):
            self.ids.update((b"," if self.n else b"") + ",".join(map(str, ids.tolist())).encode())
            self.text.update(self.coder.decoded(ids).decode(errors="replace").encode())
            self.n += len(ids)

    def values(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


class Joined(Digest):
    """A document from pieces. `open` is the end of the text so far, from a pre-token's start on, which
    what follows may still change."""

    def __init__(self, coder: Encoder):
        super().__init__(coder)
        self.open = ""

    def add_text(self, text: str) -> None:
        text = self.open + text
        pieces = self.coder.pieces(text)
        ends = np.cumsum([len(p) for p in pieces])
        k = int(np.searchsorted(ends, len(text) - self.coder.reach, "right"))
        self.take(self.coder.ids(pieces[:k]))
        self.open = text[ends[k - 1] :] if k else text

    def add_encoded(self, ids: np.ndarray, tail: int) -> None:
        """A chunk's own ids; the last `tail` of them may depend on what follows it."""
        coder, before = self.coder, len(self.open)
        each = [coder.bytes[i] for i in ids.tolist()]
        text, look = b"".join(each).decode(), 64
        while True:
            head = text[:look]
            own = np.cumsum([0, *map(len, coder.pieces(head))])
            pieces = coder.pieces(self.open + head)
            ends = np.cumsum([0, *map(len, pieces)])
            same = np.intersect1d(own, ends - before)
            same = same[same <= len(head) - coder.reach]
            if len(same):
                break
            if look >= len(text):
                return self.add_text(text)
            look *= 2
        at = int(same[0])
        self.take(coder.ids(pieces[: int(np.searchsorted(ends, before + at))]))
        sizes = np.cumsum([0, *map(len, each)])
        first, last = int(np.searchsorted(sizes, len(text[:at].encode()))), len(ids) - tail
        self.take(ids[first:last])
        self.open = b"".join(each[max(first, last) :]).decode()

    def values(self) -> tuple[int, str, str]:
        self.take(self.coder.ids(self.coder.pieces(self.open)))
        self.open = ""
        return super().values()


def encode_decode(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, log2: int = LOG2, most: int = MOST, filter_bits: int = 27) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs (doc_id, text, ...).

    The ids are the library's for the whole text without begin, end, padding or truncation; strings of
    added special tokens are one token. ids_sha256 is of the decimal ids joined by commas,
    decoded_sha256 of the text that the ids decode to. Null is empty: no tokens, digests of nothing. Rows
    that repeat stay; other columns are ignored; a tokenizer of another kind is a ValueError.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "codec")
    with open(tokenizer_file, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    Encoder(source.value, most=1)  # an error here rather than in a task
    shared = scratch.put(shared_chunks(docs, window, log2, most), "shared")
    known = spark.sparkContext.broadcast(bits_of(shared, log2_bits(shared.count(), most=filter_bits), columns=("a",)))

    def split(batches):
        coder, bits = encoder(source.value), known.value
        row, sent = TaskContext.get().partitionId() << 33, set()
        out: list[tuple] = []
        for batch, at, raw, e, names in chunked(batches, window, log2, most):
            doc_id, hit = batch.column("doc_id")[at].as_py(), bits.has(names[:, 0].copy())
            row += 1
            if not hit.any():
                d = Digest(coder)
                d.take(coder.ids(coder.pieces(raw.decode())))
                out.append((0, None, None, doc_id, None, None, None, *d.values()))
            else:
                start = 0
                for k, (x, y) in enumerate(zip(e, e[1:])):
                    if hit[k]:
                        a, b = names[k].tolist()
                        if start < x:
                            out.append((1, row, 2 * k, doc_id, None, None, raw[start:x].decode(), None, None, None))
                        out.append((2, row, 2 * k + 1, doc_id, a, b, None, None, None, None))
                        if (a, b) not in sent:  # at most one for each chunk of the task's input
                            sent.add((a, b))
                            out.append((3, None, None, None, a, b, raw[x:y].decode(), None, None, None))
                        start = y
                if start < len(raw):
                    out.append((1, row, 2 * len(e), doc_id, None, None, raw[start:].decode(), None, None, None))
            if len(out) >= 1000:
                yield from _rows(out, PIECES)
                out = []
        yield from _rows(out, PIECES)

    def encode(batches):
        coder = encoder(source.value)
        for batch in batches:
            ids, tails = [], []
            for text in batch.column("text").to_pylist():
                pieces = coder.pieces(text)
                ends = np.cumsum([len(p) for p in pieces])
                k = int(np.searchsorted(ends, len(text) - coder.reach, "right"))
                ids.append(coder.ids(pieces).tobytes())
                tails.append(len(coder.ids(pieces[k:])))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ids, pa.binary()), pa.array(tails, pa.int32())], ["a", "b", "ids", "tail"])

    def join(batches):
        coder, now, doc_id, d = encoder(source.value), None, None, None
        for batch in batches:
            out = []
            for row, i, text, ids, tail in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text", "ids", "tail"))):
                if row != now:
                    if d is not None:
                        out.append((doc_id, *d.values()))
                    now, doc_id, d = row, i, Joined(coder)
                if text is not None:
                    d.add_text(text)
                else:
                    d.add_encoded(np.frombuffer(ids, coder.kind), tail)
            yield from _rows(out, RESULT)
        if d is not None:
            yield from _rows([(doc_id, *d.values())], RESULT)

    pieces = scratch.put(over_text(texts_of(docs), split, PIECES), "pieces", compression="zstd")
    once = pieces.where("kind = 3").groupBy("a", "b").agg(F.first("text").alias("text")).mapInArrow(encode, "a long, b long, ids binary, tail int")
    coded = pieces.where("kind = 2").select("row", "pos", "doc_id", "a", "b").join(once, ["a", "b"])
    between = pieces.where("kind = 1").select("row", "pos", "doc_id", "text", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("int").alias("tail"))
    ordered = between.unionByName(coded.select("row", "pos", "doc_id", F.lit(None).cast("string").alias("text"), "ids", "tail")).repartition("row").sortWithinPartitions("row", "pos")
    done = pieces.where("kind = 0").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return done.unionByName(ordered.mapInArrow(join, RESULT))


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _rows(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    if rows:
        names, kinds = zip(*(c.split() for c in schema.split(", ")))
        yield pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*rows), kinds)], list(names))


def op13_chunk_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
