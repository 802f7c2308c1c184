"""Token counts with the whole-token shortcut.

Offline, each vocabulary string is run through the merges once; those that come out as one token are
the proven whole tokens. A text is cut into pre-tokens; proven ones count as one, only the others are
merged (and remembered, up to a bound, within a task).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_text, texts_of, workers_find_package

#: The pre-token pattern of byte-level BPE, as the library's ByteLevel step has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable ones as they are, the
    others moved behind 255 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Counter(dict):
    """Tokens of a pre-token; what is missing is merged and kept, until `most` are."""

    def __init__(self, source: str, whole: list[str], most: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.most = whole, most
        self.model, self.letters = Tokenizer.from_str(source).model, byte_letters()

    def __missing__(self, piece: str) -> int:
        letters = self.letters
        n = len(self.model.tokenize("".join([letters[b] for b in piece.encode()])))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


def proven(source: str) -> list[str]:
    """The vocabulary strings that are one token when they stand alone, as text."""
    from tokenizers import Tokenizer

    model, back = Tokenizer.from_str(source).model, {c: b for b, c in enumerate(byte_letters())}
    out = []
    for token in json.loads(source)["model"]["vocab"]:
        if len(model.tokenize(token)) == 1:
            try:
                out.append(bytes(back[c] for c in token).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    return out


def _specials(config: dict) -> list[str]:
    for t in config["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError("added tokens with white-space or word rules are not supported")
    pre, model = config["pre_tokenizer"] or {}, config["model"]
    if config["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type", "BPE") != "BPE" or model.get("dropout"):
        raise ValueError("a byte-level BPE file without normalizer, prefix space and dropout is needed")
    return sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text, ...).

    The numbers are the library's for the whole text: no begin, end or padding, no truncation; strings
    of added special tokens inside a text are one token each. Null is empty (0 tokens). Rows that
    repeat stay; other columns are ignored. A tokenizer of another kind is a ValueError.
    """
    workers_find_package(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        source = f.read()
    specials = _specials(json.loads(source))
    held = docs.sparkSession.sparkContext.broadcast((source, proven(source)))

    def run(batches):
        import regex

        counter = Counter(*held.value)
        pieces, get = regex.compile(PATTERN).findall, counter.__getitem__
        cut = regex.compile("|".join(map(regex.escape, specials))).split if specials else lambda t: [t]
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                parts = cut(text or "")
                n_bytes.append(len((text or "").encode()))
                n_tokens.append(len(parts) - 1 + sum(sum(map(get, pieces(p))) for p in parts if p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return over_text(texts_of(docs), run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
