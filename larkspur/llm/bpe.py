"""Byte-level BPE in tasks: pre-tokens, their ids (remembered), the bytes of ids."""

from __future__ import annotations

import json

import numpy as np

from .token_counts import PATTERN, _specials, byte_letters


class Memo(dict):
    """Ids of a pre-token as bytes; what is missing is merged and, if short, kept until `most` are."""

    def __init__(self, source: str, kind: np.dtype, fixed: dict[str, bytes], most: int):
        from tokenizers import Tokenizer

        super().__init__(fixed)
        self.model, self.letters, self.kind, self.fixed, self.most = Tokenizer.from_str(source).model, byte_letters(), kind, fixed, most

    def __missing__(self, piece: str) -> bytes:
        letters = self.letters
        ids = np.array([t.id for t in self.model.tokenize("".join([letters[b] for b in piece.encode()]))], self.kind).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
                self.update(self.fixed)
            self[piece] = ids
        return ids


class Encoder:
    """Encodes as the library does for the file: without begin or end, and with the strings of added
    special tokens as one id each (specials=False: as plain text)."""

    def __init__(self, source: str, specials: bool = True, most: int = 400_000):
        import regex

        config = json.loads(source)
        strings = _specials(config)
        self.bytes = token_bytes(config)
        self.kind = np.dtype(np.uint16 if len(self.bytes) <= 1 << 16 else np.uint32)
        added = {t["content"]: np.array([t["id"]], self.kind).tobytes() for t in config["added_tokens"]} if specials else {}
        self.memo = Memo(source, self.kind, added, most)
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")").split if added else None
        #: A decision on where a pre-token ends reads at most this many characters beyond it.
        self.reach = max([0, *map(len, strings)]) + 3

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text, in order; together they are the text."""
        if self.cut is None:
            return self.find(text)
        parts = self.cut(text)
        if len(parts) == 1:
            return self.find(text)
        out: list[str] = []
        for k, part in enumerate(parts):
            out += [part] if k % 2 else self.find(part)
        return out

    def ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, pieces)), self.kind)

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_HELD: dict = {}


def encoder(source: str, specials: bool = True) -> Encoder:
    """The worker's encoder of a file, which goes on to its next tasks with what it remembers."""
    key = (hash(source), specials)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(source, specials)
    return _HELD[key]


def token_bytes(config: dict) -> list[bytes]:
    """The bytes that each id stands for, those of added tokens included."""
    back = {c: b for b, c in enumerate(byte_letters())}
    vocab = config["model"]["vocab"]
    out = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in config["added_tokens"])]))
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    for t in config["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out
