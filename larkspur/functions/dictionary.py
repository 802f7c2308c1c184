"""Dictionaries of many words, matched in one pass over each text whatever their number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..scratch import shipped


def matcher(words: list[str]) -> Callable[[str], Iterator[int]]:
    """A function from a text to the numbers of the words that occur in it as parts, each perhaps more than once: an
    Aho-Corasick automaton where that library is installed, else look-ups of all parts of the words' lengths."""
    number: dict[str, int] = {}
    for k, w in enumerate(words):
        number.setdefault(w, k)
    blank = number.pop("", None)
    always = [] if blank is None else [blank]
    try:
        import ahocorasick
    except ImportError:
        lengths = sorted({len(w) for w in number})

        def by_parts(text: str) -> Iterator[int]:
            yield from always
            for n in lengths:
                for i in range(len(text) - n + 1):
                    k = number.get(text[i : i + n])
                    if k is not None:
                        yield k

        return by_parts
    automaton = ahocorasick.Automaton()
    for w, k in number.items():
        automaton.add_word(w, k)
    automaton.make_automaton()

    def by_automaton(text: str) -> Iterator[int]:
        yield from always
        if number:
            for _, k in automaton.iter(text):
                yield k

    return by_automaton


def _over(c: Column, words, kind: str, of: Callable) -> Column:
    """of(matches of a text) for each text; the automaton is made once in each worker."""
    shipped()
    held = SparkSession.getActiveSession().sparkContext.broadcast(list(words))

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = matcher(held.value)
        for s in batches:
            yield pd.Series([None if t is None else of(found(t)) for t in s], dtype=object)

    return run(c)


def contains(c: Column, words) -> Column:
    """Whether one of the words is part of the text; null for null."""
    return _over(c, words, "boolean", lambda found: next(found, None) is not None)


def matches(c: Column, words) -> Column:
    """The places (from 0) in `words` of those that are parts of the text, ascending; of equal words the first."""
    return _over(c, words, "array<int>", lambda found: sorted(set(found)))
