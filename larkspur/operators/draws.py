"""Seeded draws past what a user holds, in one pass over rows that are sorted by user.

A user's held items come first and stay with the task, the user's asks stream past them; so draws are neither
shuffled nor stored, only their results. A user of very many asks is dealt into several blocks, each with all
that the user holds. Items are whole numbers here, held once in order by each worker: a place is an index of
that array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, shipped

PRIME = (1 << 31) - 1
#: Items that the driver and each worker hold, at most; asks of a user in one block, about.
MOST_ITEMS, ASKS = 20_000_000, 20_000
#: Asks looked at together.
AT_ONCE = 8192


def items_in_order(distinct: DataFrame, item: str, most: int | None = None) -> np.ndarray | None:
    """The items in order, if they are whole numbers without null and not too many."""
    if distinct.schema[item].dataType.typeName() not in ("byte", "short", "integer", "long") or distinct.count() > (MOST_ITEMS if most is None else most):
        return None
    got = distinct.select(item).toArrow().column(item)
    return None if got.null_count else np.sort(got.to_numpy().astype(np.int64))


def with_codes(items: np.ndarray, coded: DataFrame, item: str, code: str) -> np.ndarray:
    """The codes of the items in their order, from a table (item, code) of them."""
    got = coded.select(item, code).toArrow()
    out = np.zeros(len(items), np.int32)
    out[np.searchsorted(items, got.column(item).to_numpy().astype(np.int64))] = got.column(code).to_numpy()
    return out


def by_user(asks: DataFrame, held: DataFrame, user: str, order: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """Held items (user, _item) and asks (user, other columns) as one table, by user: held ones first (_kind 0) in order,
    then asks in the order of the named columns."""
    none = lambda t, c: F.lit(None).cast(t.schema[c].dataType).alias(c)
    rest = [c for c in asks.columns if c != user]
    h = held.where(F.col(user).isNotNull()).select(user, F.lit(0).alias("_kind"), "_item", *[none(asks, c) for c in rest])
    a = asks.select(user, F.lit(1).alias("_kind"), none(held, "_item"), *rest)
    busy = scratch.put(asks.groupBy(F.col(user).alias("_busy")).agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKS)).cast("int").alias("_blocks")).where("_blocks > 1 AND _busy IS NOT NULL"), "busy")
    keys = [user]
    if not busy.isEmpty():
        keys = [user, "_block"]
        dealt = lambda t, block: t.join(busy, F.col(user) == F.col("_busy"), "left").withColumn("_block", block).drop("_busy", "_blocks")
        h = dealt(h, F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
        a = dealt(a, F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_blocks")).cast("int"), F.lit(0)))
    return h.unionByName(a).repartition(*keys).sortWithinPartitions(*keys, "_kind", "_item", *order)


class Holder:
    """Walks batches of by_user's rows; keeps the places that the last user holds."""

    def __init__(self, user: str, items: np.ndarray):
        self.user, self.items, self.now, self.held = user, items, None, np.zeros(0, np.int64)

    def asks(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of the asks, the number of each one's user in the batch, sorted keys of user and held place)."""
        n = len(batch)
        codes = batch.column(self.user).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if "_block" in batch.schema.names:
            codes = codes * 1_000_003 + batch.column("_block").to_numpy()
        mark = lambda i: (batch.column(self.user)[i].as_py(), batch.column("_block")[i].as_py() if "_block" in batch.schema.names else 0)
        number = np.cumsum(np.concatenate(([0], codes[1:] != codes[:-1])))
        kind = batch.column("_kind").to_numpy()
        has = np.flatnonzero(kind == 0)
        place = np.searchsorted(self.items, batch.column("_item").take(pa.array(has)).to_numpy(zero_copy_only=False).astype(np.int64))
        before = self.held if self.now == mark(0) else np.zeros(0, np.int64)
        wide = len(self.items) + 1
        keys = np.concatenate((before, number[has] * wide + place))
        last = keys[np.searchsorted(keys, number[-1] * wide) :] - number[-1] * wide
        self.now, self.held = mark(n - 1), last
        return np.flatnonzero(kind == 1), number, keys


def look(seeds: np.ndarray, tries: int, size: int, pool: np.ndarray | None, number: np.ndarray, keys: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether new and not held) of the first draws of each row, by the sequence of `sampling.nth_place`;
    pool: places that the draws are indexes of."""
    t = np.arange(1, tries + 1, dtype=np.int64)
    a, b, c = (seeds[:, i : i + 1] for i in range(3))
    place = ((a * t + b) % PRIME * t + c) % PRIME * size // PRIME
    place = place if pool is None else pool[place]
    key = number[:, None] * wide + place
    at = np.searchsorted(keys, key)
    free = keys[np.minimum(at, len(keys) - 1)] != key if len(keys) else np.ones(key.shape, bool)
    order = np.argsort(place, axis=1, kind="stable")
    again = np.zeros(place.shape, bool)
    inorder = np.take_along_axis(place, order, 1)
    np.put_along_axis(again, order[:, 1:], inorder[:, 1:] == inorder[:, :-1], 1)
    return place, free & ~again


def first_free(seeds: np.ndarray, n: int, most: int, size: int, pool: np.ndarray | None, number: np.ndarray, keys: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, enough): the first n of each row's draws that are new and not held; a row whose `most` draws have fewer is
    not enough, and its places mean nothing. Later draws are looked at only where the first ones come out short."""
    out, enough = np.zeros((len(seeds), n), np.int64), np.zeros(len(seeds), bool)
    if not size:
        return out, enough
    left = np.arange(len(seeds))
    for tries in (min(most, n + 4 + n // 2), most):
        if not len(left):
            break
        place, good = look(seeds[left], tries, size, pool, number[left], keys, wide)
        nth = np.cumsum(good, axis=1)
        done = nth[:, -1] >= n
        i, j = np.nonzero(good & (nth <= n) & done[:, None])
        out[left[done]] = place[i, j].reshape(-1, n)
        enough[left[done]] = True
        left = left[~done]
    return out, enough


def as_seeds(column: pa.Array) -> np.ndarray:
    return np.stack([column.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "c")], axis=1).astype(np.int64)


def seeds_of(text: str) -> list[int]:
    """sampling.seeds of a text that holds the seed already."""
    h = hashlib.md5(text.encode()).hexdigest()
    return [int(h[at : at + 8], 16) % PRIME for at in (0, 8, 16)]


def lists_past(rows: DataFrame, group: str, user: str, item: str, items: np.ndarray, popular: np.ndarray, num_neg: int, num_popular: int, looks: tuple[int, int]) -> DataFrame:
    """by_user's rows, with seeds _s1 and _s2 → (group, user, item, negatives): none where draws come out short."""
    spark = rows.sparkSession
    shipped(spark)
    held = spark.sparkContext.broadcast((items, popular))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, popular = held.value
        holder, wide = Holder(user, items), len(items) + 1
        for batch in batches:
            if not len(batch):
                continue
            every, number, keys = holder.asks(batch)
            for low in range(0, len(every), AT_ONCE):
                at = every[low : low + AT_ONCE]
                part = batch.take(pa.array(at))
                a, enough = first_free(as_seeds(part.column("_s1")), num_popular, looks[0], len(popular), popular, number[at], keys, wide)
                b, more = first_free(as_seeds(part.column("_s2")), num_neg, looks[1], len(items), None, number[at], keys, wide)
                fresh = ~(b[:, :, None] == a[:, None, :]).any(axis=2)
                take = fresh & (np.cumsum(fresh, axis=1) <= num_neg - num_popular)
                enough &= more
                take &= enough[:, None]
                rest = np.zeros((len(at), num_neg - num_popular), np.int64)
                rest[enough] = b[take].reshape(-1, num_neg - num_popular)
                found = items[np.concatenate((a, rest), axis=1)]
                ends = pa.array(np.concatenate(([0], np.cumsum(np.where(enough, num_neg, 0)))), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(found[enough].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(group), part.column(user), part.column(item), lists], [group, user, item, "negatives"])

    kind = lambda c: f"`{c}` {rows.schema[c].dataType.simpleString()}"
    return rows.mapInArrow(run, ", ".join([kind(group), kind(user), kind(item), "negatives array<bigint>"]))


def negatives_past(rows: DataFrame, user: str, carry: list[str], items: np.ndarray, codes: np.ndarray, k: int, looks: tuple[int, int], seed: int) -> DataFrame:
    """by_user's rows in the order of _same, with _base (text of the key) and _s1 (seeds of the first of equal rows) → (user,
    *carry, _name, _items, _codes): k items of each ask with their codes; none, and its name, where draws come out
    short. Asks of equal _same are numbered, and each has draws of its own."""
    spark = rows.sparkSession
    shipped(spark)
    held = spark.sparkContext.broadcast((items, codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, codes = held.value
        holder, wide, last, count = Holder(user, items), len(items) + 1, None, 0
        for batch in batches:
            if not len(batch):
                continue
            every, number, keys = holder.asks(batch)
            if not len(every):
                last = None
                continue
            same = batch.column("_same").take(pa.array(every)).to_numpy()
            new = np.concatenate(([True], (same[1:] != same[:-1]) | (number[every][1:] != number[every][:-1])))
            nth = np.arange(len(every)) - np.flatnonzero(new)[np.cumsum(new) - 1] + 1
            mark = lambda i: (batch.column(user)[int(i)].as_py(), batch.column("_same")[int(i)].as_py())  # noqa: E731, B023
            if last == mark(every[0]):
                nth[: np.flatnonzero(new)[1] if new.sum() > 1 else len(nth)] += count
            last, count = mark(every[-1]), int(nth[-1])
            for low in range(0, len(every), AT_ONCE):
                at, n = every[low : low + AT_ONCE], nth[low : low + AT_ONCE]
                part = batch.take(pa.array(at))
                seeds = as_seeds(part.column("_s1"))
                for i in np.flatnonzero(n > 1):
                    seeds[i] = seeds_of(f"{seed}:{part.column('_base')[int(i)].as_py()}:{n[i]}")
                place, enough = np.zeros((len(at), k), np.int64), np.zeros(len(at), bool)
                left = np.arange(len(at))
                for tries in looks:
                    place[left], enough[left] = first_free(seeds[left], k, tries, len(items), None, number[at[left]], keys, wide)
                    left = left[~enough[left]]
                    if not len(left):
                        break
                names = [None if e else f"{part.column('_base')[i].as_py()}:{n[i]}" for i, e in enumerate(enough)] if len(left) else [None] * len(at)
                ends = pa.array(np.concatenate(([0], np.cumsum(np.where(enough, k, 0)))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[place[enough].ravel()], kind)) for x, kind in ((items, pa.int64()), (codes, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(user), *(part.column(c) for c in carry), pa.array(names, pa.string()), *lists], [user, *carry, "_name", "_items", "_codes"])

    kind = lambda c: f"`{c}` {rows.schema[c].dataType.simpleString()}"
    return rows.mapInArrow(run, ", ".join([*(kind(c) for c in (user, *carry)), "_name string", "_items array<bigint>", "_codes array<int>"]))
