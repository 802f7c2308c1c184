"""Splits, windows and seeded samples. Draws are hashes of a seed and keys, never rand(), so results
don't depend on partitions. Positions over a whole table are numbered without one big task: counts
per range partition first, then row numbers within."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import draws


def shuffled(seed: int, *keys) -> Column:
    """A sort key in seeded order that any engine can repeat: the md5 of seed and keys, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]))


def uniform(seed: int, *keys) -> Column:
    """A number in (0, 1) from the first 52 bits of shuffled()."""
    return (F.conv(F.substring(shuffled(seed, *keys), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


#: A prime; sequences of draws are polynomials modulo it.
PRIME = draws.PRIME


def seeds(seed: int, *keys) -> Column:
    """Three numbers below PRIME (a struct) from shuffled(), the start of a sequence of draws."""
    h = shuffled(seed, *keys)
    return F.struct(*[(F.conv(F.substring(h, at, 8), 16, 10).cast("long") % PRIME).alias(c) for c, at in (("a", 1), ("b", 9), ("c", 17))])


def nth_place(s: Column, nth: Column, n: Column) -> Column:
    """The nth draw from 1..n by seeds(): a quadratic in nth modulo PRIME, so any three draws are independent and
    cost no hash. Reaches all of 1..n up to n = PRIME."""
    y = ((s["a"] * nth + s["b"]) % PRIME * nth + s["c"]) % PRIME
    return F.call_function("div", y * n, F.lit(PRIME)) + 1


def numbered(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Adds the row's position from 1 in the order, which must be total up to rows that are equal.

    Rows are range-partitioned by the order and sorted within, once, into a stored table that holds each
    row's partition and place; a partition's offset is the number of rows before it, from a table with a
    row for each partition. All is read from the stored table, so no second plan can deal them otherwise."""
    place = F.monotonically_increasing_id()
    stored = Scratch(df.sparkSession, "numbered").put(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", place), "rows")
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = stored.groupBy(part.alias("_part")).agg((F.max(local) + 1).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return stored.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, local + 1 + F.col("_before")).drop("_part", "_id", "_before")


def cumulated(df: DataFrame, value: str, *order: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows up to this one in a total order: sums within range partitions,
    and of the partitions before."""
    stored = Scratch(df.sparkSession, "cumulated").put(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "rows")
    sizes = stored.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    local = F.sum(value).over(Window.partitionBy("_part").orderBy(*order))
    return stored.withColumn("_sum", local).join(F.broadcast(before), "_part").withColumn(name, F.col("_sum") + F.col("_before")).drop("_part", "_sum", "_before")


def cumulated_within(df: DataFrame, by: tuple[str, ...], value: Column, *order: Column, name: str, total: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the same `by` up to this one, in an order that is total within it, and
    the sum over all of them.

    Rows are range-partitioned by group and order, so a group that holds most of the rows lies in many
    partitions; each sums its own stretch and adds what the stretches before it hold, from a table with a row
    for each group and partition."""
    keys = [F.col(c) for c in by]
    stored = Scratch(df.sparkSession, "cumulated").put(df.withColumn("_v", value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "rows")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = stored.groupBy(*by, "_part").agg(F.sum("_v").alias("_n"))
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_p"), (F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias(total))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    local = F.sum("_v").over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = stored.withColumn("_sum", local).join(sums, same)
    return out.withColumn(name, F.col("_sum") + F.col("_before")).drop("_v", "_part", "_sum", "_before", "_p", *[f"_by_{c}" for c in by])


def numbered_within(df: DataFrame, by: tuple[str, ...], *order: Column, name: str = "pos", total: str = "n") -> DataFrame:
    """Adds the row's position from 1 within its group, and the group's size; a large group is many tasks."""
    return cumulated_within(df, by, F.lit(1).cast("long"), *order, name=name, total=total)


def time_split(df: DataFrame, ts: str, train_end: str, valid_end: str, group: str | None = None) -> DataFrame:
    """Adds split: before train_end train, before valid_end valid, else test; no time is train. With a
    group, its latest time decides for all of its rows."""
    t = F.col(ts) if group is None else F.max(ts).over(Window.partitionBy(group))
    cut = lambda s: F.lit(s).cast("timestamp")
    return df.withColumn("split", F.when(t.isNull() | (t < cut(train_end)), "train").when(t < cut(valid_end), "valid").otherwise("test"))


def holdout_split(df: DataFrame, ratio: float, ts: str | None, key: str, seed: int = 42) -> DataFrame:
    """Adds split: the last share of rows by time (rows without a time last), or by seeded hash, is test."""
    order = [F.col(ts).asc_nulls_last(), F.col(key)] if ts else [shuffled(seed, key), F.col(key)]
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    d = numbered(df, *order).crossJoin(F.broadcast(n))
    return d.withColumn("split", F.when(F.col("pos") > F.col("_n") - F.floor(F.col("_n") * F.lit(ratio)), "test").otherwise("train")).drop("pos", "_n")


def entity_split(df: DataFrame, entity: str, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """(entity, n, split): entities in order of their number of rows, by position (i + 0.5) / n; so the
    smallest are in train and the largest in test, as the plain rule has it."""
    n = numbered(df.groupBy(entity).agg(F.count(F.lit(1)).alias("n")), F.col("n"), F.col(entity), name="_pos")
    n = n.crossJoin(F.broadcast(n.agg(F.count(F.lit(1)).alias("_all"))))
    n = n.select(entity, "n", ((F.col("_pos") - 0.5) / F.col("_all")).alias("_r"))
    return n.withColumn("split", F.when(F.col("_r") < train, "train").when(F.col("_r") < train + valid, "val").otherwise("test")).drop("_r")


def review_windows(df: DataFrame, configs=((30, 15), (50, 25), (20, 10)), entity: str = "source", ts: str = "ts", key: str = "doc_id", whole: bool = True) -> DataFrame:
    """(entity, window_size, stride, start, reviews): every window of W rows with stride S, by time then key.

    Each row joins only the windows that hold it (positions by arithmetic, at most ceil(W / S) of them). Rows are
    numbered over all tasks, whatever one entity holds; only with `whole` is an entity one value."""
    pos = numbered_within(df.select(entity, key, ts), (entity,), F.col(ts).asc_nulls_last(), F.col(key), name="p").where("n >= 2").select(entity, key, (F.col("p") - 1).alias("p"), "n")
    conf = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(s).alias("s")) for w, s in configs]))
    rows = pos.withColumn("c", conf).where("c.w <= n").select("*", "c.w", "c.s")
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - F.col("w") + 1) / F.col("s"))).cast("long")
    last = F.least(F.floor(F.col("p") / F.col("s")), F.floor((F.col("n") - F.col("w")) / F.col("s"))).cast("long")
    held = rows.where(first <= last).select(entity, key, "p", "w", "s", F.explode(F.sequence(first, last)).alias("k"))
    out = held.groupBy(entity, F.col("w").alias("window_size"), F.col("s").alias("stride"), (F.col("k") * F.col("s")).alias("start")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", key))), lambda x: x[key]).alias("reviews"))
    if whole:
        full = pos.groupBy(entity).agg(F.first("n").cast("int").alias("window_size"), F.transform(F.sort_array(F.collect_list(F.struct("p", key))), lambda x: x[key]).alias("reviews"))
        out = out.unionByName(full.select(entity, "window_size", F.lit(None).cast("int").alias("stride"), F.lit(0).cast("long").alias("start"), "reviews"))
    return out


def cap_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def trim_rows(df: DataFrame, group: str, key: str, total: int) -> DataFrame:
    """At most `total` rows, at most max(1, total // min(50, groups)) of a group, in order of group and key."""
    groups = df.agg(F.count_distinct(group).alias("_g"))
    cap = F.greatest(F.lit(1), F.floor(F.lit(total) / F.least(F.lit(50), F.greatest(F.lit(1), F.col("_g")))))
    d = df.crossJoin(F.broadcast(groups)).withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_rn") <= cap)
    return d.orderBy(group, key).limit(total).drop("_rn", "_g")


def assign_round_robin(df: DataFrame, key: str, n: int, cap: int | None = None) -> DataFrame:
    """Adds grp 1..n by position; rows beyond n * cap go to group 1."""
    d = numbered(df, F.col(key))
    g = F.pmod(F.col("pos") - 1, F.lit(n)) + 1
    return d.withColumn("grp", g if cap is None else F.when(F.col("pos") > n * cap, 1).otherwise(g)).drop("pos")


def assign_targets(df: DataFrame, key: str, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Adds grp from targets (grp, cnt): rows in seeded order fill the groups in order; the rest go to the first."""
    d = numbered(df, shuffled(seed, key), F.col(key))
    hi = cumulated(targets.where("cnt > 0"), "cnt", F.col("grp"), name="_hi")
    first = targets.agg(F.min("grp").alias("_first"))
    # Both sides are cut into stretches of positions, so a row meets the few groups of its stretch only.
    wide = 1024
    ranges = hi.select("grp", "_hi", (F.col("_hi") - F.col("cnt")).alias("_lo")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / wide), F.floor((F.col("_hi") - 1) / wide))))
    d = d.withColumn("_b", F.floor((F.col("pos") - 1) / wide))
    out = d.join(ranges, (d["_b"] == ranges["_b"]) & (F.col("pos") > F.col("_lo")) & (F.col("pos") <= F.col("_hi")), "left").drop("_b").crossJoin(F.broadcast(first))
    return out.withColumn("grp", F.coalesce("grp", "_first")).drop("_lo", "_hi", "_first", "pos")


def power_law_targets(groups: DataFrame, total: int, lo: int, hi: int, hot: dict[int, int], alpha: float, seed: int = 42) -> DataFrame:
    """(grp, cnt): hot groups as given, the others lo + (hi - lo) * u^alpha, scaled to what is left of total."""
    given = F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]) if hot else F.create_map().cast("map<int,int>")
    raw = groups.select(F.col("grp"), F.try_element_at(given, F.col("grp")).alias("h"), (lo + (hi - lo) * F.pow(uniform(seed, "grp"), F.lit(alpha))).alias("r"))
    rest, left = F.col("_rest"), max(0, total - sum(hot.values()))
    raw = raw.crossJoin(F.broadcast(raw.agg(F.sum(F.when(F.col("h").isNull(), F.col("r"))).alias("_rest"))))  # one row
    return raw.select("grp", F.coalesce("h", F.greatest(F.lit(1), F.floor(F.col("r") * left / rest))).cast("long").alias("cnt"))


def default_groups(n: Column) -> Column:
    """1 group up to 100 rows, 10 up to 1000, else n // 10 but at most 100."""
    return F.when(n <= 100, 1).when(n <= 1000, 10).otherwise(F.least(F.lit(100), F.floor(n / 10))).cast("int")


def sample_groups(df: DataFrame, key: str, n: int, m: int, seed: int = 42) -> DataFrame:
    """n * m rows in seeded order, dealt in blocks of m: adds block 1..n. The sample's size is given."""
    top = df.withColumn("_h", shuffled(seed, key)).orderBy("_h", key).limit(n * m)
    return top.withColumn("block", F.floor((F.row_number().over(Window.orderBy("_h", key)) - 1) / m) + 1).drop("_h")


def synthetic_member(id_: Column, day: Column, seed: int = 42) -> tuple[Column, Column]:
    """(member 1..10000, a day within the year before `day`)."""
    return F.pmod(id_, F.lit(10000)) + 1, F.date_sub(day, F.floor(uniform(seed, id_) * 365).cast("int"))


def zipf_scenario(ranked: DataFrame, n: int, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """(i, entity) of n requests over ranked (entity, rank): weight 1 / rank^alpha, drawn by seeded uniforms.

    The table of entities is cut into buckets of cumulative weight, so a draw meets one bucket's entities only."""
    spark, buckets = ranked.sparkSession, 1024
    t = cumulated(ranked.select("entity", "rank", (1 / F.pow("rank", F.lit(alpha))).alias("w")), "w", F.col("rank"), F.col("entity"), name="hi")
    t = t.crossJoin(F.broadcast(t.agg(F.max("hi").alias("_all"))))
    t = t.select("entity", ((F.col("hi") - F.col("w")) / F.col("_all")).alias("lo"), (F.col("hi") / F.col("_all")).alias("hi"))
    t = t.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.least(F.floor(F.col("hi") * buckets), F.lit(buckets - 1)))))
    d = spark.range(n).select(F.col("id").alias("i"), uniform(seed, "id").alias("u")).withColumn("b", F.floor(F.col("u") * buckets))
    return d.join(t, "b").where("u >= lo AND u < hi").select("i", "entity")


def _from_pools(rows: DataFrame, key: str, n: int, pool: DataFrame, held: DataFrame, user: str, item: str, seed: int) -> DataFrame:
    """rows times n items (all, if there are fewer) of the pool that the user does not hold (_u, _i), from a
    seeded place of the user's ranked pool on; adds the pool's columns and _try. The pools are exact, so
    rows should be the few for whom draws come out short."""
    free = rows.select(F.col(user).alias("_user")).distinct().crossJoin(pool.drop("_place")).join(held, (F.col("_user") == F.col("_u")) & (F.col(item) == F.col("_i")), "left_anti")
    ranked = free.withColumn("_rank", F.row_number().over(Window.partitionBy("_user").orderBy(shuffled(seed, "_user", item), item)))
    sizes = ranked.groupBy(F.col("_user").alias("_owner")).agg(F.max("_rank").alias("_pool"))
    tries = rows.join(sizes, F.col(user).eqNullSafe(F.col("_owner"))).withColumn("_try", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), "_pool"))))
    tries = tries.withColumn("_at", F.pmod(F.floor(uniform(seed, key) * F.col("_pool")) + F.col("_try") - 1, F.col("_pool")) + 1)
    return tries.join(ranked, F.col("_owner").eqNullSafe(F.col("_user")) & (F.col("_at") == F.col("_rank"))).drop("_user", "_owner", "_pool", "_at", "_rank")


def add_negatives(df: DataFrame, ratio: float, seed: int = 42, user: str = "user", item: str = "item", attributes: tuple[str, ...] = ("category", "tier"), key: tuple[str, ...] = ()) -> DataFrame:
    """df and, for each positive row, max(1, floor(ratio)) items that its user has no positive row with.

    Candidates are drawn at random places of the item table, never by crossing users with items: a row's draws are
    one seeded sequence (from an md5 of the row's `key` columns, by default all, and its number among equal rows), of which what the user has positively and repeats are passed over. The first 2k + 4 draws serve most rows;
    those that come out short go on in the same sequence to 16k + 64, so the result does not depend on where the first
    look ends. Rows still short take from their user's exact pool; only where that pool is smaller than k are
    there fewer. Negatives carry the item's attributes, signal NO_FEEDBACK, label 0, weight 1. With a key, draws are made
    in one pass by user (see `draws`) where items are whole numbers, and not more than a worker holds; else by joins.
    df is read several times, so it should be stored."""
    if ratio <= 0:
        return df
    k = max(1, int(ratio))
    items = numbered(df.where(F.col(item).isNotNull()).groupBy(item).agg(*[F.min(a).alias(a) for a in attributes]), F.col(item), name="_place")
    scratch = Scratch(df.sparkSession, "negatives")
    items = scratch.put(items, "items")
    places = draws.items_in_order(items, item) if key else None
    if places is not None and len(places):
        return df.unionByName(_negatives_by_user(df, k, seed, user, item, attributes, key, items, places, scratch))
    size = items.agg(F.count(F.lit(1)).alias("_items"))
    positives = df.where("label = 1").select(F.col(user).alias("_u"), F.col(item).alias("_i")).distinct()
    whole = scratch.put(_ordinals(df.where("label = 1"), key).withColumn("_seeds", seeds(seed, "_name")), "positives")
    rows = whole.select("_row", "_name", "_seeds", user)
    rest = [c for c in df.columns if c not in (item, *attributes, "signal", "label", "weight")]

    def picked(rows: DataFrame, look: int) -> DataFrame:
        tries = rows.crossJoin(F.broadcast(size)).select("_row", user, "_seeds", "_items", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(look).cast("long"))).alias("_try"))
        tries = tries.select("_row", user, "_try", nth_place(F.col("_seeds"), F.col("_try"), F.col("_items")).alias("_place"))
        found = tries.join(items.select("_place", item), "_place").join(positives, (F.col(user) == F.col("_u")) & (F.col(item) == F.col("_i")), "left_anti")
        once = found.groupBy("_row", item).agg(F.min("_try").alias("_try"))
        return scratch.put(once.withColumn("_rn", F.row_number().over(Window.partitionBy("_row").orderBy("_try"))).where(F.col("_rn") <= k), f"picked{look}")

    def short_of(rows: DataFrame, got: DataFrame) -> DataFrame:
        return rows.join(got.where(F.col("_rn") == k).select("_row"), "_row", "left_anti")

    first = picked(rows, 2 * k + 4)
    short = scratch.put(short_of(rows, first), "short")
    again = picked(short, 16 * k + 64)
    scarce = scratch.put(short_of(short, again), "scarce")
    exact = _from_pools(scarce, "_name", k, items, positives, user, item, seed + 2)
    got = first.join(short.select("_row"), "_row", "left_anti").unionByName(again.join(scarce.select("_row"), "_row", "left_anti"))
    got = got.select("_row", item).unionByName(exact.select("_row", item))
    # The columns of the row and of the item come last, so that draws are narrow.
    made = got.join(whole.select("_row", *rest), "_row").join(items.drop("_place"), item)
    negatives = made.select(*rest, item, *attributes, F.lit("NO_FEEDBACK").alias("signal"), F.lit(0).alias("label"), F.lit(1.0).alias("weight"))
    return df.unionByName(negatives)


#: Kinds of items (of different attributes) that are sent to all tasks, at most; more are joined by item.
SENT_KINDS = 200_000


def _negatives_by_user(df: DataFrame, k: int, seed: int, user: str, item: str, attributes: tuple[str, ...], key: tuple[str, ...], items: DataFrame, places: np.ndarray, scratch: Scratch) -> DataFrame:
    """The negatives of add_negatives, by draws in one pass."""
    rest = [c for c in df.columns if c not in (item, *attributes, "signal", "label", "weight")]
    carry = [c for c in dict.fromkeys([*rest, *key]) if c != user]
    plain = lambda c: F.to_json(c) if df.schema[c].dataType.typeName() == "map" else F.col(c)
    positives = df.where("label = 1")
    asks = positives.select(user, *[F.col(c).alias(f"_c_{c}") for c in carry], F.xxhash64(*[plain(c) for c in df.columns]).alias("_same"))
    held = positives.where(F.col(item).isNotNull()).select(user, F.col(item).alias("_item"))
    rows = draws.by_user(asks, held, user, ("_same",), scratch)
    name = {c: F.col(c if c == user else f"_c_{c}") for c in key}
    base = F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("")) for x in name.values()])
    rows = rows.withColumn("_base", base).withColumn("_s1", seeds(seed, F.concat(F.col("_base"), F.lit(":1"))))
    # Of an item the workers hold its id and the number of its attributes, of which there are few kinds.
    kinds = scratch.put(numbered(items.select(*attributes).distinct(), *[F.col(a) for a in attributes], name="_kind_no").withColumn("_kind_no", F.col("_kind_no").cast("int")), "kinds")
    few = kinds.count() <= SENT_KINDS
    codes = np.zeros(len(places), np.int32)
    if few:
        same = F.lit(True)
        for a in attributes:
            same = same & F.col(f"i.{a}").eqNullSafe(F.col(f"k.{a}"))
        codes = draws.with_codes(places, items.alias("i").join(F.broadcast(kinds.alias("k")), same).select(F.col(f"i.{item}").alias(item), "_kind_no"), item, "_kind_no")
    drawn = draws.negatives_past(rows, user, [f"_c_{c}" for c in carry], places, codes, k, (2 * k + 4, 16 * k + 64), seed)
    drawn = scratch.put(drawn, "drawn").select(user, *[F.col(f"_c_{c}").alias(c) for c in carry if c in rest], "_name", "_items", "_codes")
    found = drawn.select(*rest, F.explode(F.arrays_zip("_items", "_codes")).alias("_x"))
    found = found.select(*rest, F.col("_x._items").cast(df.schema[item].dataType).alias(item), F.col("_x._codes").alias("_kind_no"))
    made = found.join(F.broadcast(kinds), "_kind_no") if few else found.join(items.drop("_place"), item)
    made = made.select(*rest, item, *attributes)
    scarce = scratch.put(drawn.where(F.size("_items") == 0).drop("_items", "_codes"), "scarce")
    if not scarce.isEmpty():
        pairs = positives.select(F.col(user).alias("_u"), F.col(item).alias("_i")).distinct()
        made = made.unionByName(_from_pools(scarce, "_name", k, items, pairs, user, item, seed + 2).select(*rest, item, *attributes))
    return made.select(*rest, item, *attributes, F.lit("NO_FEEDBACK").alias("signal"), F.lit(0).alias("label"), F.lit(1.0).alias("weight"))


def _ordinals(df: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """df with _row, a number from its columns and, of equal rows, from their number, so that each has draws
    of its own, and _name, a text from the key columns (_row without any) and that number. Equal rows are
    counted and written out again, so none needs a window over a hot group."""
    maps = [c for c in df.columns if df.schema[c].dataType.typeName() == "map"]
    keys = [c for c in df.columns if c not in maps]
    runs = df.groupBy(*keys, *[F.to_json(c).alias(f"_{c}") for c in maps]).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in maps])
    long = F.floor((F.col("_n") - 1) / 4096)
    parts = runs.where("_n <= 4096").withColumn("_part", F.lit(0).cast("long")).unionByName(runs.where("_n > 4096").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), long))).repartition("_part", *keys))
    nth = F.explode(F.sequence(F.col("_part") * 4096 + 1, F.least(F.col("_n"), (F.col("_part") + 1) * 4096)))
    rows = parts.withColumn("_nth", nth).withColumn("_row", F.xxhash64(*[F.col(c) for c in keys], *[F.col(f"_{c}") for c in maps], "_nth"))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key], F.col("_nth").cast("string")) if key else F.col("_row").cast("string")
    return rows.select("_row", name.alias("_name"), *df.columns)


def build_eval_lists(df: DataFrame, num_neg: int = 100, num_popular: int = 50, top_k: int = 1000, group: str = "grp", user: str = "user", item: str = "item", seed: int = 42) -> DataFrame:
    """(group, user, item, label): one positive of each group and num_neg items its user has no positive
    row with, num_popular of them from the top_k most popular, the rest from all; a group whose user
    has fewer than num_neg such items is left out. Places are drawn with a margin; groups that come out
    short take from their user's exact pool, as in add_negatives.

    Draws are made in one pass by user (see `draws`) where items are whole numbers, and not more than a worker
    holds; else, and for the few groups that come out short, by joins."""
    scratch = Scratch(df.sparkSession, "lists")
    df = scratch.put(df.select(group, user, item, "label"), "rows")
    positives = df.where("label = 1").select(group, user, item)
    first = F.min(F.struct(F.unhex(shuffled(seed, group, item)).alias("d"), F.col(item).alias("i"), F.col(user).alias("u"))).alias("p")
    pick = scratch.put(positives.groupBy(group).agg(first).select(group, F.col("p.u").alias(user), F.col("p.i").alias(item)), "picked")
    counts = scratch.put(df.groupBy(item).agg(F.sum("label").alias("_c")), "counts")
    popular = scratch.put(counts.where("_c > 0").orderBy(F.desc("_c"), item).limit(top_k).select(item, F.row_number().over(Window.orderBy(F.desc("_c"), item)).alias("_place")), "popular")
    items = draws.items_in_order(counts.select(item), item)
    if items is None or not len(items) or not 0 < num_popular < num_neg:
        return _lists_by_joins(pick, positives, counts, popular, num_neg, num_popular, group, user, item, seed, scratch)
    best = np.searchsorted(items, popular.orderBy("_place").select(item).toArrow().column(item).to_numpy().astype(np.int64))
    asks = pick.select(user, F.col(group).alias("_group"), F.col(item).alias("_pick"))
    rows = draws.by_user(asks, positives.select(user, F.col(item).alias("_item")), user, ("_group",), scratch)
    rows = rows.withColumns({"_s1": seeds(seed + 1, "_group"), "_s2": seeds(seed + 2, "_group")})
    made = scratch.put(draws.lists_past(rows, "_group", user, "_pick", items, best, num_neg, num_popular, (3 * num_popular + 20, 3 * num_neg + 20)), "made")
    made = made.select(F.col("_group").alias(group), user, F.col("_pick").alias(item), "negatives")
    found = made.where(F.size("negatives") > 0)
    lists = found.select(group, user, item, F.lit(1).alias("label")).unionByName(found.select(group, user, F.explode(F.col("negatives").cast(f"array<{df.schema[item].dataType.simpleString()}>")).alias(item), F.lit(0).alias("label")))
    short = scratch.put(made.where(F.size("negatives") == 0).select(group, user, item), "short")
    if short.isEmpty():
        return lists
    return lists.unionByName(_lists_by_joins(short, positives, counts, popular, num_neg, num_popular, group, user, item, seed, scratch))


def _lists_by_joins(pick: DataFrame, positives: DataFrame, counts: DataFrame, popular: DataFrame, num_neg: int, num_popular: int, group: str, user: str, item: str, seed: int, scratch: Scratch) -> DataFrame:
    """The lists of build_eval_lists for some picked positives (group, user, item), for any number and kind of items."""
    held = scratch.put(positives.select(F.col(user).alias("_u"), F.col(item).alias("_i")).distinct(), "held")
    everything = numbered(counts.select(item), F.col(item), name="_place")

    def drawn(pool: DataFrame, n: int, salt: int) -> DataFrame:
        size = pool.agg(F.count(F.lit(1)).alias("_n"))
        start = scratch.put(pick.select(group, user, seeds(seed + salt, group).alias("_seeds")), f"seeds{salt}")
        tries = start.crossJoin(F.broadcast(size)).withColumn("_try", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3 * n + 20).cast("long"))))
        tries = tries.select(group, user, "_try", nth_place(F.col("_seeds"), F.col("_try"), F.col("_n")).alias("_place"))
        found = tries.join(pool, "_place").join(held, (F.col(user) == F.col("_u")) & (F.col(item) == F.col("_i")), "left_anti")
        once = scratch.put(found.groupBy(group, user, item).agg(F.min("_try").alias("_try")), f"drawn{salt}")
        enough = scratch.put(once.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(group), f"enough{salt}")
        exact = _from_pools(pick.select(group, user).join(enough, group, "left_anti"), group, n, pool, held, user, item, seed + salt)
        return scratch.put(once.join(enough, group, "left_semi").unionByName(exact.select(group, user, item, "_try")), f"pool{salt}")

    a = drawn(popular, num_popular, 1).withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy("_try"))).where(F.col("_rn") <= num_popular)
    b = drawn(everything, num_neg, 2).join(a.select(group, item), [group, item], "left_anti")
    both = a.select(group, user, item, F.lit(0).alias("_o"), "_try").unionByName(b.select(group, user, item, F.lit(1).alias("_o"), "_try"))
    neg = both.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy("_o", "_try"))).where(F.col("_rn") <= num_neg)
    full = neg.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == num_neg).select(group)
    lists = pick.select(group, user, item, F.lit(1).alias("label")).unionByName(neg.select(group, user, item, F.lit(0).alias("label")))
    return lists.join(full, group, "left_semi")
