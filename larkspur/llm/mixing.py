"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A document of a source whose target is r times its size should be copied r times. floor(r) copies
are certain; the fraction is a probability. Two documents with fractional probabilities are paired
and mass in words moves from one to the other until one of them is 0 or 1; which way is drawn so
that both expectations stay. Documents of similar length are paired first. What then stays open is
paired with a group of shorter ones, as one short document could not take what a long one gives up:
documents of a 128th of their source or more with all shorter ones of the source, the others within
small groups of a tree. Folding a group leaves at most one document open; these residuals are regrouped
and folded again, so a source of any size is a tree of depth log(n) whose groups hold a few dozen rows.
A few hundred short documents of each source wait for the root and settle what is left there, longest
first, so that what is open at the end is short; it is drawn alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows in a group of the tree, on average; short documents of a source, on average, that join only at
#: the root, so that what stays open there is short.
FAN, WAITING = 24, 300
#: A document of at least this part of its source is settled against all shorter ones of it.
LONG = 128
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a
    target stops at `most` times its source's size and the excess is shared by weight among the
    others until none is above. The table has a row for each source; its order needs one sort of it
    in one task, so it is meant for up to some million sources.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    at_or_after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.partitionBy(F.lit(0))
    # If the sources before this one are at their caps, the rest's level per unit of weight is:
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(at_or_after)
    t = t.withColumn("level", level).withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("final"), F.col("cap"))).alias("target"))


def _draw(*key: Column) -> Column:
    """A number in [0, 1) from a hash, so that a rerun draws it again."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)).cast("double") / float(1 << 53)


ITEM = "struct<order:bigint,k:bigint,doc_id:bigint,size:bigint,base:bigint,p:double>"
ITEMS = f"array<{ITEM}>"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_p(r: Column, p: Column) -> Column:
    """The item with another probability; what lies within rounding of 0 or 1 is that."""
    p = F.when(p < 1e-12, 0.0).when(p > 1 - 1e-12, 1.0).otherwise(p)
    return F.struct(r["order"].alias("order"), r["k"].alias("k"), r["doc_id"].alias("doc_id"), r["size"].alias("size"), r["base"].alias("base"), p.alias("p"))


def _integral(p: Column) -> Column:
    return (p <= 0.0) | (p >= 1.0)


def _drawn(x: Column, up: Column) -> Column:
    return _with_p(x, F.when(up, 1.0).otherwise(0.0))


def _pair(a: Column, b: Column, salt: int) -> Column:
    """(open, done) of two open items: words move from one to the other until one is integral."""

    def moved(m):
        up, down = m["up"], m["down"]
        pa = F.when(m["go_up"], F.when(up == (1 - a["p"]) * a["size"], 1.0).otherwise(a["p"] + up / a["size"])).otherwise(F.when(down == a["p"] * a["size"], 0.0).otherwise(a["p"] - down / a["size"]))
        pb = F.when(m["go_up"], F.when(up == b["p"] * b["size"], 0.0).otherwise(b["p"] - up / b["size"])).otherwise(F.when(down == (1 - b["p"]) * b["size"], 1.0).otherwise(b["p"] + down / b["size"]))
        return F.struct(_with_p(a, pa).alias("a"), _with_p(b, pb).alias("b"))

    def parted(n):
        both = F.array(n["a"], n["b"])
        return F.struct(F.get(F.filter(both, lambda x: ~_integral(x["p"])), F.lit(0)).alias("open"), F.filter(both, lambda x: _integral(x["p"])).alias("done"))

    # Words that could move from b to a and from a to b.
    up, down = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"]), F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    room = _let(F.struct(up.alias("up"), down.alias("down")), lambda m: F.struct(m["up"].alias("up"), m["down"].alias("down"), (_draw(a["k"], b["k"], F.lit(salt)) * (m["up"] + m["down"]) < m["down"]).alias("go_up")))
    return _let(_let(room, moved), parted)


def _alike(a: Column, b: Column) -> Column:
    """Whether the shorter item b is at least half as long: such are paired, before either meets shorter ones."""
    return b["size"] * 2 >= a["size"]


def _against_all(x: Column, mass: Column, size: Column, salt: int) -> Column:
    """(x, mass): the item x settled against documents of one probability, `mass` by `size` words in all. It
    becomes 1 with its probability, and the words that it gains or gives up are given up or gained by the
    others, all by the same share. Where they have not that many, the part that they have moves either
    way, so that expectations stay."""

    def settled(v):
        gain, loss = (1 - x["p"]) * x["size"], x["p"] * x["size"]
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v["mass"] / gain, (v["size"] - v["mass"]) / loss))
        return F.struct(_drawn(x, v["up"]).alias("x"), F.greatest(F.lit(0.0), F.least(v["size"].cast("double"), v["mass"] + F.when(v["up"], -part * gain).otherwise(part * loss))).alias("mass"))

    return _let(F.struct(mass.alias("mass"), size.alias("size"), (_draw(x["k"], F.lit(salt)) < x["p"]).alias("up")), settled)


LONGEST = f"struct<open:{ITEM},mass:double,size:bigint,done:{ITEMS}>"


def _long(group: Column, mass: Column, size: Column, salt: int) -> Column:
    """Settle a source's longest documents, an array of items, longest first: alike ones are paired, and what
    stays open meets all shorter documents (which have one probability, their mass by their size): the settled
    items, and the mass and size left."""
    state = lambda o, m, n, d: F.struct(o.alias("open"), m.cast("double").alias("mass"), n.cast("long").alias("size"), d.alias("done")).cast(LONGEST)

    def step(s, x):
        def taken(s):
            """x leaves the others and is the open one."""
            own = _let(F.struct(F.coalesce(F.try_divide(s["mass"], s["size"]), F.lit(0.0)).alias("p")), lambda v: _with_p(x, v["p"]))
            return _let(F.struct(own.alias("x")), lambda v: _let(F.struct((s["mass"] - v["x"]["p"] * x["size"]).alias("mass"), (s["size"] - x["size"]).alias("size")), lambda m: F.when(_integral(v["x"]["p"]), state(s["open"], m["mass"], m["size"], F.concat(s["done"], F.array(v["x"])))).when(s["open"].isNull(), state(v["x"], m["mass"], m["size"], s["done"])).otherwise(_let(_pair(s["open"], v["x"], salt), lambda q: state(q["open"], m["mass"], m["size"], F.concat(s["done"], q["done"]))))))

        met = _let(_against_all(s["open"], s["mass"], s["size"], salt), lambda q: state(F.lit(None).cast(ITEM), q["mass"], s["size"], F.concat(s["done"], F.array(q["x"]))))
        return _let(F.when(s["open"].isNotNull() & ~_alike(s["open"], x), met).otherwise(s), taken)

    def end(s):
        met = _let(_against_all(s["open"], s["mass"], s["size"], salt), lambda q: F.struct(q["mass"].alias("mass"), s["size"].alias("size"), F.concat(s["done"], F.array(q["x"])).alias("done")))
        return F.when(s["open"].isNull(), F.struct(s["mass"].alias("mass"), s["size"].alias("size"), s["done"].alias("done"))).otherwise(met)

    return _let(F.aggregate(group, state(F.lit(None).cast(ITEM), mass, size, F.array().cast(ITEMS)), step), end)


def _fold(group: Column, salt: int, root: bool) -> Column:
    """Fold an array of items, longest first: (open, done), the settled ones and at most one still open.

    The open item is paired with the next if that is alike. Else it meets all shorter ones: it becomes 1 with
    its probability and they give up the words it gains, or gain those it gives up, in proportion to
    what each can move either way, so expectations stay and a short item is the last. If they have not
    enough, it is paired with the next nevertheless; at the root it is settled as far as they reach."""
    kind = f"struct<open:{ITEM},rest:{ITEMS},done:{ITEMS}>"
    state = lambda o, r, d: F.struct(o.alias("open"), r.alias("rest"), d.alias("done")).cast(kind)
    none = F.lit(None).cast(ITEM)

    def step(s, _):
        x, rest = s["open"], s["rest"]
        gain, loss = (1 - x["p"]) * x["size"], x["p"] * x["size"]
        room = lambda r: F.least(r["p"] * r["size"] / gain, (1 - r["p"]) * r["size"] / loss)

        def move(b):
            per = F.when(b["up"], -gain).otherwise(loss) / F.greatest(F.lit(1.0), b["room"])
            return state(none, F.transform(rest, lambda r: _with_p(r, r["p"] + room(r) * per / r["size"])), F.concat(s["done"], F.array(_drawn(x, b["up"]))))

        met = _let(F.struct(F.aggregate(rest, F.lit(0.0), lambda t, r: t + room(r)).alias("room"), (_draw(x["k"], F.lit(salt)) < x["p"]).alias("up")), lambda b: move(b) if root else F.when(b["room"] >= 1, move(b)).otherwise(s))

        def taken(s):
            def with_next(n):
                y, left = n["y"], n["left"]
                return F.when(_integral(y["p"]), state(s["open"], left, F.concat(s["done"], F.array(y)))).when(s["open"].isNull(), state(y, left, s["done"])).otherwise(_let(_pair(s["open"], y, salt), lambda q: state(q["open"], left, F.concat(s["done"], q["done"]))))

            return _let(F.struct(F.element_at(s["rest"], 1).alias("y"), F.slice(s["rest"], F.lit(2), F.size(s["rest"])).alias("left")), with_next)

        return _let(F.when(x.isNotNull() & ~_alike(x, F.element_at(rest, 1)), met).otherwise(s), taken)

    return F.aggregate(group, state(none, group.cast(ITEMS), F.array().cast(ITEMS)), step, lambda s: F.struct(s["open"].alias("open"), s["done"].alias("done")))


#: Equal rows that one task numbers.
RUN = 4096


def _with_ordinals(rows: DataFrame) -> DataFrame:
    """rows with nth, a number that tells equal rows apart: they are counted and written out again, long
    runs in parts that are dealt over all tasks."""
    names = rows.columns
    runs = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    long = runs.where(F.col("_n") > RUN).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))))
    long = long.repartition("_part", *names).withColumn("_first", F.col("_part") * RUN + 1)
    parts = runs.where(F.col("_n") <= RUN).select(*names, F.lit(1).cast("long").alias("_first"), F.col("_n").alias("_last"))
    parts = parts.unionByName(long.select(*names, "_first", F.least("_n", F.col("_first") + RUN - 1).alias("_last")))
    return parts.select(*names, F.explode(F.sequence("_first", "_last")).alias("nth"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for every row of docs (doc_id, text, source, ...).

    size counts the words of the whole text; taken is copies * size. Every copy number is floor or
    ceiling of target / source_size, so at most `most` when that is whole. Null or wordless texts have
    size 0 and take 0; a null source is a source of its own, the last; rows that repeat are documents
    of their own; other columns are ignored; an empty table gives an empty mix. Draws are hashes of
    ids and the seed, so reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = scratch.put(_with_ordinals(rows), "sizes")
    # Partial sums by source, so a source that holds a third of all rows is no large task.
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sizes = scratch.put(sizes, "sources")
    goal = scratch.put(targets(sizes.select("source", "source_size"), weights, most).join(sizes.select(F.col("source").alias("s2"), "rows"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "targets")
    keep = ["doc_id", "source", "size", "source_size", "target", "base"]
    item = lambda: F.struct((-F.col("size")).alias("order"), "k", "doc_id", "size", "base", "p")

    def placed(goal: DataFrame) -> DataFrame:
        """The rows with their source's base and p and a number of their own."""
        out = rows.join(goal.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
        return out.withColumn("k", F.xxhash64("doc_id", "size", "source", "nth", F.lit(seed)))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("base", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    # The longest of a source, at most LONG documents, are settled first, against all the others.
    is_long = (F.col("p") > 0) & (F.col("size") > 0) & (F.col("size") * LONG >= F.col("source_size"))
    longest = placed(goal).where(is_long).groupBy("source", "source_size", "target", "p").agg(F.array_sort(F.collect_list(item())).alias("g"))
    longest = scratch.put(longest.select("source", "source_size", "target", _long(F.col("g"), F.col("p") * F.col("source_size"), F.col("source_size"), seed).alias("f")), "long")
    after = longest.select(F.col("source").alias("s2"), (F.col("f.mass") / F.greatest(F.col("f.size"), F.lit(1))).alias("p2"))
    goal = goal.join(after, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2").withColumn("first", F.col("p")).withColumn("p", F.coalesce("p2", "p")).drop("p2")
    level = placed(scratch.put(goal, "shares")).where(~((F.col("first") > 0) & (F.col("size") > 0) & (F.col("size") * LONG >= F.col("source_size"))))
    level = scratch.put(level.select(*keep, "p", "k", "rows"), "level0")
    done = longest.select("source", "source_size", "target", F.explode("f.done").alias("d"))
    settled = [done.select("d.doc_id", "source", "d.size", "source_size", "target", "d.base", F.col("d.p").cast("long").alias("extra"))]
    fixed = (F.col("p") < 1e-12) | (F.col("p") > 1 - 1e-12) | (F.col("size") <= 0)
    settled.append(level.where(fixed).select(*keep, F.when(F.col("size") > 0, (F.col("p") >= 0.5).cast("long")).otherwise(F.lit(0).cast("long")).alias("extra")))
    level = level.where(~fixed)
    waits = (F.col("size") * F.col("rows") <= F.col("source_size")) & (F.pmod(F.xxhash64("k", F.lit(seed - 2)), F.col("rows")) < WAITING)
    waiting, level = level.where(waits), level.where(~waits)
    n, depth = goal.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("n")).first()["n"], 0
    while n > 0:
        depth += 1
        last = n <= FAN
        left = 1 if last else FAN ** (depth - 1)
        groups = F.lit(1).cast("long") if last else F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rows") / float(left * FAN)))
        level = level.unionByName(waiting.select(level.columns)) if last else level
        bucket = F.pmod(F.xxhash64("k", F.lit(seed + depth)), groups)
        grouped = level.withColumn("bucket", bucket).groupBy("source", "bucket", "source_size", "target", "rows").agg(F.array_sort(F.collect_list(item())).alias("g"))
        folded = scratch.put(grouped.select("source", "source_size", "target", "rows", _fold(F.col("g"), seed + depth, last).alias("f")), f"level{depth}")
        done = folded.select("source", "source_size", "target", F.explode("f.done").alias("d"))
        settled.append(done.select("d.doc_id", "source", "d.size", "source_size", "target", "d.base", (F.col("d.p") >= 0.5).cast("long").alias("extra")))
        level = folded.where("f.open is not null").select(F.col("f.open.doc_id").alias("doc_id"), "source", F.col("f.open.size").alias("size"), "source_size", "target", F.col("f.open.base").alias("base"), F.col("f.open.p").alias("p"), F.col("f.open.k").alias("k"), "rows")
        if last:
            break
        n = -(-n // FAN)
    if depth:
        # The last of each source is integral by now or drawn alone.
        settled.append(level.select(*keep, (_draw(F.col("k"), F.lit(seed - 1)) < F.col("p")).cast("long").alias("extra")))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    copies = F.col("base") + F.col("extra")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"), "source")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
