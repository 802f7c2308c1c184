"""A Merkle manifest of a dataset by butterfly exchange.

Every row is a leaf; the leaves of a language form a tree of fanout 8, and the languages' subroots
another. Leaves are numbered over range partitions and cut into partitions of the tree: aligned runs of
8^3 leaves, each of which hashes its own subtree. Then, round by round, groups of 8 partitions whose
numbers differ in one octal digit swap the roots they have and each hashes the parent for itself. So
every partition holds the whole path to the subroot when the rounds are over, and nothing has to go
down again. A partition that is missing at the ragged end is stood in for by the others of its node, in
turn. Only digests and ids are shuffled; the texts are read once.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, workers_find_package

#: Nodes of a run, and levels that a partition hashes by itself.
FAN, HEIGHT = 8, 3
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(c: Column) -> Column:
    """A value as it goes into a leaf: its length in bytes, a colon and it, or a dash for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(field(F.col("doc_id").cast("long")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars").cast("long")), field(text)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, other) of docs (doc_id, source, lang, n_chars, text, ...): the group is `-` for null and
    `=` with the language otherwise; `other` is the leaf of the row with A-Z of its text in lower case where 3
    divides the id's crc32, else null."""
    chosen = (F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0) & F.col("text").isNotNull()
    g = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    return docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), F.when(chosen, leaf(F.translate(F.col("text").cast("string"), A_TO_Z, A_TO_Z.lower()))).alias("other"))


def placed(rows: DataFrame, tall: int, scratch: Scratch, name: str, *order: str) -> DataFrame:
    """rows with idx, the place from 0 within g in the given order (equal rows in any), n, the number of g's rows,
    and block, the partition of the tree. The rows are stored range-partitioned; a run of g in a partition starts where the runs before end."""
    stored = scratch.put(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("_id", F.monotonically_increasing_id()), name)
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    runs = stored.groupBy("g", part.alias("_part")).agg(F.min(at).alias("_low"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy("g")
    runs = runs.select("g", "_part", (F.sum("_rows").over(w.orderBy("_part")) - F.col("_rows") - F.col("_low")).alias("_shift"), F.sum("_rows").over(w).alias("n"))
    out = stored.withColumn("_part", part).join(scratch.put(runs, f"{name}_runs"), ["g", "_part"])
    return out.withColumn("idx", at + F.col("_shift")).withColumn("block", F.floor(F.col("idx") / FAN**tall)).drop("_id", "_part", "_shift")


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def subtree(digests: list[str], n: int, tall: int) -> list[list[str]]:
    """The levels of a partition of a tree over n nodes, its own nodes first."""
    levels = [digests]
    for _ in range(min(tall, height(n))):
        last = levels[-1]
        levels.append([sha(*last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return levels


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """For the node i, level by level: what stands before and after it in its run."""
    out = []
    for level in levels[:-1]:
        low = i - i % FAN
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + FAN])))
        i //= FAN
    return out


PATH = "array<struct<before:string,after:string>>"


def block_roots(nodes: DataFrame, digest: str, tall: int) -> DataFrame:
    """(g, block, n, root) of nodes (g, block, idx, n, digest)."""

    def root(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        n = t.column("n")[0].as_py()
        top = subtree(t.column(digest).to_pylist(), n, tall)[-1][0]
        return pa.table({"g": t.column("g")[:1], "block": t.column("block")[:1], "n": [n], "root": [top]})

    return nodes.select("g", "block", "idx", "n", digest).groupBy("g", "block").applyInArrow(root, "g string, block long, n long, root string")


def exchanged(blocks: DataFrame, tall: int, rounds: int) -> DataFrame:
    """(g, block, root, path): each partition's path from its root up to its tree's, and that tree's root.

    In round r, partitions of the same number but for the octal digit r form a group, in which each gives its
    root and takes the others'. Of trees with fewer rounds the partitions pass as they are."""
    b = blocks.select("g", "block", F.ceil(F.col("n") / FAN**tall).alias("_all"), "root", F.array().cast(PATH).alias("path"))
    for r in range(rounds):
        low, up = FAN**r, FAN ** (r + 1)
        busy = F.col("_all") > low
        digit = F.pmod(F.floor(F.col("block") / low), F.lit(FAN))
        here = F.pmod(F.col("block"), F.lit(low))
        # The last node may have fewer partitions than the nodes that stand beside it; its partitions then
        # also stand, in turn, where one is missing.
        has = F.col("_all") - F.floor((F.col("_all") - 1) / low) * low
        ragged = busy & (F.floor(F.col("block") / low) == F.floor((F.col("_all") - 1) / low)) & (has < low) & (digit > 0)
        at = F.when(ragged, F.sequence(here, F.lit(low - 1).cast("long"), has)).otherwise(F.array(F.when(busy, here).otherwise(F.lit(-1).cast("long"))))
        sent = b.withColumn("_group", F.when(busy, F.floor(F.col("block") / up)).otherwise(F.col("block"))).withColumn("_here", here).withColumn("_digit", digit).withColumn("_at", F.explode(at))
        member = F.struct("_digit", "block", "root", "path", (~busy | (F.col("_at") == F.col("_here"))).alias("own"))
        met = sent.groupBy("g", "_all", "_group", "_at").agg(F.array_sort(F.collect_list(member)).alias("m"))
        met = met.withColumn("_parent", F.sha2(F.concat_ws("", F.col("m.root")).cast("binary"), 256)).withColumn("x", F.explode(F.filter("m", lambda x: x["own"])))
        side = lambda keep: F.concat_ws("", F.transform(F.filter("m", keep), lambda x: x["root"]))
        step = F.struct(side(lambda x: x["_digit"] < F.col("x._digit")).alias("before"), side(lambda x: x["_digit"] > F.col("x._digit")).alias("after"))
        b = met.select("g", F.col("x.block").alias("block"), "_all", F.when(busy, F.col("_parent")).otherwise(F.col("x.root")).alias("root"), F.when(busy, F.concat("x.path", F.array(step))).otherwise(F.col("x.path")).alias("path"))
    return b.select("g", "block", "root", "path")


def tree(nodes: DataFrame, digest: str, tall: int, scratch: Scratch, name: str) -> DataFrame:
    """The partitions of nodes (g, block, idx, n, digest) with their upper paths, stored."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    return scratch.put(exchanged(scratch.put(block_roots(nodes, digest, tall), f"{name}_roots"), tall, max(0, height(most) - tall)), name)


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        digest = sha(before, digest, after)
    return digest


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, tall: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs (doc_id, source,
    lang, n_chars, text, ...).

    Leaves ascend by doc_id within their language, null ids first, rows that repeat an id by their leaf;
    subroots ascend by language, null first, bytewise. Nodes are hashed in runs of 8, the last of which may
    have fewer, while several are left; a lone leaf is its subroot, a lone subroot the root.
    folded_root is recomputed from the row as it is after tampering (where 3 divides the crc32 of the id,
    which a null id has not: its text's A-Z in lower case; null texts stay) and the siblings of the
    proof. Any column may be null; rows that repeat stay; other columns are ignored; an empty table has no rows.
    `tall` levels are hashed within a partition of 8^tall leaves; it changes no value.
    """
    spark = docs.sparkSession
    workers_find_package(spark)
    scratch = Scratch(spark, "merkle")
    rows = placed(scratch.put(leaves(docs), "leaves"), tall, scratch, "placed", "doc_id", "leaf")
    upper = tree(rows, "leaf", tall, scratch, "blocks")
    # The subroots are the nodes of one more tree.
    tops = placed(upper.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("lang"), F.col("root").alias("digest")), tall, scratch, "subroots", "lang")
    above = tree(tops, "digest", tall, scratch, "tops")

    def whole(t: pa.Table, up: pa.Table) -> pa.Table:
        """The nodes of one partition of subroots with their whole paths and the root."""
        t = t.sort_by("idx")
        levels, rest, root = subtree(t.column("digest").to_pylist(), t.column("n")[0].as_py(), tall), up.column("path")[0].as_py(), up.column("root")[0].as_py()
        paths = [[{"before": b, "after": a} for b, a in siblings(levels, i)] + rest for i in range(t.num_rows)]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table({"g": t.column("lang"), "top": pa.array([root] * t.num_rows), "rest": pa.array(paths, kind)})

    ends = tops.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(whole, f"g string, top string, rest {PATH}")
    upper = upper.join(scratch.put(ends, "ends"), "g").select("g", "block", F.col("root").alias("subroot"), "top", F.concat("path", "rest").alias("path"))

    def proofs(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        mine, others = t.column("leaf").to_pylist(), t.column("other").to_pylist()
        levels, rest = subtree(mine, t.column("n")[0].as_py(), tall), [(x["before"], x["after"]) for x in up.column("path")[0].as_py()]
        sub, root = up.column("subroot")[0].as_py(), up.column("top")[0].as_py()
        paths = [siblings(levels, i) + rest for i in range(len(mine))]
        back = [folded(o or d, p) for d, o, p in zip(mine, others, paths)]
        return pa.table({"doc_id": t.column("doc_id"), "leaf": mine, "subroot": [sub] * len(mine), "root": [root] * len(mine), "proof_sha256": [sha(*(x for p in path for x in p)) for path in paths], "folded_root": back, "verified": [x == root for x in back]})

    return rows.groupBy("g", "block").cogroup(upper.groupBy("g", "block")).applyInArrow(proofs, MANIFEST)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_sql() -> str:
    """The levels of each tree as lists; crc32 bit by bit."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    low = f"translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}')"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    up = "list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1 : i * 8 + 8], '')))"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)"
    return f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, sha256({head} || {part("text")}) AS leaf, text IS NOT NULL AND {crc} % 3 = 0 AS chosen, sha256({head} || {part(low)}) AS other FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaf),
levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM numbered GROUP BY lang
  UNION ALL SELECT lang, level + 1, {up} FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {up} FROM tops WHERE len(nodes) > 1),
heights AS (SELECT lang, max(level) AS h FROM levels GROUP BY lang),
runs AS (
  SELECT n.doc_id, n.leaf, n.lang, n.idx, l.level, nodes[(idx // (8 ** level)::BIGINT) // 8 * 8 + 1 : (idx // (8 ** level)::BIGINT) // 8 * 8 + 8] AS run, (idx // (8 ** level)::BIGINT) % 8 AS pos
  FROM numbered n JOIN levels l ON n.lang IS NOT DISTINCT FROM l.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT n.doc_id, n.leaf, n.lang, n.idx, h.h + t.level, nodes[(place // (8 ** t.level)::BIGINT) // 8 * 8 + 1 : (place // (8 ** t.level)::BIGINT) // 8 * 8 + 8], (place // (8 ** t.level)::BIGINT) % 8
  FROM numbered n JOIN subroots s ON n.lang IS NOT DISTINCT FROM s.lang JOIN heights h ON n.lang IS NOT DISTINCT FROM h.lang CROSS JOIN tops t WHERE len(nodes) > 1),
paths AS (
  SELECT lang, idx, list(array_to_string(run[1 : pos], '') ORDER BY level) AS before, list(array_to_string(run[pos + 2 : 8], '') ORDER BY level) AS after
  FROM runs GROUP BY lang, idx),
fold AS (
  SELECT n.lang, n.idx, 0 AS step, CASE WHEN chosen THEN other ELSE leaf END AS digest, coalesce(before, []) AS before, coalesce(after, []) AS after
  FROM numbered n LEFT JOIN paths p ON n.lang IS NOT DISTINCT FROM p.lang AND n.idx = p.idx
  UNION ALL SELECT lang, idx, step + 1, sha256(before[step + 1] || digest || after[step + 1]), before, after FROM fold WHERE step < len(before))
SELECT n.doc_id, n.leaf, s.subroot, t.nodes[1] AS root,
  sha256(array_to_string(list_transform(list_zip(f.before, f.after), lambda x: x[1] || x[2]), '')) AS proof_sha256,
  f.digest AS folded_root, f.digest = t.nodes[1] AS verified
FROM numbered n JOIN subroots s ON n.lang IS NOT DISTINCT FROM s.lang
JOIN fold f ON n.lang IS NOT DISTINCT FROM f.lang AND n.idx = f.idx AND f.step = len(f.before)
CROSS JOIN (SELECT nodes FROM tops WHERE len(nodes) = 1) t
"""
