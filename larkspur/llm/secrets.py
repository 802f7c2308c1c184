"""Secret scans with multipart credential linking.

One scan of each whole text finds the base kinds (assign, access, hex), which always count, and weak
parts that alone mean nothing: identifiers (id), key-like strings (key) and endpoints (host). A weak
part is reported only when a part of another kind stands within `scope` code points of the same
text: parts are put into the bins, as wide as the scope, that they cover, each bin keeps the first
start and the last end of each kind, and an interval join with the covered and the two neighbouring
bins finds whether one is near enough. The join is linear in the parts and the text, however many
stand in one text. Distance is the gap between the end of one part and the start of the next, 0 when
they overlap (with gaps=False, as by default in find_secrets, from start to start).

A URL is one part: key-like pieces of its path are not keys (its user-info and the values of its
query and fragment can be), and an identifier inside it is no partner of an endpoint. Masking takes
identifiers and endpoints only where a key stands near.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Scratch, over_text, row_name

#: The base kinds. (pattern, group whose length counts, least length)
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = (("assign", ASSIGN, 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24))
#: Weak parts. key: 20 characters or more of which some are digits and some letters (see _weak).
WEAK = (
    ("id", re.compile(r"(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee]|_?[Ii][Dd])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt](?:_?[Ii][Dd])?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})"), 1),
    ("key", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])"), 0),
    ("host", re.compile(r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s\"'<>]{4,}|(?:[Hh][Oo][Ss][Tt]|[Ee][Nn][Dd][Pp][Oo][Ii][Nn][Tt]|[Ss][Ee][Rr][Vv][Ee][Rr])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,}(?::\d+)?"), 0),
)
ORDER = {k: i for i, k in enumerate([b[0] for b in BASE] + [w[0] for w in WEAK])}
#: A URL's user-info, and what comes before the first value of its query or fragment.
USERINFO = re.compile(r"[a-z0-9]+://([^/?#@]*)@")
VALUES = re.compile(r"[^?#]*[?#][^=]*=")
ROLE = {"access": "id", "assign": "key", "hex": "key", "id": "id", "key": "key", "host": "host"}
SPAN = "struct<kind:string,start:long,end:long>"
BASE_KINDS = tuple(b[0] for b in BASE)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text by start, then kind; the whole match is the span."""
    out = [(kind, m.start(), m.end()) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def _around(hosts: list[tuple[int, int]], a: int, b: int) -> int | None:
    """Which of the host spans (they are by start and apart) holds [a, b)."""
    k = bisect_right(hosts, (a, float("inf"))) - 1
    return k if k >= 0 and b <= hosts[k][1] else None


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by start, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _meets(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the spans, which are apart and by start, overlaps [a, b)."""
    k = bisect_left(spans, (b,)) - 1
    return k >= 0 and spans[k][1] > a


def _key_in_url(text: str, a: int, b: int, url: tuple) -> int | None:
    """Where the key [a, b) of a URL starts: in its user-info, in a value of its query or fragment, or
    behind it in a list; else None."""
    info, values = url
    if info and a < info.end(1):
        a = max(a, info.start(1))
        return a if b - a >= 20 else None
    if text[a - 1] in ",;|":
        return a
    name = text[a - 1] in "?#&" and (text[b - 1] == "=" or text[b : b + 1] == "=")
    return a if values and a >= values.end() and not name else None


def _weak(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out = []
    hosts = [m.span() for kind, pattern, _ in WEAK if kind == "host" for m in pattern.finditer(text)]
    taken = _merged([s[1:] for s in base])
    urls = [(USERINFO.match(text, *h), VALUES.match(text, *h)) for h in hosts]
    for kind, pattern, group in WEAK:
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if kind == "key":
                around = _around(hosts, a, b)
                if around is not None:
                    a = _key_in_url(text, a, b, urls[around])
                    if a is None:
                        continue
                s, n = text[a:b], Counter(text[a:b])
                if not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s) or len(n) < 10:
                    continue
                if _meets(taken, a, b):
                    continue
            out.append((kind, a, b))
    return out


def _roles(weak: list[tuple[str, int, int]]) -> list[str]:
    """What each part is a partner as; identifiers inside an endpoint belong to it."""
    hosts = [s[1:] for s in weak if s[0] == "host"]
    return ["host" if kind == "id" and _around(hosts, a, b) is not None else ROLE[kind] for kind, a, b in weak]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, weak, roles) for rows (doc_id, row, text): base and weak are arrays of
    (kind, start, end), roles those of weak."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            base, weak, roles = [], [], []
            for text in batch.column(2).to_pylist():
                found = base_spans(text or "")
                base.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                parts = _weak(text or "", found)
                weak.append([dict(zip(("kind", "start", "end"), s)) for s in parts])
                roles.append(_roles(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, spans), pa.array(weak, spans), pa.array(roles, pa.list_(pa.string()))], ["doc_id", "row", "base", "weak", "roles"])

    return over_text(docs.select("doc_id", "row", "text"), run, f"doc_id long, row {ROW}, base array<{SPAN}>, weak array<{SPAN}>, roles array<string>")


def linked(found: DataFrame, scope: int, gaps: bool) -> DataFrame:
    """(row, more, keyed): the weak parts that have a part of another kind within scope, by row; keyed
    are those that are keys or have one.

    Base spans of kind access count as identifiers and those of assign and hex as keys."""
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    once = found.where("size(weak) > 0").dropDuplicates(["row"])
    parts = once.select("row", F.explode(F.arrays_zip(F.concat("base", "weak").alias("s"), F.concat(F.transform("base", lambda s: role[s["kind"]]), "roles").alias("role"))).alias("p")).select("row", "p.s.kind", "p.s.start", "p.s.end", "p.role")
    parts = parts.withColumn("to", F.col("end") if gaps else F.col("start"))
    bin_of = lambda c: F.floor(F.col(c) / scope)
    ends = parts.withColumn("bin", F.explode(F.sequence(bin_of("start"), bin_of("to")))).groupBy("row", "bin", F.col("role").alias("other")).agg(F.min("start").alias("first"), F.max("to").alias("last"))
    # Each part looks into the bins that it covers and both neighbours.
    weak = parts.where(~F.col("kind").isin(*BASE_KINDS)).withColumn("bin", F.explode(F.sequence(bin_of("start") - 1, bin_of("to") + 1)))
    near = weak.join(ends, ["row", "bin"]).where((F.col("other") != F.col("role")) & (F.col("first") - F.col("to") <= scope) & (F.col("start") - F.col("last") <= scope))
    part = F.struct("kind", "start", "end")
    once = near.groupBy("row", part.alias("s")).agg(F.bool_or((F.col("role") == "key") | (F.col("other") == "key")).alias("keyed"))
    return once.groupBy("row").agg(F.collect_list("s").alias("more"), F.collect_list(F.when(F.col("keyed"), F.col("s"))).alias("keyed"))


def find_secrets(docs: DataFrame, scope: int = 200, scratch: Scratch | None = None, gaps: bool = False, keyed: bool = False) -> DataFrame:
    """(doc_id, row, base, spans) for every row of docs (doc_id, text, ...): the base spans, and all spans
    with the linked weak parts, as arrays of (kind, start, end) in code points, by start, then kind.

    Null and empty texts have none. Rows that repeat stay and get the same spans; a null doc_id is
    allowed; other columns are ignored; row is row_name(). Texts are scanned whole. keyed:
    only the linked parts that are keys or have one near.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", row_name())
    found = scratch.put(scan(rows), "found")
    more = scratch.put(linked(found, scope, gaps), "linked")
    rank = F.create_map(*[F.lit(x) for k, i in ORDER.items() for x in (k, i)])
    spans = F.transform(F.concat("base", F.coalesce("keyed" if keyed else "more", F.array().cast(f"array<{SPAN}>"))), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(spans), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.join(more, "row", "left").select("doc_id", "row", "base", spans.alias("spans"))


def _text(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, scope: int = 200, mask: str = "[secret]") -> DataFrame:
    """docs with every span (base, and linked where a key stands near) of the text replaced by the mask;
    overlapping spans are one. Every row stays; texts without a span are untouched; null stays null."""
    scratch = Scratch(docs.sparkSession, "secrets-stage")
    spans = scratch.put(find_secrets(docs, scope, scratch, gaps=True, keyed=True).where("size(spans) > 0").select(F.col("row").alias("_row"), F.col("spans").alias("_spans")).dropDuplicates(["_row"]), "spans")
    names = docs.columns
    both = docs.join(spans, row_name() == spans["_row"], "left")
    # Merge overlapping spans, then write the stretches between them with the mask in between.
    step = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lambda s, x: F.struct(
        F.when(x["end"] <= s["at"], s["out"]).when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask))).alias("out"),
        F.greatest(s["at"], x["end"]).alias("at")), lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.lit(2147483647))))
    return both.select(*[F.when(F.col("_spans").isNull(), F.col(c)).otherwise(step).alias(c) if c == "text" else F.col(c) for c in names])


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), gaps=True)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))
