"""URL filters with empirical-Bayes host reputation.

Pages that a rule fits are labelled outcomes (blocked or allowed). Their counts per host are shrunk
through beta-binomial priors: suffix towards all pages, registered domain towards its suffix, host
towards its domain. The weight of each prior is estimated from how much the groups below it differ.
A page without a rule is blocked where even the lower posterior bound of its host's blocked share
reaches `cut`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with its path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Rules of public suffixes beyond the last label, in the notation of the public list: *. stands for any
#: label, ! for an exception. A parameter; these are some common ones, not the full list.
SUFFIXES = ("ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk", "*.ck", "!www.ck")
#: Addresses are registered domains and suffixes of their own.
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"
Z, CUT = 1.645, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to /, ?, # or the end, A-Z lower-cased; path up to ?, #
    or the end. Both are empty for null and for a url without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, F.lit(1) * at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def suffix_labels(name: Column, suffixes=SUFFIXES) -> Column:
    """How many labels of a host name are its public suffix: of the rules that fit the longest, an
    exception first and less its first label; 1 without a rule."""
    tail = lambda rule: F.substring_index(name, ".", -len(rule.split(".")))
    out = F.lit(1)
    for n in sorted({len(r.split(".")) for r in suffixes if r[0] != "!"}):
        plain = [r for r in suffixes if len(r.split(".")) == n and r[0] not in "*!"]
        wild = [r[2:] for r in suffixes if len(r.split(".")) == n and r[0] == "*"]
        fits = F.substring_index(name, ".", -n).isin(*plain) if plain else F.lit(False)
        if wild:
            fits = fits | (F.substring_index(name, ".", -(n - 1)).isin(*wild) & (F.size(F.split(name, r"\.")) >= n))
        out = F.when(fits, n).otherwise(out)
    for rule in (r[1:] for r in suffixes if r[0] == "!"):
        out = F.when(tail(rule) == rule, len(rule.split(".")) - 1).otherwise(out)
    return out


def domain_parts(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host, without user name and port; an address is both."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels, address = F.split(name, r"\."), name.rlike(ADDRESS)
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.least(F.size(labels), n)), ".")
    n = suffix_labels(name, suffixes)
    return F.when(address, name).otherwise(last(n)), F.when(address, name).otherwise(last(n + 1))


def _strength(n: str, k: str, prior: str) -> Column:
    """A prior's weight in outcomes, 1 to 100: from the variance between groups over the binomial one."""
    p = F.col(k) / F.col(n)
    between = F.sum(F.when(F.col(n) > 0, F.col(n) * (p - F.col(prior)) * (p - F.col(prior))))
    within = F.sum(F.when(F.col(n) > 0, F.col(n) * F.col(prior) * (1 - F.col(prior))))
    ratio = F.coalesce(within / F.nullif(between, F.lit(0.0)), F.lit(101.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(1.0), ratio - 1))


def reputation(hosts: DataFrame, scratch: Scratch, z: float = Z) -> DataFrame:
    """(host, mean, bound) from (host, suffix, domain, n, k): n outcomes, k of them blocked."""
    hosts = scratch.put(hosts, "hosts")
    domains = scratch.put(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk")), "domains")
    suffixes = scratch.put(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk")), "suffixes")
    # One row each: the whole share (with one outcome of each kind added), and the priors' weights.
    top = suffixes.agg(((F.coalesce(F.sum("sk"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("sn"), F.lit(0)) + 2.0)).alias("p0"))
    s = suffixes.crossJoin(F.broadcast(top))
    s = s.crossJoin(F.broadcast(s.agg(_strength("sn", "sk", "p0").alias("m1"))))
    s = scratch.put(s.select("suffix", ((F.col("sk") + F.col("m1") * F.col("p0")) / (F.col("sn") + F.col("m1"))).alias("sp")), "suffix_means")
    d = domains.join(s, "suffix")
    d = d.crossJoin(F.broadcast(d.agg(_strength("dn", "dk", "sp").alias("m2"))))
    d = scratch.put(d.select("suffix", "domain", ((F.col("dk") + F.col("m2") * F.col("sp")) / (F.col("dn") + F.col("m2"))).alias("dp")), "domain_means")
    h = hosts.join(d, ["suffix", "domain"])
    h = h.crossJoin(F.broadcast(h.agg(_strength("n", "k", "dp").alias("m3"))))
    mean = (F.col("k") + F.col("m3") * F.col("dp")) / (F.col("n") + F.col("m3"))
    h = h.select("host", "n", "m3", mean.alias("mean"))
    return h.select("host", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("m3") + 1))).alias("bound"))


def filter_urls(pages: DataFrame, rules=RULES, z: float = Z, cut: float = CUT, suffixes=SUFFIXES, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked_share) for every row of pages (page_id, url, ...).

    A rule decides where one fits, the longest first; otherwise the host's reputation does. Null urls and
    urls without :// have an empty host, whose reputation is judged like any other's. Rows that
    repeat are outcomes of their own; without any labelled page everything unruled is allowed; other
    columns are ignored.
    """
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = scratch.put(rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict"), "rows")
    suffix, domain = domain_parts(F.col("host"), suffixes)
    hosts = rows.groupBy("host").agg(F.count("rule").alias("n"), F.sum((F.col("verdict") == "block").cast("long")).alias("k"))
    hosts = hosts.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", F.coalesce("k", F.lit(0)).alias("k"))
    # A stored table, so that the join below is between plain shuffles (a hot host is split) or a
    # broadcast of a size that Spark has measured.
    known = scratch.put(reputation(hosts, scratch, z), "reputation")
    return rows.join(known, "host").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bound") >= cut, "block").otherwise("allow")).alias("verdict"), F.round("mean", 6).alias("blocked_share"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("blocked_share")


def op2_sql() -> str:
    """The same in DuckDB's SQL."""
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in ordered) + " END"
    quoted = lambda names: ", ".join(f"'{x}'" for x in names)
    plain, wild, but = [r for r in SUFFIXES if r[0] not in "*!"], [r[2:] for r in SUFFIXES if r[0] == "*"], [r[1:] for r in SUFFIXES if r[0] == "!"]
    # All rules of SUFFIXES have two labels.
    two = f"NOT array_to_string(l[-2:], '.') IN ({quoted(but)}) AND (array_to_string(l[-2:], '.') IN ({quoted(plain)}) OR len(l) >= 2 AND l[-1] IN ({quoted(wild)}))"

    def strength(n, k, p):
        return f"least(100.0, greatest(1.0, coalesce(sum({n} * {p} * (1 - {p})) FILTER ({n} > 0) / nullif(sum({n} * ({k}::DOUBLE / {n} - {p}) * ({k}::DOUBLE / {n} - {p})) FILTER ({n} > 0), 0.0), 101.0) - 1))"

    return f"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {rule} AS rule FROM p),
v AS (SELECT *, {verdict} AS verdict0 FROM r),
hosts0 AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(rule) AS n, count(*) FILTER (verdict0 = 'block') AS k FROM v GROUP BY host),
parts AS (SELECT *, string_split(name, '.') AS l FROM hosts0),
hosts1 AS (SELECT *, {two} AS dbl, regexp_matches(name, '{ADDRESS}') AS address FROM parts),
hosts AS (SELECT host, n, k, CASE WHEN address THEN name ELSE array_to_string(CASE WHEN dbl THEN l[-2:] ELSE l[-1:] END, '.') END AS suffix, CASE WHEN address THEN name ELSE array_to_string(CASE WHEN dbl THEN l[-3:] ELSE l[-2:] END, '.') END AS domain FROM hosts1),
domains AS (SELECT suffix, domain, sum(n) AS dn, sum(k) AS dk FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM domains GROUP BY ALL),
top AS (SELECT (coalesce(sum(sk), 0) + 1.0)::DOUBLE / (coalesce(sum(sn), 0) + 2.0) AS p0 FROM suffixes),
s AS (SELECT * FROM suffixes, top), m1 AS (SELECT {strength('sn', 'sk', 'p0')} AS m1 FROM s),
sp AS (SELECT suffix, (sk + m1 * p0) / (sn + m1) AS sp FROM s, m1),
d AS (SELECT domains.*, sp FROM domains JOIN sp USING (suffix)), m2 AS (SELECT {strength('dn', 'dk', 'sp')} AS m2 FROM d),
dp AS (SELECT suffix, domain, (dk + m2 * sp) / (dn + m2) AS dp FROM d, m2),
hh AS (SELECT hosts.*, dp FROM hosts JOIN dp USING (suffix, domain)), m3 AS (SELECT {strength('n', 'k', 'dp')} AS m3 FROM hh),
mean AS (SELECT host, n, m3, (k + m3 * dp) / (n + m3) AS mean FROM hh, m3),
bound AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (n + m3 + 1)) AS bound FROM mean)
SELECT page_id, host, path, rule, coalesce(verdict0, CASE WHEN bound >= {CUT} THEN 'block' ELSE 'allow' END) AS verdict
FROM v JOIN bound USING (host)"""
