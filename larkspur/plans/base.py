"""Tables, dictionaries and SQL shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import TOKEN
from ..sources.readers import spread

#: Dictionaries for the driver's tables, whose texts are invented words; parameters of the operators.
KEYWORDS = {"service": ("tion", "queu"), "price": ("nd", "ch"), "food": ("ou", "er")}
POSITIVE = {"service": (("tion", "station", "thtion"), ("ention",)), "price": (("and", "und"), ("nd th", "ch d"))}
HINTS = {"price": ("nd the", "ieu"), "service": ("tion", "ung"), "food": ("ou", "ci")}


def prepare(spark) -> None:
    """The one setting that these plans need: adaptive execution may coalesce the sides of a union
    differently, and with union partitioning on, Spark 4.1 would still fail to zip its sides."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are taken apart row by row."""
    return spread(table(spark, sf_dir, name))


def sql_tokens(text: str = "text", n: int = 2) -> str:
    return f"list_filter(regexp_extract_all(coalesce({text}, ''), '{TOKEN}'), lambda x: length(x) >= {n})"


def sql_any(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")" if needles else "false"


def sql_bigrams(by: str = "") -> str:
    """CTEs w, g (counts) of the neighbouring pairs of documents."""
    head = f"{by}, " if by else ""
    return f"""w AS (SELECT {head}{sql_tokens("trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))")} AS t FROM documents),
b AS (SELECT {head}unnest(list_zip(t[1:len(t)-1], t[2:])) AS p FROM w WHERE len(t) > 1),
g AS (SELECT {head}p[1] || ' ' || p[2] AS phrase, count(*) AS cnt FROM b WHERE p[1] <> p[2] GROUP BY ALL)"""


def sql_positive(name: str, column: str = "phrase") -> str:
    whole, part = POSITIVE[name]
    w = ", ".join(f"'{x}'" for x in whole)
    return f"(len(list_intersect(string_split({column}, ' '), [{w}])) > 0 OR {sql_any(column, part)})"
