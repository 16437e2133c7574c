"""What registered queries share: the registry, readers, pieces of SQL.

Floating results are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: white space, and the text with it collapsed, in RE2
WS = r"[\s\v]+"
SQL_COLLAPSED = rf"trim(regexp_replace({{}}, '{WS}', ' ', 'g'))"
SQL_CONTENT = (
    f"list_filter(regexp_split_to_array(lower({{}}), '[^a-z0-9]+'), lambda t: t != '' AND t NOT IN ({listed(T.CONTENT_STOP_WORDS)}))"
)


#: a fragment of HTML without tags
SQL_INNER_TEXT = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', '', 'g'), '[\\s\\v]+', ' ', 'g'))"
for _n, _ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    SQL_INNER_TEXT = f"replace({SQL_INNER_TEXT}, '{_n}', '{_ch}')"


def sql_grams(table: str, key: str) -> str:
    """``s``: the share of the commonest 4-gram of each row's ``text``."""
    return f"""WITH w AS (SELECT {key}, string_split(lower({SQL_COLLAPSED.format('text')}), ' ') AS w FROM {table}),
g AS (SELECT {key}, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS gram FROM w WHERE len(w) >= 4),
c AS (SELECT {key}, gram, count(*) AS n FROM g GROUP BY 1, 2),
s AS (SELECT {key}, max(n) / sum(n) AS share FROM c GROUP BY 1)
"""


_SQL_ERROR = " OR ".join(
    "contains(lower(left(trim(text, E' \\n\\t\\r'), 400)), '" + m.replace("'", "''") + "')" for m in T.ERROR_MARKERS
)
#: why a page's ``text`` is refused, with the share joined
SQL_GATE = f"""CASE WHEN trim(coalesce(text, ''), E' \\n\\t\\r') = '' THEN 'no_content' WHEN {_SQL_ERROR} THEN 'error_page'
  WHEN length(trim(text, E' \\n\\t\\r')) < 200 THEN 'too_small' WHEN share >= 0.08 THEN 'boilerplate_heavy' END"""


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream, by the files that Spark lists for it."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    base, glob = (path, None) if spark.read.parquet(path).inputFiles()[0].count(f"{name}.parquet/") else (d, f"{name}.parquet")
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(base)
