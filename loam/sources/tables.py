"""Tables that are changed in parts: partitions that are dropped, buckets that are replaced.

A bucketed registry is a folder of tables.  Each version writes only the buckets that it
changes, below ``<table>/version=N/bucket=B``, and then a manifest that names for
every table the version in which each bucket's live files stand.  A version is there
once its manifest is, which one rename makes; what a failed write left has none and is
written over.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import located

BUCKETS = 64


def _names(spark: SparkSession, path: str) -> list[str]:
    top, fs = located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []


def _delete(spark: SparkSession, path: str) -> None:
    target, fs = located(spark, path)
    fs.delete(target, True)


# -- partitions ------------------------------------------------------------------------


def write_partitioned(rows: DataFrame, path: str, by: str, mode: str = "errorifexists") -> None:
    """Rows in a folder for each value of ``by``; a value that holds very many rows is
    written by several tasks."""
    rows.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def partition_values(spark: SparkSession, path: str, by: str) -> list[str]:
    """The values that have a folder, as text; null is the name that Spark gives it."""
    from urllib.parse import unquote

    return [unquote(n.removeprefix(f"{by}=")) for n in _names(spark, path) if n.startswith(f"{by}=")]


def drop_partitions(spark: SparkSession, path: str, by: str, gone: Callable[[str], bool]) -> list[str]:
    """Remove the folders of the values that ``gone`` names, and say which these were.  No
    other file is read or written."""
    from urllib.parse import unquote

    dropped = []
    for name in _names(spark, path):
        value = unquote(name.removeprefix(f"{by}="))
        if name.startswith(f"{by}=") and gone(value):
            _delete(spark, f"{path}/{name}")
            dropped.append(value)
    return dropped


def drop_namespace(spark: SparkSession, path: str, namespace: str) -> bool:
    """Drop one namespace of a table partitioned by it; false if there is none."""
    return bool(drop_partitions(spark, path, "namespace", lambda v: v == namespace))


def drop_expired(spark: SparkSession, path: str, by: str, oldest: str) -> list[str]:
    """Drop the dates before ``oldest`` (ISO text) of a table partitioned by date."""
    return drop_partitions(spark, path, by, lambda v: v < oldest and v[:1].isdigit())


# -- buckets ---------------------------------------------------------------------------


def bucket_of(*key: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[str, dict[int, int]]]:
    """The number of a version, the last if none is given, and for each table the version
    that each bucket's files are of; 0 and nothing before the first."""
    if version is None:
        version = max((int(n.removesuffix(".json")) for n in _names(spark, f"{root}/_manifest") if n.endswith(".json")), default=0)
    if not version:
        return 0, {}
    text = "".join(r.value for r in spark.read.text(f"{root}/_manifest/{version}.json", wholetext=True).collect())
    return version, {t: {int(b): v for b, v in of.items()} for t, of in json.loads(text).items()}


def commit(spark: SparkSession, root: str, version: int, manifest: dict[str, dict[int, int]]) -> None:
    """Make a version the last one: its manifest is written aside and renamed."""
    aside, fs = located(spark, f"{root}/_manifest/.{version}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(aside, located(spark, f"{root}/_manifest/{version}.json")[0]):
        raise FileExistsError(f"version {version} is there already")


def read_buckets(spark: SparkSession, root: str, table: str, schema: str, live: dict[int, int], only: Iterable[int] | None = None) -> DataFrame:
    """The live rows of a table, or of some of its buckets: no other file is opened."""
    wanted = live if only is None else [b for b in only if b in live]
    paths = [f"{root}/{table}/version={live[b]}/bucket={b}" for b in sorted(wanted)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def replace_buckets(rows: DataFrame, root: str, table: str, version: int, live: dict[int, int], touched: Iterable[int]) -> dict[int, int]:
    """Write ``rows`` (with ``bucket``), all that the touched buckets hold from now on, as
    files of a version; returns where each bucket of the table lives then."""
    to = f"{root}/{table}/version={version}"
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)
    there = {int(n.removeprefix("bucket=")) for n in _names(rows.sparkSession, to) if n.startswith("bucket=")}
    kept = {b: v for b, v in live.items() if b not in set(touched)}
    return kept | {b: version for b in there}


def clean(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove what only versions before the last ``keep`` use; returns how many folders
    went.  Readers of a kept version lose nothing."""
    numbers = sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{root}/_manifest") if n.endswith(".json"))
    if not numbers:
        return 0
    kept = [read_manifest(spark, root, v)[1] for v in numbers[-keep:]]
    gone = 0
    for table in sorted({t for m in kept for t in m}):
        used = {(v, b) for m in kept for b, v in m.get(table, {}).items()}
        for name in _names(spark, f"{root}/{table}"):
            version = int(name.removeprefix("version=")) if name.startswith("version=") else numbers[-1]
            if version >= numbers[-1]:
                continue
            parts = [n for n in _names(spark, f"{root}/{table}/{name}") if n.startswith("bucket=")]
            dead = [n for n in parts if (version, int(n.removeprefix("bucket="))) not in used]
            for n in dead:
                _delete(spark, f"{root}/{table}/{name}/{n}")
            if len(dead) == len(parts):
                _delete(spark, f"{root}/{table}/{name}")
            gone += len(dead)
    for v in numbers[:-keep]:
        _delete(spark, f"{root}/_manifest/{v}.json")
    return gone
