"""An inverted-file index of unit vectors: cells around centres, a folder for each cell.

The centres are fitted by k-means on a bounded sample of the units (parameter ``sample``); every
unit is written to the folder of its nearest centre, together with what bounds the
cell: how far its furthest unit lies from the centre.  A search reads the cells nearest to
its queries, and no other folder.  With ``exact`` a second pass reads every cell
that may still hold a better unit: no inner product of a query ``q`` with a unit of a
cell is greater than ``q.c + |q| r``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..sources.tables import write_partitioned
from ..storage import scratch_dir

#: units that the centres are fitted on at most, and rounds of the fit
SAMPLE, ROUNDS = 4096, 10
#: queries that are compared at once at most, and numbers in their vectors
QUERY_ROWS, QUERY_NUMBERS = 10_000, 4_000_000


@dataclass
class Index:
    """Where an index is, the type of its unit ids, and its cells: ``centres`` (cell,
    dimension), ``radius`` and ``size``.  All of fixed size, whatever the units are."""

    path: str
    id_type: str
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def fit_centres(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres of ``x`` by k-means, begun with rows that lie far from one another."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    away = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(cells, len(x)) and away.max() > 0:
        centres.append(x[rng.choice(len(x), p=away / away.sum())])
        away = np.minimum(away, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        mine = _nearest(x, c)
        n = np.bincount(mine, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, mine, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def build_index(units: DataFrame, path: str, cells: int = 64, sample: int = SAMPLE) -> Index:
    """Write an index of ``units`` (unit_id, embedding, others are kept) to ``path``.

    Vectors have one length; units without a vector are left out, and no units give an empty index.
    The sample is the same for the same rows: the units with the least hashes.
    """
    spark = units.sparkSession
    rows = units.where("embedding IS NOT NULL AND size(embedding) > 0")
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    chosen = rows.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).collect()
    id_type = rows.schema["unit_id"].dataType.simpleString()
    if not chosen:
        return Index(path, id_type, np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64))
    centres = fit_centres(np.array([r.embedding for r in chosen], float), cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("embedding"))
            cell = _nearest(x, centres)
            away = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(away), pa.array(cell, pa.int32())], names=[*b.schema.names, "away", "cell"]
            )

    schema = StructType([*rows.schema.fields, StructField("away", DoubleType()), StructField("cell", IntegerType())])
    write_partitioned(rows.mapInArrow(place, schema), path, "cell")
    radius, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in spark.read.parquet(path).groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():
        radius[r.cell], size[r.cell] = r.r, r.n
    return Index(path, id_type, centres, radius, size)


def cells_read(index: Index, spark: SparkSession, cells: list[int]) -> DataFrame:
    """The units of some cells; the scan lists their folders alone."""
    return spark.read.parquet(index.path).where(F.col("cell").isin([int(c) for c in cells]))


def _compared(units: DataFrame, asked: np.ndarray, q: np.ndarray, k: int, same: list | None, id_type: str) -> DataFrame:
    """The best ``k`` units of each query in every batch of ``units``.  ``asked`` (cell, query)
    tells which cells a query looks at; with ``same``, ids that the queries must not find."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, cell = _matrix(b.column("embedding")), b.column("cell").to_numpy()
            ids = b.column("unit_id").to_pylist()
            place = {v: i for i, v in enumerate(ids)}
            who, what, value = [], [], []
            for c in np.unique(cell).tolist():
                mine, of = np.flatnonzero(asked[c]), np.flatnonzero(cell == c)
                if not len(mine):
                    continue
                s = q[mine] @ x[of].T
                if same is not None:
                    at = {int(j): i for i, j in enumerate(of)}
                    for i, m in enumerate(mine.tolist()):
                        j = at.get(place.get(same[m], -1))
                        if j is not None:
                            s[i, j] = -np.inf
                # ties at the edge all stay: the unit id decides later
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]] if s.shape[1] > k else -np.inf
                i, j = np.nonzero((s >= kth) & np.isfinite(s))
                who.append(mine[i])
                what.append(of[j])
                value.append(s[i, j])
            if who:
                at = np.concatenate(what)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(who).astype(np.int32)), b.column("unit_id").take(pa.array(at)), pa.array(np.concatenate(value))],
                    names=["query", "unit_id", "score"],
                )

    return units.select("unit_id", "embedding", "cell").mapInArrow(score, f"query int, unit_id {id_type}, score double")


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, not_self: bool = False) -> DataFrame:
    """The ``k`` units with the greatest inner products for each of ``queries`` (query_id, embedding), ties by
    unit id: ``query_id``, ``unit_id``, ``score``, ``rank``.

    Each query looks at the ``probes`` cells with the greatest bounds; with ``exact`` it also looks at those whose
    bound reaches its kth score, and misses nothing.  With ``not_self`` a query does not find
    the unit of its own id.  The queries are compared in blocks of bounded size, one after the
    other, each with the units of its cells wherever these lie; what a block found is written.
    """
    spark = queries.sparkSession
    to = f"{scratch_dir(spark)}/index-hits-{uuid.uuid4().hex}"
    query_type = queries.schema["query_id"].dataType.simpleString()
    asked_for = queries.where("embedding IS NOT NULL AND size(embedding) > 0").select("query_id", "embedding")
    n = asked_for.count()
    dim = max(1, index.centres.shape[1])
    blocks = max(1, -(-n // min(QUERY_ROWS, max(1, QUERY_NUMBERS // dim))))
    schema = f"query_id {query_type}, unit_id {index.id_type}, score double, rank int"
    if not n or not len(index.centres):
        return spark.createDataFrame([], schema)
    for block in range(blocks):
        mine = asked_for.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if mine:
            _search_block(index, spark, mine, k, probes, exact, not_self, query_type).write.mode("append").parquet(to)
    return spark.read.schema(schema).parquet(to)


def _search_block(index: Index, spark: SparkSession, mine: list, k: int, probes: int, exact: bool, not_self: bool, query_type: str) -> DataFrame:
    q = np.array([r.embedding for r in mine], float)
    same = [r.query_id for r in mine] if not_self else None
    bound = q @ index.centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * index.radius
    bound[:, index.size == 0] = -np.inf
    order = np.argsort(-bound, axis=1, kind="stable")[:, :probes]
    asked = np.zeros((len(index.centres), len(q)), bool)
    asked[order.ravel(), np.repeat(np.arange(len(q)), order.shape[1])] = True
    asked[index.size == 0] = False

    def look(which: np.ndarray) -> DataFrame:
        cells = np.flatnonzero(which.any(axis=1)).tolist()
        return _compared(cells_read(index, spark, cells), which, q, k, same, index.id_type)

    w = Window.partitionBy("query").orderBy(F.desc("score"), "unit_id")
    hits = look(asked).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if exact:
        hits = hits.persist()
        kth = np.full(len(q), -np.inf)
        for r in hits.where(F.col("rank") == k).select("query", "score").collect():  # a number for each query of the block
            kth[r.query] = r.score
        slack = 1e-9 * (1 + np.abs(kth))
        more = (bound.T >= kth - slack) & ~asked & (index.size > 0)[:, None]
        if more.any():
            both = hits.select("query", "unit_id", "score").unionByName(look(more))
            hits = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(mine)], f"query int, query_id {query_type}")
    return hits.join(F.broadcast(names), "query").select("query_id", "unit_id", "score", F.col("rank").cast("int").alias("rank"))
