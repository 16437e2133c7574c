"""Embedding whitening with a weighted covariance of distinct vectors.

Embeddings become integer vectors.  Equal ones are one row with a count, and all that follows
is done once for each distinct vector: exact sums, the covariance as a product of centred,
weighted blocks, one matrix per task and sum over tasks, and the projection on
its eigenvectors.  The rows then take their values by a join, in which a vector that very many
rows share is one skewed key of one side.

Only matrices of the dimensions reach the driver, whose size has nothing to do with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

#: entries become floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000

#: eigenvalues under this share of the greatest one, for each dimension, are taken for zero
ZERO = 1e-13

#: integers a double holds exactly
EXACT = 1 << 53


def _quantised(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        out: dict = {"vec_id": [], "vector": []}
        for i, v in zip(batch["vec_id"], batch["embedding"]):
            if not v or None in v:
                continue
            x = np.floor(np.array(v, "<f8") * SCALE)
            # not finite, or beyond what is exact
            if (np.abs(x) < EXACT).all():
                out["vec_id"].append(i)
                out["vector"].append((x.astype("<i8") + SHIFT).tobytes())
        yield out


def _blocks(batch: dict):
    """Positions of the rows of a batch, and their vectors as a matrix, by dimension."""
    size = np.array([len(v) // 8 for v in batch["vector"]])
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, np.frombuffer(b"".join(batch["vector"][i] for i in at), "<i8").reshape(len(at), d)


def _scaled(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n * x - total`` without rounding: as long where nothing can overflow, else as
    whole numbers of any size."""
    most = max(n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))), max(map(abs, total)))
    if most < 1 << 61:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def _sums(df: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each dimension the weight of all vectors and the sum of each entry, exact."""

    def add(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = np.array(batch["weight"], np.int64)
            for d, at, x in _blocks(batch):
                w, n = weight[at], int(weight[at].sum())
                y = x - SHIFT
                if int(np.abs(y).max()) * n >= 1 << 61:
                    y, w = y.astype(object), w.astype(object)
                total[d] = total.get(d, 0) + np.append((w @ y).astype(object) + n * SHIFT, n)
        rows = [(d, j, str(v)) for d, s in total.items() for j, v in enumerate(s.tolist())]
        yield dict(zip(("dim", "j", "v"), map(list, zip(*rows)))) if rows else {"dim": [], "j": [], "v": []}

    parts = map_batches(df, add, "dim int, j int, v string")
    sums: dict[int, list[int]] = {}
    for r in parts.groupBy("dim", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        sums.setdefault(r.dim, [0] * (r.dim + 1))[r.j] = int(r.v)
    return {d: (s[-1], s[:-1]) for d, s in sums.items()}


def _products(df: DataFrame, centred) -> dict[int, np.ndarray]:
    """For each dimension the weighted sum of the products of all pairs of entries of what
    ``centred`` makes of a batch: triples of a dimension, rows and their weights."""

    def multiply(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, y, weight in centred(batch):
                total[d] = total.get(d, 0) + y.T @ (weight[:, None] * y)
        yield {
            "dim": [d for d, m in total.items() for _ in m.ravel()],
            "at": [i for m in total.values() for i in range(m.size)],
            "v": [x for m in total.values() for x in m.ravel().tolist()],
        }

    parts = map_batches(df, multiply, "dim int, at int, v double")
    found: dict[int, list] = {}
    for r in parts.groupBy("dim", "at").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.dim, []).append((r.at, r.v))
    out = {}
    for d, cells in found.items():
        flat = np.array([v for _, v in sorted(cells)])
        side = int(round(len(flat) ** 0.5))
        out[d] = flat.reshape(side, side)
    return out


def whiten(vectors: DataFrame, components: int = 32, weights: str = "counts") -> DataFrame:
    """``vectors`` (vec_id, embedding; others are ignored) to one row per row and component:
    ``vec_id``, ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``.

    The fit counts a distinct vector as often as it occurs (``counts``) or once (``one``);
    ``n`` is the number of vectors of the fit.  ``deviation`` is the squared distance of ``n``
    times the vector from the sum of all, exact, and null where a long can't hold it.

    Rows without a vector, with an empty one, and with entries that are null, not finite or
    beyond 2^53 once scaled are dropped.  Vectors of each length are fitted by themselves.
    Components without variance, as all of a single vector, have no rows.  Null ids and
    repeated rows are rows like others; no rows give no rows.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights has to be counts or one")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(map_batches(rows, _quantised, "vec_id long, vector binary"), "quantised")
    counted = F.count("*") if weights == "counts" else F.lit(1).cast("long")
    distinct = written(rows.groupBy("vector").agg(counted.alias("weight")), "distinct")
    sums = _sums(distinct)

    def centred(batch: dict):
        weight = np.array(batch["weight"], float)
        for d, at, x in _blocks(batch):
            n, total = sums[d]
            yield d, (_scaled(x, n, total) / n).astype(float), weight[at]

    fits = {}
    for d, v in _products(distinct, centred).items():
        v = (v + v.T) / 2 / sums[d][0]
        e, u = np.linalg.eigh(v)
        order = np.argsort(-e, kind="stable")[:components]
        order = order[e[order] > ZERO * d * max(e.max(), 0)]
        fits[d] = u[:, order] / np.sqrt(e[order]), (e[order] / np.trace(v)).tolist()

    def project(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"vector": [], "weight": [], "dim": [], "deviation": [], "whitened": []}
            for d, at, x in _blocks(batch):
                n, total = sums[d]
                y = _scaled(x, n, total)
                big = y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * d >= 2.0**62
                square = (y.astype(object) if big else y) ** 2
                deviation = square.sum(axis=1).tolist()
                out["vector"] += [batch["vector"][i] for i in at]
                out["weight"] += [batch["weight"][i] for i in at]
                out["dim"] += [d] * len(at)
                out["deviation"] += [s if s < 1 << 63 else None for s in deviation]
                out["whitened"] += ((y / n).astype(float) @ fits[d][0]).tolist()
            yield out

    done = map_batches(distinct, project, "vector binary, weight long, dim int, deviation long, whitened array<double>")
    done = written(done, "whitened")

    def places(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, y, w in white(batch):
                total[d] = total.get(d, 0) + w @ y
        rows = [(d, j, v) for d, s in total.items() for j, v in enumerate(s.tolist())]
        yield dict(zip(("dim", "j", "v"), map(list, zip(*rows)))) if rows else {"dim": [], "j": [], "v": []}

    def white(batch: dict):
        dim, weight = np.array(batch["dim"]), np.array(batch["weight"], float)
        for d in np.unique(dim).tolist():
            at = np.flatnonzero(dim == d)
            yield d, np.array([batch["whitened"][i] for i in at]).reshape(len(at), fits[d][0].shape[1]), weight[at]

    white_rows = done.select("dim", "weight", "whitened")
    mean: dict[int, np.ndarray] = {d: np.zeros(f[0].shape[1]) for d, f in fits.items()}
    for r in map_batches(white_rows, places, "dim int, j int, v double").groupBy("dim", "j").agg(F.sum("v").alias("v")).collect():
        mean[r.dim][r.j] = r.v / sums[r.dim][0]
    spread = _products(white_rows, lambda batch: ((d, y - mean[d], w) for d, y, w in white(batch)))
    error = {d: float(np.abs(m / sums[d][0] - np.eye(len(m))).max(initial=0)) for d, m in spread.items()}

    # a few numbers for each length of vectors
    facts = [(d, sums[d][0], fits[d][1], error.get(d, 0.0)) for d in fits]
    known = vectors.sparkSession.createDataFrame(facts, "dim int, n long, explained array<double>, identity_error double")
    out = rows.join(done.drop("weight"), "vector").join(F.broadcast(known), "dim")
    return out.select(
        "vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", "at").alias("explained"), "identity_error",
    )
