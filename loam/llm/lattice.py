"""Embedding near-duplicates by lattice hashing.

A table is a random orthonormal projection to a few blocks of eight dimensions, each
decoded to its nearest E8 lattice point; the points of all blocks name a cell.  A vector
lies in its own cell and probes the neighbouring cells that are next nearest.  Vectors
that meet in a cell, one of them in its own, are verified by cosine in double precision.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, least_labels, map_batches, map_groups, mix, powers, written

TABLES, BLOCKS, PROBES, SCALE = 6, 2, 4, 4.0
#: vectors of one cell that are compared in one piece
CHUNK = 1024


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two of +-1, or all +-1/2 with an even number of minuses."""
    pairs = np.zeros((112, 8))
    for row, ((i, j), (u, v)) in zip(
        pairs, itertools.product(itertools.combinations(range(8), 2), itertools.product((1, -1), repeat=2))
    ):
        row[i], row[j] = u, v
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate((pairs, halves[(halves < 0).sum(axis=1) % 2 == 0]))


_NEAR = minimal_vectors()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: where rounding gives an odd one, the
    coordinate that was rounded furthest goes the other way."""
    r = np.rint(x)
    off = x - r
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    r[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 together with D8 shifted by one half in every coordinate."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def cells(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the own cell (vector, table) and of probed cells (vector, table, probe)
    of unit vectors; a cell belongs to one label, dimension and table."""
    n, dim = x.shape
    blocks = max(1, min(BLOCKS, dim // 8))
    own = np.zeros((n, TABLES), np.uint64)
    probed = np.zeros((n, TABLES, PROBES), np.uint64)
    salt = mix(labels.astype(np.int64).view(np.uint64) ^ mix(np.array([dim], np.uint64)))
    scales = powers(0xD1342543DE82EF95, 8 * blocks + 1)[1:]
    for t in range(TABLES):
        rng = np.random.default_rng(1000 * t + dim)
        base = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : 8 * blocks]
        y = x @ base * SCALE * np.sqrt(dim / 64)
        if dim < 8:
            y = np.concatenate((y, np.zeros((n, 8 - dim))), axis=1)
        points = [nearest_e8(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)]
        gains = np.concatenate([(y[:, 8 * b : 8 * b + 8] - p) @ _NEAR.T for b, p in enumerate(points)], axis=1)
        best = np.argpartition(-gains, PROBES, axis=1)[:, :PROBES]
        twice = np.rint(2 * np.concatenate(points, axis=1)).astype(np.int64)

        def name(point: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                total = (point.view(np.uint64) * scales).sum(axis=1, dtype=np.uint64)
                return mix(total + salt + np.uint64(t))

        own[:, t] = name(twice)
        for k in range(PROBES):
            moved = twice.copy()
            rows = np.arange(n)
            for c in range(8):
                moved[rows, best[:, k] // 240 * 8 + c] += np.rint(2 * _NEAR[best[:, k] % 240, c]).astype(np.int64)
            probed[:, t, k] = name(moved)
    return own, probed


def _stack(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vectors`` (vec_id, embedding, label; others are ignored) to ``vec_id``,
    ``n_links``, ``component_id`` and ``kept``, one row per row.

    Only vectors of one label and one dimension are compared.  A null label, a null,
    empty or zero vector, and one with null or non-finite components links with nothing
    and is its own component.  Equal vectors are one node with a count, so that copies
    cost nothing; repeated rows and ids count as vectors of their own.  A null vec_id
    links like any other, and a component's id is its smallest id that is not null.
    Pairs below ``cosine`` are never linked; pairs above are found by shared cells.
    """

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"vec_id": batch["vec_id"], "label": batch["label"], "vector": [], "sig": []}
            for v, label in zip(batch["embedding"], batch["label"]):
                x = None if v is None or label is None or None in v or not v else np.array(v, "<f8")
                if x is not None and not (np.isfinite(x).all() and 0 < x @ x < np.inf):
                    x = None
                out["vector"].append(None if x is None else x.tobytes())
                key = None if x is None else hashlib.blake2b(x.tobytes() + str(label).encode(), digest_size=16).digest()
                out["sig"].append(key)
            yield out

    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("long").alias("label"),
    )
    rows = written(map_batches(rows, read, "vec_id long, label long, vector binary, sig binary"), "vectors")
    nodes = rows.where("sig IS NOT NULL").groupBy("sig").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector"),
        F.first("label").alias("label"),
    )
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def places(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            dims = np.array([len(v) for v in batch["vector"]])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _stack([batch["vector"][i] for i in at])
                own, probed = cells(x / np.linalg.norm(x, axis=1)[:, None], np.array([batch["label"][i] for i in at]))
                node = np.array([batch["node"][i] for i in at], np.int64)
                for t in range(TABLES):
                    cell = np.concatenate((own[:, t, None], probed[:, t]), axis=1).astype(np.uint64)
                    yield {
                        "cell": cell.view(np.int64).ravel().tolist(),
                        "tab": [t] * cell.size,
                        "node": np.repeat(node, 1 + PROBES).tolist(),
                        "own": ([True] + [False] * PROBES) * len(at),
                    }

    placed = map_batches(nodes.select("node", "vector", "label"), places, "cell long, tab int, node long, own boolean")
    shared = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("own").alias("owned")
    ).where("n > 1 AND owned").select("cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    shared = written(shared, "cells")
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = (
        placed.join(shared, "cell")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "cell", "tab", "node", "own", "mine",
            F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        )
        .join(nodes.select("node", "vector", "label", "copies"), "node")
    )

    def verify(group: dict) -> dict:
        x = _stack(group["vector"])
        size = np.linalg.norm(x, axis=1)
        node, own = np.array(group["node"], np.int64), np.array(group["own"])
        copies, mine = np.array(group["copies"], np.int64), np.array(group["mine"])
        link = x @ x.T / (size[:, None] * size) >= cosine
        link &= (own[:, None] | own) & (node[:, None] != node)
        if group["i"][0] != group["j"][0]:
            link &= mine[:, None] != mine
        # a pair counts in the first table, and there in the first cell, where it meets
        a, b = np.nonzero(np.triu(link))
        out = np.zeros(len(node), np.int64)
        if len(a):
            t, cell = group["tab"][0], np.array(group["cell"][:1], np.int64).view(np.uint64)[0]
            homes, probed = cells(x / size[:, None], np.array(group["label"]))
            for s in range(t):
                met = homes[a, s] == homes[b, s]
                for k in range(PROBES):
                    met |= (probed[a, s, k] == homes[b, s]) | (probed[b, s, k] == homes[a, s])
                a, b = a[~met], b[~met]
            both = (probed[a, t] == homes[b, t, None]).any(axis=1) & (probed[b, t] == homes[a, t, None]).any(axis=1)
            first = ~both | (homes[a, t] == homes[b, t]) | (np.minimum(homes[a, t], homes[b, t]) == cell)
            a, b = a[first], b[first]
            out += np.bincount(a, copies[b], len(node)).astype(np.int64) + np.bincount(b, copies[a], len(node)).astype(np.int64)
        label = least_labels(link)
        some = np.flatnonzero((out > 0) | (label != np.arange(len(node))))
        return {
            "node": node[some].tolist(),
            "links": out[some].tolist(),
            "to": node[label[some]].tolist(),
        }

    found = written(map_groups(dealt, ["cell", "i", "j"], verify, "node long, links long, to long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = written(connected_components(found.select(F.col("node").alias("a"), F.col("to").alias("b"))), "reached")
    low = written(
        reached.join(nodes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least")), "low"
    )
    known = written(
        nodes.select("sig", "node", "low", "copies")
        .join(links, "node", "left")
        .join(reached, "node", "left")
        .join(low, "component", "left")
        .select(
            "sig",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("least", "low").alias("component_id"),
        ),
        "known",
    )
    return (
        rows.select("vec_id", "sig")
        .join(known, "sig", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
