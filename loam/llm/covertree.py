"""Exact top-k search by inner product: two cover trees, walked together.

Vectors become integer vectors, and equal ones are one point with its smallest ids.  Points are
dealt to cells around centres that a bounded sample gives (a net: every centre is further than
a radius from the others), cells to blocks of bounded size, and each block is built into
a cover tree: nodes are contiguous ranges of points around a point of theirs, and the children of
a node cover its points by smaller radii.  The tree holds queries and data alike.

No score of a query in a node around ``a`` with covering radius ``r`` and a point in one around ``b``
with ``s`` is greater than ``a.b + r |b| + s |a| + r s``.  A block's queries search their
own block first, which gives each its worst kth score so far.  A pair of a block's queries
and another block is left out where the bound lies under the worst of these scores, first for
whole cells, then for blocks, then for nodes.  What remains is compared, so the result is exact
whatever the sample was; where vectors point everywhere, nothing can be pruned and all
blocks are compared, as products of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, map_groups, written

#: entries become floor(SCALE * c)
SCALE = 256
#: points of the sample, centres taken from it at most, points of a block on average
SAMPLE, CELLS, BLOCK = 1000, 64, 2048
#: a node's children cover it by radii smaller by this factor; smaller nodes are leaves
BASE, LEAF = 1.5, 32
#: what rounding may add to a bound, as a share of the norms
SLACK = 1e-9


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def net(x: np.ndarray, most: int) -> np.ndarray:
    """Places of at most ``most`` rows of ``x``, each the furthest from those before it."""
    out, far = [0], _norm(x - x[0])
    while len(out) < min(most, len(x)) and far.max() > 0:
        out.append(int(far.argmax()))
        far = np.minimum(far, _norm(x - x[out[-1]]))
    return np.array(out)


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows of ``x`` and nodes over it: ``begin, end, centre, first child, last
    child + 1`` (places in the order; a leaf has no children) and each node's covering radius."""
    order = np.arange(len(x))
    todo, nodes, radii = [(0, len(x))], [], []
    at = 0
    while at < len(todo):
        lo, hi = todo[at]
        mine = order[lo:hi]
        centre = x[mine[0]]
        away = _norm(x[mine] - centre)
        radius = float(away.max())
        first = last = len(todo)
        if hi - lo > LEAF and radius > 0:
            scale, parts, rest = radius / BASE, [mine[away <= radius / BASE]], mine[away > radius / BASE]
            far = away[away > radius / BASE]
            while len(rest):
                k = far.argmax()
                d = _norm(x[rest] - x[rest[k]])
                near = d <= scale
                near[k] = True
                d[k] = -1.0
                inside = rest[near]
                parts.append(inside[np.argsort(d[near], kind="stable")])
                far = np.minimum(far, np.where(np.arange(len(d)) == k, 0, d))[~near]
                rest = rest[~near]
                if len(parts) >= 8 and hi - lo - len(rest) < 4 * len(parts):
                    break  # they lie alone: a tree of single points saves nothing
            if not len(rest) and len(parts) > 1:
                order[lo:hi] = np.concatenate(parts)
                ends = lo + np.cumsum([len(p) for p in parts])
                todo += zip([lo, *ends[:-1].tolist()], ends.tolist())
                last = len(todo)
        nodes.append((lo, hi, lo, first, last))
        radii.append(radius)
        at += 1
    return order, np.array(nodes, np.int64), np.array(radii)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors: by doubles where those are exact."""
    if float(np.sqrt((a.astype(float) ** 2).sum(axis=1).max() * (b.astype(float) ** 2).sum(axis=1).max())) < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def search(
    q: np.ndarray, q_nodes: np.ndarray, q_radii: np.ndarray, worst: np.ndarray,
    x: np.ndarray, nodes: np.ndarray, radii: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For queries ``q`` and points ``x`` in the order of their trees: query, point and score of
    all pairs that may be among the ``k`` best of the query, whose kth score so far is ``worst``
    (double; minus infinity where unknown).  Nodes of both trees are visited in pairs."""
    worst = worst.copy()
    centre_q, centre_x = q[q_nodes[:, 2]].astype(float), x[nodes[:, 2]].astype(float)
    size_q, size_x = _norm(centre_q), _norm(centre_x)

    def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = q_radii[a] * size_x[b] + radii[b] * size_q[a] + q_radii[a] * radii[b]
        exact = (centre_q[a] * centre_x[b]).sum(axis=1)
        return exact + apart + SLACK * (size_q[a] + q_radii[a]) * (size_x[b] + radii[b]) + SLACK

    def least(a: np.ndarray) -> np.ndarray:
        return np.array([worst[q_nodes[i, 0] : q_nodes[i, 1]].min() for i in range(len(q_nodes))])[a]

    leaf_q, leaf_x = q_nodes[:, 3] == q_nodes[:, 4], nodes[:, 3] == nodes[:, 4]
    a, b, pairs = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(a):
        keep = bound(a, b) >= least(a)
        a, b = a[keep], b[keep]
        done = leaf_q[a] & leaf_x[b]
        pairs.append((a[done], b[done]))
        a, b = a[~done], b[~done]
        # the node with the greater radius is opened, or the one that can be
        open_q = ~leaf_q[a] & (leaf_x[b] | (q_radii[a] > radii[b]))
        lo = np.where(open_q, q_nodes[a, 3], nodes[b, 3])
        hi = np.where(open_q, q_nodes[a, 4], nodes[b, 4])
        count = hi - lo
        child = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        side = np.repeat(open_q, count)
        a, b = np.where(side, child, np.repeat(a, count)), np.where(side, np.repeat(b, count), child)
    a, b = (np.concatenate(v) for v in zip(*pairs))
    out = []
    for i in np.unique(a).tolist():
        mine = b[a == i]
        top = bound(np.full(len(mine), i), mine)
        order = np.argsort(-top, kind="stable")
        mine, top = mine[order], top[order]
        lo, hi = q_nodes[i, 0], q_nodes[i, 1]
        # the most promising leaves first, then those that still can reach the worst score
        for part in (slice(0, max(1, len(mine) // 8)), slice(max(1, len(mine) // 8), None)):
            leaves = mine[part][top[part] >= worst[lo:hi].min()]
            if not len(leaves):
                continue
            rows = np.concatenate([np.arange(nodes[n, 0], nodes[n, 1]) for n in leaves])
            score = _products(q[lo:hi], x[rows])
            if len(rows) > k:
                kth = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k]
                worst[lo:hi] = np.maximum(worst[lo:hi], kth)
            who, what = np.nonzero(score >= worst[lo:hi, None])
            out.append((who + lo, rows[what], score[who, what]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(v) for v in zip(*out))


def _best(query: np.ndarray, point: np.ndarray, score: np.ndarray, ids: list, k: int):
    """The ``k`` best entries of each query: (query, score, id, point), greatest score first, then
    smallest id, null ids last.  A point has an entry for each of its ids."""
    count = np.array([len(v) for v in ids], np.int64)
    flat = np.array([np.iinfo(np.int64).max if v is None else v for one in ids for v in one], np.int64)
    null = np.array([v is None for one in ids for v in one], bool)
    begin = np.cumsum(count) - count
    n = count[point]
    at = np.repeat(begin[point] - np.cumsum(n) + n, n) + np.arange(n.sum())
    query, point, score = np.repeat(query, n), np.repeat(point, n), np.repeat(score, n)
    order = np.lexsort((null[at], flat[at], -score, query))
    query, point, score, at = query[order], point[order], score[order], at[order]
    new = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
    keep = rank < k
    return query[keep], score[keep], [None if null[i] else int(flat[i]) for i in at[keep]], point[keep]


def _quantised(every: int):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"vec_id": [], "vector": [], "asks": []}
            for i, v in zip(batch["vec_id"], batch["embedding"]):
                if not v or None in v:
                    continue
                x = np.floor(np.array(v, "<f8") * SCALE)
                # not finite, or with scores beyond a long
                if not (x @ x < 2.0**62):
                    continue
                for name, value in zip(out, (i, x.astype("<i8").tobytes(), i is not None and i % every == 0)):
                    out[name].append(value)
            yield out

    return run


def _matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(-1, dim)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``vectors`` (vec_id, embedding; others are ignored) to ``query_id``, ``rank`` (from 1),
    ``vec_id`` and ``score``: of each row whose id is divisible by ``every`` the ``k`` other rows
    with the greatest inner products of the integer vectors, of equal scores the smallest
    ids, null ids last; all others where there are fewer.

    Only vectors of one length are compared.  Rows without a vector, with an empty one, with
    entries that are null or not finite, and those whose squared length is 2^62 or more
    take no part.  A null id asks nothing but is found.  Repeated rows and ids are rows of their
    own: each asks, and finds the others.  No rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = map_batches(rows, _quantised(every), "vec_id long, vector binary, asks boolean")
    rows = written(rows, "quantised")
    # of equal vectors no more than k + 1 rows can be in a result, the query among them
    by_id = Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last())
    firsts = rows.select("vector", "vec_id").withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    asking = rows.where("asks").select("vector").distinct().withColumn("asks", F.lit(True))
    points = firsts.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id"))).alias("ids"))
    points = points.join(asking, "vector", "left").select(
        F.monotonically_increasing_id().alias("point"),
        "vector",
        (F.length("vector") / 8).cast("int").alias("dim"),
        F.col("ids.vec_id").alias("ids"),
        F.coalesce("asks", F.lit(False)).alias("asks"),
    )
    points = written(points, "points")

    # the top of the tree, of a sample of each length of vectors that is fixed by their hashes
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("vector"))
    sample = points.select("dim", "vector").withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= SAMPLE)
    centres: dict[int, np.ndarray] = {}
    for r in sample.groupBy("dim").agg(F.array_sort(F.collect_list("vector")).alias("v")).collect():
        x = _matrix(b"".join(r.v), r.dim).astype(float)
        centres[r.dim] = x[net(x, CELLS)]

    def deal(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            cell = np.zeros(len(batch["dim"]), np.int64)
            dims = np.array(batch["dim"])
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = _matrix(b"".join(batch["vector"][i] for i in at), d).astype(float)
                c = centres[d]
                cell[at] = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            yield batch | {"cell": cell.tolist()}

    dealt = map_batches(points, deal, "point long, vector binary, dim int, ids array<long>, asks boolean, cell int")
    dealt = written(dealt, "dealt")
    sizes = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = dealt.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))

    def build(group: dict) -> dict:
        dim = group["dim"][0]
        x = _matrix(b"".join(group["vector"]), dim)
        order, nodes, radii = cover_tree(x.astype(float))
        x = x[order]
        asks = np.flatnonzero(np.array(group["asks"])[order])
        ids = [group["ids"][i] for i in order.tolist()]
        # the queries' tree: each node has the queries among its points
        begin, end = np.searchsorted(asks, nodes[:, 0]), np.searchsorted(asks, nodes[:, 1])
        q = x[asks]
        point = [group["point"][order[i]] for i in asks.tolist()]
        q_nodes, q_radii = np.zeros((0, 5), np.int64), np.zeros(0)
        worst, found = np.zeros(0), {"query": [], "score": [], "vec_id": [], "point": []}
        if len(asks):
            q_nodes, q_radii = _part_of(nodes, begin, end, q)
            a, b, s = search(q, q_nodes, q_radii, np.full(len(q), -np.inf), x, nodes, radii, k + 1)
            a, s, v, b = _best(a, b, s, ids, k + 1)
            number = np.bincount(a, minlength=len(q))
            worst = np.full(len(q), -np.inf)
            np.minimum.at(lowest := np.full(len(q), np.inf), a, s.astype(float))
            worst[number > k] = lowest[number > k]
            found = {
                "query": [point[i] for i in a.tolist()], "score": s.tolist(), "vec_id": v,
                "point": [group["point"][order[i]] for i in b.tolist()],
            }
        return {
            "dim": [dim], "cell": [group["cell"][0]], "part": [group["part"][0]],
            "centre": [x[0].tolist()], "radius": [float(radii[0])],
            "points": [x.tobytes()], "ids": [ids], "names": [[group["point"][i] for i in order.tolist()]],
            "nodes": [nodes.tobytes()], "radii": [radii.tobytes()],
            "queries": [q.tobytes()], "query_names": [point], "q_nodes": [q_nodes.tobytes()], "q_radii": [q_radii.tobytes()],
            "q_centre": [q[q_nodes[0, 2]].tolist() if len(q) else None], "q_radius": [float(q_radii[0]) if len(q) else None],
            "worst": [worst.tolist()],
            "found": [[dict(zip(found, r)) for r in zip(*found.values())]],
        }

    schema = (
        "dim int, cell int, part int, centre array<long>, radius double, points binary, ids array<array<long>>, names array<long>, "
        "nodes binary, radii binary, queries binary, query_names array<long>, q_nodes binary, q_radii binary, "
        "q_centre array<long>, q_radius double, worst array<double>, "
        "found array<struct<query: long, score: long, vec_id: long, point: long>>"
    )
    blocks = map_groups(dealt.drop("parts"), ["dim", "cell", "part"], build, schema)
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")

    # a cell's bound is that of the furthest of its blocks' points from its centre
    reach: dict[int, dict[int, list]] = {}
    spread = map_batches(blocks.select("dim", "cell", "centre", "radius"), _around(centres), "dim int, cell int, away double")
    for r in spread.groupBy("dim", "cell").agg(F.max("away").alias("away")).collect():
        reach.setdefault(r.dim, {})[r.cell] = r.away

    def cells_of(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {n: [] for n in ("q_block", "dim", "cell")}
            for block, d, c, r, worst in zip(*(batch[n] for n in ("block", "dim", "q_centre", "q_radius", "worst"))):
                cells = np.array(sorted(reach[d]))
                away = np.array([reach[d][i] for i in cells.tolist()])
                top = _bound(np.array(c, float), r, centres[d][cells], away)
                for cell in cells[top >= min(worst)].tolist():
                    for name, value in zip(out, (block, d, cell)):
                        out[name].append(value)
            yield out

    asks = blocks.where(F.col("q_centre").isNotNull())
    light = asks.select("block", "dim", "q_centre", "q_radius", "worst")
    meets = map_batches(light, cells_of, "q_block long, dim int, cell int")
    heads = blocks.select(F.col("block").alias("to"), "dim", "cell", "centre", "radius")
    meets = meets.join(heads, ["dim", "cell"]).where("q_block != to")
    mine = asks.select(F.col("block").alias("q_block"), "q_centre", "q_radius", F.array_min("worst").alias("least"))
    meets = written(map_batches(meets.join(mine, "q_block"), _reaching, "q_block long, to long"), "meets")

    sides = asks.select(F.col("block").alias("q_block"), "queries", "query_names", "q_nodes", "q_radii", "worst")
    there = blocks.select(F.col("block").alias("to"), "dim", "points", "ids", "names", "nodes", "radii")
    pairs = meets.join(sides, "q_block").join(there, "to")

    def visit(batches) -> Iterator:
        import pyarrow as pa

        for rows_of in batches:
            for i in range(rows_of.num_rows):
                r = {n: rows_of.column(n)[i].as_py() for n in rows_of.schema.names}
                d = r["dim"]
                a, b, s = search(
                    _matrix(r["queries"], d), np.frombuffer(r["q_nodes"], np.int64).reshape(-1, 5), np.frombuffer(r["q_radii"]),
                    np.array(r["worst"], float), _matrix(r["points"], d),
                    np.frombuffer(r["nodes"], np.int64).reshape(-1, 5), np.frombuffer(r["radii"]), k + 1,
                )
                a, s, v, b = _best(a, b, s, r["ids"], k + 1)
                names, query = np.array(r["names"], np.int64), np.array(r["query_names"], np.int64)
                columns = [pa.array(query[a]), pa.array(s), pa.array(v, pa.int64()), pa.array(names[b])]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "score", "vec_id", "point"])

    found = pairs.drop("to", "q_block").mapInArrow(visit, "query long, score long, vec_id long, point long")
    own = blocks.select(F.explode("found").alias("f")).select("f.*")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "point")
    best = own.union(found).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    entry = F.struct("place", "score", "vec_id", "point")
    best = best.groupBy("query").agg(F.array_sort(F.collect_list(entry)).alias("best"))
    best = written(best.join(points.select(F.col("point").alias("query"), "vector"), "query"), "best")

    # a query's own row goes: one entry of its id and point
    asked = rows.where("asks").join(best, "vector")
    own_place = F.array_min(
        F.transform(
            F.filter("best", lambda e: (e["point"] == F.col("query")) & (e["vec_id"] == F.col("asker"))), lambda e: e["place"]
        )
    )
    asked = asked.withColumnRenamed("vec_id", "asker").withColumn("own", own_place)
    rest = F.slice(F.filter("best", lambda e: ~e["place"].eqNullSafe(F.col("own"))), 1, k)
    out = asked.select(F.col("asker").alias("query_id"), F.posexplode(rest).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "e.vec_id", "e.score")


def _part_of(nodes: np.ndarray, begin: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that hold queries, around the first query of each, with the radii that
    cover the queries of the node."""
    some = np.flatnonzero(end > begin)
    number = np.full(len(nodes) + 1, 0)
    number[some] = np.arange(len(some))
    kept = (end > begin).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(kept)))
    out = np.stack((begin[some], end[some], begin[some], before[nodes[some, 3]], before[nodes[some, 4]]), axis=1)
    radii = np.array([_norm((q[b:e] - q[b]).astype(float)).max() for b, e in zip(begin[some], end[some])])
    return out, radii


def _bound(c: np.ndarray, r: float, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The greatest score between points around ``c`` and those around each centre."""
    size, sizes = float(np.sqrt(c @ c)), _norm(centres)
    return centres @ c + r * sizes + radii * size + r * radii + SLACK * (size + r) * (sizes + radii) + SLACK


def _around(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            away = [
                float(np.linalg.norm(np.array(c, float) - centres[d][cell])) + r
                for d, cell, c, r in zip(batch["dim"], batch["cell"], batch["centre"], batch["radius"])
            ]
            yield {"dim": batch["dim"], "cell": batch["cell"], "away": away}

    return run


def _reaching(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        out: dict = {"q_block": [], "to": []}
        columns = (batch[n] for n in ("q_block", "to", "q_centre", "q_radius", "least", "centre", "radius"))
        for q_block, to, qc, qr, least, c, r in zip(*columns):
            if _bound(np.array(qc, float), qr, np.array([c], float), np.array([r]))[0] >= least:
                out["q_block"].append(q_block)
                out["to"].append(to)
        yield out
