"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written


def _is_stars(edges: DataFrame) -> bool:
    """Every node hangs on one smaller centre, and no centre hangs on another."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    centres = edges.select(F.col("b").alias("a")).distinct()
    return edges.join(centres, "a", "left_semi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, by alternating large-star and small-star steps.

    ``edges`` has columns ``a`` and ``b`` of one type, long or text; the result has one row
    ``(node, component)`` per node with an edge to another node, ``component`` being
    the smallest node reached.  Rows with a null and loops are ignored; no edges give
    no rows.  Neighbour lists are never gathered: each step is a grouped minimum that
    is joined back, and the minimum is written first, so that a hot centre is one
    skewed side of a sort-merge join that adaptive execution splits.
    """
    edges = (
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges = written(edges, "edges")
    while not _is_stars(edges):
        old = [edges]
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(
            both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low"
        )
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").distinct(), "large")
        old += [low, large]
        # small star: a > b in every row now
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a != b").union(low.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "edges")
        discard(*old, low)
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres)
