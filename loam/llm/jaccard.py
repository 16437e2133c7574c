"""N-gram Jaccard join by vertical partitioning.

The n-grams of all documents have one global order, from rare to frequent, which is cut
into fragments.  Two sets that link share one of their first n-grams in this order, so
that only those are indexed, and what many documents share comes last and is hardly ever
looked up.  The overlap of a pair that meets there is counted in each fragment
separately, as a join of the two sets' parts of that fragment, and summed over the
fragments.  Nothing is estimated: the result is the one of comparing all pairs.

Of the sets with one indexed n-gram, a few are compared all with all.  Many are first
compared with one of them; what links so is one component, and after that only sets of
different components meet, so that a large group of near copies costs a few comparisons
for each of them.  Where that would still be many pairs for each set, as with an n-gram that
many unlike documents share, sets meet only by two n-grams: the first two that two linked
sets share both stand among their first ones, if one more is indexed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    NO_ID,
    Words,
    connected_components,
    discard,
    map_batches,
    pieces,
    repeated_keys,
    shingle_hashes,
    written,
)

#: n-grams are counted by the upper bits of their hashes, in so many buckets; the counts
#: only make the order, which may be any, so that this fixed size loses nothing
BUCKETS = 1 << 16
#: parts that the order is cut into
FRAGMENTS = 8
#: sets with one indexed n-gram that are compared all with all at once
FEW = 64
#: pairs for each set with one n-gram from which on two n-grams are asked for
CROWD = 64
#: bits of the filter that keeps texts not asked for from being sent; a fixed size, and
#: what passes it wrongly is sorted out by the join behind it
FILTER_BITS = 1 << 22


def gram_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct n-word runs, A-Z in lower case."""
    docs = [(t or "").encode().lower() for t in texts]  # bytes: only A-Z change
    for i, j in pieces(docs):
        w = Words(docs[i:j])
        for a, b in zip(w.first[:-1], w.first[1:]):
            yield np.unique(shingle_hashes(w.hash[a:b], n))


def _node(grams: np.ndarray) -> int:
    """What stands for a set: 64 bits of a hash."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "big", signed=True)


def ordered(grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """N-grams renamed by their place in the global order: their bucket's rank comes first."""
    place = rank[(grams >> np.uint64(48)).astype(np.int64)].astype(np.uint64)
    return place << np.uint64(48) | grams & np.uint64((1 << 48) - 1)


def prefix_size(size: int, percent: int) -> int:
    """So many first n-grams of a set hold one of those shared with any set it links with:
    at least percent / 100 of its n-grams are shared."""
    return size - -(-size * percent // 100) + 1


def fragment_cuts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's rank, by its count, and the ranks at which the order is cut into
    fragments that hold about as many n-grams each."""
    by_rank = np.argsort(counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[by_rank] = np.arange(len(counts))
    upto = np.cumsum(counts[by_rank])
    return rank, np.searchsorted(upto, upto[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)


def needed(a: str, b: str, percent: int) -> Column:
    """The least overlap of two linked sets of these sizes."""
    return F.ceil((F.col(a) + F.col(b)) * percent / F.lit(100 + percent))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two sets with a shared n-gram at their places can link, if it is the first
    they share: so many are left in both."""
    left = F.least(F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place"))
    return left >= needed(f"{x}.size", f"{y}.size", percent)


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Each pair once: nodes ``a`` > ``b``, and their sizes."""
    a, b = (F.struct(F.col(f"{k}.node"), F.col(f"{k}.size")) for k in (x, y))
    rows = rows.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    return rows.select(*[F.col(f"{k}.{n}").alias(f"{n}_{k}") for k in "ab" for n in ("node", "size")]).distinct()


PAIRS = ("node_a", "size_a", "node_b", "size_b")


def _near(few: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """All pairs that may link of sets with the same key, a few for each key.

    The overlap of the first n-grams is counted here: what two sets share is at most
    that, what lies behind the first n-grams of one of them, and no more than what lies
    behind the last one they share.  ``apart`` (node, n) has how many of a set's first
    n-grams are left out, as many sets have them; so many more may be shared.
    """

    def pairs(key, node, size, place) -> dict:
        found = []
        for d in range(1, len(key)):
            at = np.flatnonzero(key[d:] == key[:-d])
            if not len(at):
                break
            x, y = at + d, at
            ok = (np.minimum(size[x], size[y]) >= -(-(size[x] + size[y]) * percent // (100 + percent))) & (node[x] != node[y])
            x, y = x[ok], y[ok]
            a, b = np.where(node[x] > node[y], x, y), np.where(node[x] > node[y], y, x)
            behind = np.minimum(size[a] - place[a], size[b] - place[b]) - 1
            found.append(np.stack((node[a], size[a], node[b], size[b], behind), 1))
        rows = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
        return dict(zip((*PAIRS, "behind"), rows.T))

    def run(batches):
        import pyarrow as pa

        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "node", "size", "place")]
            held = [np.concatenate(x) for x in zip(held, new)]
            last = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last key may go on
            yield pa.RecordBatch.from_pydict(pairs(*[x[:last] for x in held]))
            held = [x[last:] for x in held]
        yield pa.RecordBatch.from_pydict(pairs(*held))

    dealt = few.repartition("key").sortWithinPartitions("key").select("key", "node", "size", "place")
    met = dealt.mapInArrow(run, ", ".join(f"{n} long" for n in (*PAIRS, "behind")))
    met = met.groupBy(*PAIRS).agg(F.count("*").alias("shared"), F.min("behind").alias("behind"))
    for k in "ab":
        met = met.join(apart.select(F.col("node").alias(f"node_{k}"), F.col("n").alias(f"apart_{k}")), f"node_{k}", "left")
    left_out = F.least(*[F.coalesce(f"apart_{k}", F.lit(0)) for k in "ab"])
    # the size less the first n-grams is the least that a set shares less one
    further = F.greatest(*[F.ceil(F.col(f"size_{k}") * percent / F.lit(100)) - 1 for k in "ab"])
    most = F.col("shared") + left_out + F.least("behind", further)
    return met.where(most >= needed("size_a", "size_b", percent)).select(*PAIRS)


def linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs that link, as ``a`` and ``b``: partial overlaps of each fragment,
    summed for each pair.  A set that stands in many pairs is a skewed key of a
    sort-merge join, which adaptive execution splits."""
    mine, other = (
        segments.select(F.col("node").alias(k), "fragment", F.col("grams").alias(f"grams_{k}")).hint("merge") for k in "ab"
    )
    flat = pairs.select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b"), needed("size_a", "size_b", percent).alias("needed"),
        F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"),
    )
    both = flat.join(mine, ["a", "fragment"]).join(other, ["b", "fragment"])
    partial = both.select("a", "b", "needed", F.size(F.array_intersect("grams_a", "grams_b")).alias("partial"))
    total = partial.groupBy("a", "b", "needed").agg(F.sum("partial").alias("overlap"))
    return total.where("overlap >= needed").select("a", "b")


def _crowded(rows: DataFrame) -> DataFrame:
    """Keys (``crowded``) of rows (key, component) with many pairs of different components for each row."""
    n = rows.groupBy("key", "component").agg(F.count("*").cast("double").alias("n")).groupBy("key")
    n = n.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return n.select("key", (F.col("all") * F.col("all") - F.col("squares") > 2 * CROWD * F.col("all")).alias("crowded"))


def _meeting(many: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x`` and ``y`` of the many sets (key, own, component) that may link, of different components:
    by their n-gram, or, where that is a crowd, by it and a later one of ``shared``."""
    many = many.join(written(_crowded(many), "crowded").hint("merge"), "key")
    plain = many.where("NOT crowded").select("key", "own", "component", F.lit(None).cast("long").alias("next"))
    later = shared.select(F.col("node").alias("_node"), F.col("key").alias("_key"), F.col("place").alias("next"))
    crowd = many.where("crowded")
    both = (F.col("own.node") == F.col("_node")) & (F.col("next") > F.col("own.place"))
    twos = crowd.join(later.hint("merge"), both).select(F.xxhash64("key", "_key").alias("key"), "own", "component", "next")
    twos = written(twos, "twos")
    open_ = twos.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("another"))
    twos = twos.join(open_.where("one != another").select("key").hint("merge"), "key")

    def met(rows: DataFrame, seen: int) -> DataFrame:
        x, y = (rows.select("key", F.col("own").alias(k), F.col("component").alias(f"c{k}"), F.col("next").alias(f"n{k}")) for k in "xy")
        pairs = x.join(y.hint("merge"), "key").where("cx != cy AND x.node > y.node").where(_may_link("x", "y", percent))
        if seen == 1:
            return pairs.select("x", "y")
        # two are shared, and so many are left in both behind the second
        left = F.least(F.col("x.size") - F.col("nx"), F.col("y.size") - F.col("ny")) + 1
        return pairs.where(left >= needed("x.size", "y.size", percent)).select("x", "y")

    return met(plain, 1).unionByName(met(twos, 2))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text; others are ignored) to ``doc_id``, ``text_hash``,
    ``n_shingles``, ``component_id`` and ``first_hash``, one row per row.

    Two documents link when 100 |intersection| >= percent |union| of their sets of n-word
    runs; a text of fewer words is one run.  Null and empty texts have an empty set and
    link with nothing.  A component's id is the smallest doc_id reached, null only if no
    member has one; of the members with this id ``first_hash`` is the smallest text_hash, so
    that both name one document.  N-grams and sets are known by hashes of 64 bits.  Equal
    sets are one node, so that copies cost nothing; repeated rows are copies.  No rows
    give no rows.
    """

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        counts = np.zeros(BUCKETS, np.int64)
        names = ("doc_id", "text_hash", "n_shingles", "node", "bucket", "count")
        for batch in batches:
            size, node = [], []
            for s in gram_sets(batch["text"], n):
                counts += np.bincount((s >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
                size.append(len(s))
                node.append(_node(s) if len(s) else None)
            none = [None] * len(size)
            yield dict(zip(names, (batch["doc_id"], batch["text_hash"], size, node, none, none)))
        some = np.flatnonzero(counts)
        none = [None] * len(some)
        yield dict(zip(names, (none, none, none, none, some, counts[some])))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, n_shingles long, node long, bucket int, count long"
    sets = written(map_batches(texts, read, schema), "sets")
    counts = np.ones(BUCKETS, np.int64)
    for bucket, count in sets.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count")).collect():
        counts[bucket] += count
    order = docs.sparkSession.sparkContext.broadcast(fragment_cuts(counts))  # a fixed size
    sets = sets.where("bucket IS NULL").drop("bucket", "count")

    # the first n-grams of each set and one more, as far as two sets share them
    def emit(batch: dict) -> Iterator[tuple]:
        rank, _ = order.value
        seen, found = set(), []
        for s in gram_sets(batch["text"], n):
            node = _node(s)
            if len(s) and node not in seen:
                seen.add(node)
                found.append((node, len(s), np.sort(ordered(s, rank))[: prefix_size(len(s), percent) + 1]))
        if found:
            many = [len(p) for *_, p in found]
            yield np.concatenate([p for *_, p in found]).view(np.int64), [
                np.repeat(np.array([x[0] for x in found], np.int64), many),
                np.repeat(np.array([x[1] for x in found], np.int64), many),
                np.concatenate([np.arange(k) for k in many]),
            ]

    postings = written(repeated_keys(texts.select("text"), emit, ["node", "size", "place"], distinct=True), "postings")
    tally = postings.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("one"), F.max("node").alias("another"))
    tally = tally.where("one != another").select("key", (F.col("n") > FEW).alias("many"))
    shared = written(postings.join(tally.hint("merge"), "key"), "shared")
    discard(postings)

    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text_hash")).alias("first")
    low_key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")  # null ids last
    nodes = sets.where("node IS NOT NULL").groupBy("node").agg(first, F.min(low_key).alias("low"))
    nodes = written(nodes.select("node", "low", "first.*"), "nodes")
    placed = texts.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    slot = F.pmod(F.xxhash64("doc", "text_hash"), F.lit(FILTER_BITS)).alias("slot")

    def segments(pairs: DataFrame) -> DataFrame:
        """The sets of the pairs, cut into fragments."""
        asked = pairs.select(F.col("node_a").alias("node")).union(pairs.select("node_b")).distinct()
        asked = written(nodes.join(asked, "node").select("node", "doc", "text_hash"), "asked")
        bits = np.zeros(FILTER_BITS, bool)
        words = asked.select(slot).groupBy(F.shiftright("slot", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits")
        )
        for w, some in words.collect():  # FILTER_BITS / 64 rows at most
            bits[w * 64 : w * 64 + 64] = [some >> k & 1 for k in range(64)]
        passed = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

        def cut(batches: Iterator[dict]) -> Iterator[dict]:
            rank, cuts = order.value
            wanted = np.unpackbits(passed.value)
            for batch in batches:
                on = np.flatnonzero(wanted[np.array(batch["slot"], np.int64)]).tolist()
                out: dict = {k: [] for k in ("doc", "text_hash", "fragment", "grams")}
                for i, s in zip(on, gram_sets([batch["text"][i] for i in on], n)):
                    o = np.sort(ordered(s, rank))
                    at = np.concatenate(([0], np.searchsorted((o >> np.uint64(48)).astype(np.int64), cuts), [len(o)]))
                    for f in np.flatnonzero(np.diff(at)).tolist():
                        row = batch["doc"][i], batch["text_hash"][i], f, o[at[f] : at[f + 1]].view(np.int64)
                        for column, x in zip(out.values(), row):
                            column.append(x)
                yield out

        schema = "doc long, text_hash long, fragment int, grams array<long>"
        parts = map_batches(placed.select("doc", "text_hash", "text", slot), cut, schema).repartition("doc", "text_hash")
        parts = parts.dropDuplicates(["doc", "text_hash", "fragment"])  # repeated rows are one
        parts = parts.join(asked.hint("merge"), ["doc", "text_hash"])
        return written(parts.select("node", "fragment", "grams"), "segments")

    # a few sets with the same n-gram: all pairs; many: each with one, the set that has the
    # fewest n-grams before it in the order, so the fewest of its own: of copies the least changed
    first_ones = shared.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / F.lit(100)))
    many = first_ones.where("many").select("key", F.struct("place", "node", "size").alias("own")).distinct()
    low = written(many.groupBy("key").agg(F.min("own").alias("low")), "low")
    stars = many.join(low.hint("merge"), "key").where("own.node != low.node").where(_may_link("own", "low", percent))
    apart = first_ones.where("many").groupBy("node").agg(F.count("*").alias("n"))
    pairs = _near(first_ones.where("NOT many"), apart, percent).union(_pairs(stars, "own", "low")).distinct()
    pairs = written(pairs, "pairs")
    links = written(linked(pairs, segments(pairs), percent), "links")

    if not low.isEmpty():  # then all of the many that are not yet in one component
        found = connected_components(links).withColumnRenamed("node", "known")
        many = many.join(found.hint("merge"), F.col("own.node") == F.col("known"), "left")
        many = written(many.select("key", "own", F.coalesce("component", "own.node").alias("component")), "many")
        open_ = many.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("another"))
        many = written(many.join(written(open_.where("one != another").select("key"), "open").hint("merge"), "key"), "many")
        rest = _meeting(many, shared, percent)
        rest = written(_pairs(rest, "x", "y").join(pairs, list(PAIRS), "left_anti"), "rest")
        links = links.union(written(linked(rest, segments(rest), percent), "links"))
    discard(shared)

    reached = written(connected_components(links), "reached")
    least = written(
        reached.join(nodes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least")), "least"
    )
    known = reached.join(least, "component").select("node", F.col("least.doc_id").alias("least_id"), F.col("least.text_hash").alias("least_hash"))
    known = written(
        nodes.select("node", "low")
        .join(known, "node", "left")
        .select(
            "node",
            F.when(F.col("least_hash").isNotNull(), F.col("least_id")).otherwise(F.col("low.doc_id")).alias("component_id"),
            F.coalesce("least_hash", "low.text_hash").alias("first_hash"),
        ),
        "known",
    )
    return sets.join(known.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("known").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("first_hash", "text_hash").alias("first_hash"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """Sets of three words and links from 90 % on: ``doc_id``, ``n_shingles`` and
    ``component_id``.  Null and empty texts have no shingles and are a component of their
    own; repeated rows give a row each; no rows give no rows."""
    return jaccard_components(docs, n=3, percent=90).drop("text_hash", "first_hash")
