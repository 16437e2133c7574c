"""Batch retrieval: question analysis, nearest units, reranking, evidence, gate."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..settings import DEFAULTS, Settings
from ..storage import discard, scratch_dir, small_batches, written
from .components import connected_components

# Vocabularies and the names that questions use.
PRODUCTS = ("jira", "confluence", "jsm", "developer")
SPECIFIC_PRODUCTS = ("jira", "confluence", "jsm")
CATEGORIES = ("rest-api", "user-documentation", "administration", "developer", "general", "root")
INTENTS = ("factual", "how_to", "troubleshoot", "comparison", "explain_concept", "unknown")
ALIASES = {
    "jira service desk": "jsm",
    "jira service management": "jsm",
    "service desk": "jsm",
    "jira software": "jira",
    "jira": "jira",
    "confluence": "confluence",
    "jsm": "jsm",
    "developer": "developer",
    "rest api": "developer",
    "api docs": "developer",
}
VERBS = (
    "how|what|why|where|which|when|is|are|can|do|does|update|create|delete|add|remove|filter|search|export|rotate"
    "|configure|set|install"
)

MAX_QUESTION = 2000
#: rows, and numbers in their vectors, that a broadcast side may have
BROADCAST_ROWS, BROADCAST_NUMBERS = 10_000, 4_000_000


# -- questions -------------------------------------------------------------------------


def admit_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.coalesce(F.length("question").between(1, MAX_QUESTION), F.lit(False))
    return questions.where(good), questions.where(~good)


def products_named(question: Column | str) -> Column:
    """Products a question names, in order of appearance; the longest alias wins."""
    question = F.col(question) if isinstance(question, str) else question
    by_length = sorted(ALIASES, key=len, reverse=True)
    pattern = rf"(?U)(?<![\w-])({'|'.join(by_length)})(?![\w-])"
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    named = F.regexp_extract_all(F.lower(question), F.lit(pattern), 1)
    return F.array_distinct(F.transform(named, lambda a: F.element_at(table, a)))


def ambiguity(question: Column | str) -> Column:
    """Struct of ``ambiguous``, ``products`` and ``note``: two or more products named."""
    named = products_named(question)
    specific = F.filter(named, lambda p: p.isin(*SPECIFIC_PRODUCTS))
    effective = F.when(F.size(specific) > 0, specific).otherwise(named)
    many = F.size(effective) >= 2
    note = F.format_string(
        "This question mentions %s, so it was searched across both. The answer may come from only one of them.",
        F.array_join(effective, " and "),
    )
    return F.struct(
        many.alias("ambiguous"), F.when(many, effective).otherwise(named).alias("products"), F.when(many, note).alias("note")
    )


ANALYSIS = (
    "product string, category string, intent string, entities array<string>,"
    " confidence struct<product:string,category:string,intent:string,entities:string>"
)


def normalise_analysis(questions: DataFrame, raw: str = "raw_json", settings: Settings = DEFAULTS) -> DataFrame:
    """A model's classification held to the vocabularies: a value that is unknown, or less
    confident than the threshold, is null; confidences outside 0 to 1 count as 0."""
    parsed = F.from_json(F.col(raw), ANALYSIS)
    rows = questions.withColumn("_a", parsed).withColumn("_amb", ambiguity("question"))

    def confidence(name: str) -> Column:
        value = F.expr(f"try_cast(_a.confidence.{name} AS double)")
        return F.when(value.between(0, 1), value).otherwise(0.0)

    def field(name: str, allowed: tuple) -> Column:
        value = F.lower(F.trim(F.col("_a")[name]))
        good = value.isin(*allowed) & (value != "unknown") & (confidence(name) >= settings.classification_threshold)
        return F.when(good, value).alias(f"detected_{name}")

    entities = F.filter(F.transform(F.col("_a.entities"), lambda e: F.trim(e)), lambda e: e != "")
    sure = confidence("entities") >= settings.classification_threshold
    return rows.select(
        *questions.columns,
        field("product", PRODUCTS),
        field("category", CATEGORIES),
        field("intent", INTENTS),
        F.coalesce(F.when(sure, entities), F.array().cast("array<string>")).alias("entities"),
        F.create_map(*[x for n in ("product", "category", "intent", "entities") for x in (F.lit(n), confidence(n))]).alias("confidence"),
        F.col("_amb.products").alias("named_products"),
        F.col("_amb.note").alias("ambiguity_note"),
    )


def filter_plan(analysed: DataFrame, enabled: bool = True, settings: Settings = DEFAULTS) -> DataFrame:
    """``filter_product``, ``filter_category`` and ``filter_reason``; null means no constraint."""
    sure = lambda n: F.coalesce(F.col("confidence")[n], F.lit(0.0)) >= settings.classification_threshold
    open_ = F.lit(enabled) & F.col("ambiguity_note").isNull()
    product = F.when(open_ & sure("product"), F.col("detected_product"))
    category = F.when(open_ & sure("category"), F.col("detected_category"))
    reason = (
        F.when(F.lit(not enabled), "disabled")
        .when(F.col("confidence").isNull(), "no_analysis")
        .when(F.col("ambiguity_note").isNotNull(), "ambiguous")
        .when(product.isNotNull() | category.isNotNull(), "confident")
        .otherwise("low_confidence")
    )
    return analysed.select(
        "*", product.alias("filter_product"), category.alias("filter_category"), reason.alias("filter_reason")
    )


def rewrites(analysed: DataFrame) -> DataFrame:
    """One row per query of a question: ``rewrite`` from 0, ``query`` and ``scope``, the
    product whose units are searched (null: as planned)."""
    q = T.stripped("question")
    tagged = F.transform("named_products", lambda p: F.struct(F.concat(q, F.lit(" [scope: "), p, F.lit("]")).alias("query"), p.alias("scope")))
    plain = lambda text: F.struct(text.alias("query"), F.lit(None).cast("string").alias("scope"))
    trimmed = lambda parts: F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ ?.!]+|[ ?.!]+$", "")), lambda p: p != "")
    asked = lambda parts: F.transform(parts, lambda p: plain(F.concat(p, F.lit("?"))))
    sides = trimmed(F.split(q, r"(?i)\bvs(?:\.|ersus)?\b"))
    versus = F.lower(q).rlike(r" (vs|vs\.|versus) ") & (F.size("entities") >= 2) & (F.size(sides) == 2)
    clauses = trimmed(F.split(q, r"(?i)\s+\band\b\s+|\s+as\s+well\s+as\s+|\s+or\s+"))
    several = (F.size(clauses) >= 2) & F.forall(clauses, lambda c: c.rlike(rf"(?i)\b({VERBS})\b"))
    many = F.col("ambiguity_note").isNotNull() & (F.size("named_products") > 1)
    queries = F.when(many, tagged).when(versus, asked(sides)).when(several, asked(clauses)).otherwise(F.array(plain(q)))
    return analysed.select("*", F.posexplode(queries).alias("rewrite", "_q")).select("*", "_q.query", "_q.scope").drop("_q")


def scoped_filters(rewritten: DataFrame) -> DataFrame:
    """A scoped query is filtered by its own product, certain and not ambiguous; products
    searched are those named in an ambiguous question, else the one detected."""
    searched = F.when(
        F.col("ambiguity_note").isNotNull() & (F.size("named_products") > 0), F.col("named_products")
    ).otherwise(F.array("detected_product"))
    return rewritten.withColumn("searched_products", searched).withColumn(
        "filter_product", F.coalesce("scope", "filter_product")
    )


# -- nearest units ---------------------------------------------------------------------


def _top(rows: DataFrame, k: int, query: str) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), "unit_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: scores that a task holds at once
SCORES = 4_000_000


def _vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow column as the rows of a matrix, filled up with zeros, and their lengths: -1 for
    a vector that is null or holds a null, which is zeros there."""
    column = column.cast(pa.large_list(pa.float64()))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy().astype(np.int64)
    length, flat = np.maximum(size, 0), pc.list_flatten(column)
    row, place = np.repeat(np.arange(len(size)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    out = np.zeros((len(size), int(length.max(initial=0))))
    out[row, place] = flat.to_numpy(zero_copy_only=False)
    size[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    out[size < 0] = 0.0
    return out, size


class _Nearest:
    """The best ``k`` units of each query of a block, over the batches of a task.

    Matrix products find which units may be among them, as each is off by less than ``slack``; those alone are
    scored component by component, in order, so that a score does not hang on where its unit stands.
    """

    def __init__(self, queries, k: int, not_self: bool, match: tuple[str, str] | None):
        self.queries, self.k, self.not_self, self.match = queries, k, not_self, match
        self.vectors = _vectors(queries["embedding"])
        with np.errstate(all="ignore"):
            self.norms = np.sqrt((self.vectors[0] ** 2).sum(1))
        self.kth = np.full(len(queries), -np.inf)
        self.at, self.score, self.rows = np.zeros(0, np.int64), np.zeros(0), None

    def _allowed(self, units, rows: slice) -> np.ndarray | None:
        """Which units each of these queries may have, if it may not have all."""
        out = None
        some = self.queries.slice(rows.start, rows.stop - rows.start)
        if self.not_self:
            both = pc.unique(pa.chunked_array([*some["query_id"].chunks, *units["unit_id"].chunks]))
            a, b = (pc.index_in(c, both).to_numpy() for c in (some["query_id"], units["unit_id"]))
            # no constraint holds of a null
            out = (a[:, None] != b[None]) & some["query_id"].is_valid().to_numpy()[:, None] & units["unit_id"].is_valid().to_numpy()[None]
        if self.match:
            want, got = some[self.match[0]], units[self.match[1]].cast(some[self.match[0]].type)
            both = pc.unique(pa.chunked_array([*want.chunks, *got.chunks]))
            a, b = (pc.index_in(c, both).to_numpy() for c in (want, got))
            fits = (a[:, None] == b[None]) | want.is_null().to_numpy()[:, None]
            out = fits if out is None else out & fits
        return out

    def add(self, units) -> None:
        x, length = _vectors(units["embedding"])
        q, asked = self.vectors
        wide = min(x.shape[1], q.shape[1])  # no longer vectors are of one length
        with np.errstate(all="ignore"):
            longest = np.sqrt((x**2).sum(1)).max(initial=0.0)
        step = max(1, SCORES // max(len(x), 1))
        for start in range(0, len(q), step):
            rows = slice(start, min(start + step, len(q)))
            allowed = self._allowed(units, rows)
            with np.errstate(all="ignore"):
                scored = (asked[rows, None] == length[None]) & (length >= 0)[None]
                near = q[rows, :wide] @ x[:, :wide].T
                # what is no number or endless is looked at by itself, above all others
                near[~np.isfinite(near)] = np.inf
                near[~scored] = -np.inf
                if allowed is not None:
                    near[~allowed] = -np.inf
                slack = 1e-15 * (q.shape[1] + 8) * self.norms[rows] * longest
                slack = np.where(np.isfinite(slack), slack, np.inf)
                floor = self.kth[rows] - slack
                new = np.flatnonzero(~(self.kth[rows] > -np.inf))
                if len(new) and len(x) > self.k:
                    floor[new] = np.partition(near[new], -self.k, axis=1)[:, -self.k] - 2 * slack[new]
                floor[np.isnan(floor)] = -np.inf
                take = (near >= floor[:, None]) & scored
            if not scored.all():  # units without a score come last, by their id
                take |= ~scored
            if allowed is not None:
                take &= allowed
            a, b = np.nonzero(take)
            if len(a):
                self._merge(a + start, b, scored[a, b], units, x)

    def _merge(self, a: np.ndarray, b: np.ndarray, scored: np.ndarray, units, x: np.ndarray) -> None:
        q = self.vectors[0]
        score = np.zeros(len(a))
        with np.errstate(all="ignore"):
            for j in range(min(q.shape[1], x.shape[1])):
                score += q[a, j] * x[b, j]
        rows = units.drop_columns("embedding").take(pa.array(b)).append_column("_scored", pa.array(scored))
        mine = np.isin(self.at, np.unique(a))  # only queries with new units are ranked anew
        if self.rows is not None:
            rows, a, score = pa.concat_tables([self.rows, rows]), np.concatenate((self.at, a)), np.concatenate((self.score, score))
            mine = np.concatenate((mine, np.ones(len(a) - len(mine), bool)))
        there = rows["_scored"].to_numpy()
        ids = pc.rank(rows["unit_id"], "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        # a score that is no number is above all others, one that is null below
        high = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((ids, ~np.isnan(score), -high, ~there, a))
        place = np.arange(len(a)) - np.searchsorted(a[order], a[order])
        keep = order[place < self.k]
        self.at, self.score, self.rows = a[keep], score[keep], rows.take(pa.array(keep)).combine_chunks()
        last = order[place == self.k - 1]
        self.kth[a[last]] = np.where(there[last], high[last], -np.inf)

    def found(self):
        if self.rows is None:
            return
        mine = self.queries.drop_columns("embedding").take(pa.array(self.at))
        score = pa.array(self.score, mask=~self.rows["_scored"].to_numpy())
        rows = self.rows.drop_columns("_scored")
        names = [*mine.column_names, *rows.column_names, "score"]
        yield from pa.table([*mine.columns, *rows.columns, score], names=names).to_batches(max_chunksize=10_000)


def nearest_units(
    queries: DataFrame, units: DataFrame, k: int, not_self: bool = False, match: tuple[str, str] | None = None
) -> DataFrame:
    """Exact top ``k`` units per query by inner product, ties by unit id.

    ``queries`` (query_id, embedding, ...) is a stated query set: it is compared with all
    units, in blocks of at most BROADCAST_ROWS rows and BROADCAST_NUMBERS numbers.  A block is
    broadcast, and a task takes the products of it with each batch of its units and keeps the best
    ``k`` per query.  Blocks are searched one after the other, so that the units stay spread over
    all tasks however many blocks there are; what a block found is written, a table of ``k`` rows per
    query and task.

    ``not_self`` leaves out the unit with the query's id.  ``match`` names a column of the queries and one of the
    units: where the first is not null, only units with an equal second one count.  A vector that is null, has a
    null in it or another length than the query's gives a null score, which comes last.
    """
    spark = queries.sparkSession
    n, numbers = queries.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("embedding"), F.lit(0))), F.lit(0))).first()
    blocks = max(math.ceil(n / BROADCAST_ROWS), math.ceil(numbers / BROADCAST_NUMBERS), 1)
    out = StructType([f for f in (*queries.schema, *units.schema) if f.name != "embedding"]).add("score", "double")

    def best(block: DataFrame) -> DataFrame:
        asked = spark.sparkContext.broadcast(block.toArrow())

        def run(batches: Iterator) -> Iterator:
            near = _Nearest(asked.value, k, not_self, match)
            if len(near.queries):
                for batch in batches:
                    near.add(pa.Table.from_batches([batch]))
            yield from near.found()

        return units.mapInArrow(run, out)

    if blocks == 1:
        return _top(best(queries), k, "query_id")
    to = f"{scratch_dir(spark)}/nearest-{uuid.uuid4().hex}"
    for block in range(blocks):
        best(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).write.mode("append").parquet(to)
    return _top(spark.read.schema(out).parquet(to), k, "query_id")


def widened(filtered: DataFrame, unfiltered: DataFrame, plans: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Hits of filtered searches; a query whose filter left fewer than the least evidence
    takes its unfiltered hits."""
    had = filtered.groupBy("query_id").agg(F.count("*").alias("n"))
    limited = (F.col("filter_product").isNotNull() | F.col("filter_category").isNotNull()) & (
        F.coalesce("n", F.lit(0)) < settings.evidence_min
    )
    wide = plans.join(had, "query_id", "left").where(limited).select("query_id").distinct()
    a = filtered.join(wide, "query_id", "left_anti").withColumn("widened", F.lit(False))
    return a.unionByName(unfiltered.join(wide, "query_id", "left_semi").withColumn("widened", F.lit(True)))


def candidate_pool(hits: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per question the first ``pool_size`` distinct units, by rewrite and rank."""
    order = ["rewrite", "rank"]
    seen = Window.partitionBy("question_id", "unit_id").orderBy(*order)
    place = Window.partitionBy("question_id").orderBy(*order, "unit_id")
    return (
        hits.withColumn("_n", F.row_number().over(seen)).where("_n = 1")
        .withColumn("pool_rank", F.row_number().over(place)).drop("_n")
        .where(F.col("pool_rank") <= settings.pool_size)
    )


def hydrate(hits: DataFrame, units: DataFrame, documents: DataFrame, parts: int | None = None) -> DataFrame:
    """Hits with their unit's and document's provenance; hits without a row or a URL go.  With ``parts``, hits and
    units meet in so many tasks, which adaptive execution does not merge, and what comes after stays in them."""
    docs = documents.withColumn("source_url", F.coalesce(F.when(F.col("url") != "", F.col("url")), F.col("canonical_url")))
    if parts:
        hits, units = hits.repartition(parts, "unit_id"), units.repartition(parts, "unit_id").hint("merge")
    return hits.join(units, "unit_id").join(docs.where("source_url != ''").drop("url", "canonical_url"), "document_id")


def executed_queries(hits: DataFrame) -> DataFrame:
    return hits.groupBy("question_id", "query").agg(
        F.count("unit_id").alias("returned"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score")
    )


# -- reranking and evidence ------------------------------------------------------------


def lexical_score(query: Column | str, text: Column | str) -> Column:
    """The reranker without a model: the share of the query's words in the text."""
    return F.coalesce(T.answer_relevance(query, text), F.lit(0.0))


class Scorer(Protocol):
    """Scores how well texts answer questions, many at once, 0 to 1."""

    def setup(self) -> None:
        """Called once in each task before the first batch: what is costly to make is made here."""

    def score(self, questions: list[str], texts: list[str]) -> list[float]:
        """A score for each pair."""


class LexicalScorer:
    """The share of a question's content words that a text holds, as ``lexical_score`` has it."""

    def setup(self) -> None:
        self.stop = frozenset(T.CONTENT_STOP_WORDS)
        self.apart = re.compile("[^a-z0-9]+")

    def _words(self, text: str) -> set[str]:
        return {w for w in self.apart.split(text.lower()) if w and w not in self.stop}

    def score(self, questions: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(questions, texts):
            asked = self._words(q)
            out.append(len(asked & self._words(t)) / len(asked) if asked else 0.0)
        return out


def scored_by(scorer: Scorer, question: Column | str, text: Column | str, batch: int = 64) -> Column:
    """A column of a scorer's scores: it is set up once in each task and then gets ``batch``
    pairs at a time.  Null texts are empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer.setup()
        for q, t in batches:
            q, t = (["" if x is None else x for x in c] for c in (q, t))
            out = [s for at in range(0, len(q), batch) for s in scorer.score(q[at : at + batch], t[at : at + batch])]
            yield pd.Series(out, dtype="float64")

    return run(question, text)


def rerank(
    pool: DataFrame, scores: DataFrame | None = None, score: Column | None = None, settings: Settings = DEFAULTS, scorer: Scorer | None = None
) -> DataFrame:
    """Candidates with ``rerank_score`` and ``rerank_rank``, the best ``rerank_size``.

    Scores come as a table (question_id, index, score) keyed by the candidate's place in
    the pool, as an expression, or from a ``scorer`` of batches.  Empty texts are dropped first, scores are held to 0
    to 1, places out of range match nothing, and a question without any score keeps its
    retrieval order.
    """
    w = Window.partitionBy("question_id").orderBy("pool_rank")
    rows = pool.where(T.stripped("text") != "").withColumn("index", F.row_number().over(w) - 1)
    if scorer is not None:
        rows = rows.withColumn("_s", scored_by(scorer, "question", "text"))
    elif scores is None:
        rows = rows.withColumn("_s", score if score is not None else lexical_score("question", "text"))
    else:
        rows = rows.join(scores.select("question_id", "index", F.col("score").alias("_s")), ["question_id", "index"], "left")
    scored = F.max(F.col("_s").isNotNull()).over(Window.partitionBy("question_id"))
    rows = rows.withColumn("_any", scored).where("_s IS NOT NULL OR NOT _any")
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_s", "score")))
    rows = rows.withColumn("rerank_score", held)
    order = Window.partitionBy("question_id").orderBy(F.when(F.col("_any"), F.col("rerank_score")).desc_nulls_last(), "index")
    return (
        rows.withColumn("rerank_rank", F.row_number().over(order))
        .where(F.col("rerank_rank") <= settings.rerank_size)
        .drop("_s", "_any")
    )


def select_evidence(reranked: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The evidence of each question, in the order accepted (``evidence_rank`` from 1).

    Candidates are taken by 0.8 of the rerank score and 0.2 of the heading relevance.  A
    near duplicate of an accepted text (trigram Jaccard over 0.6), a third unit of one
    document and what exceeds ``evidence_max`` are passed over.  ``required_groups``, an
    array column, reserves the best unit of each group first; ``prefer_group`` fills with
    that group and takes others only up to ``evidence_min``.  A question has at most
    ``rerank_size`` candidates, so the fold runs over one short array.
    """
    columns = reranked.columns
    group = F.coalesce(F.col("product"), F.lit(""))
    required = F.col("required_groups") if "required_groups" in columns else F.array().cast("array<string>")
    prefer = F.col("prefer_group") if "prefer_group" in columns else F.lit(None).cast("string")
    composite = 0.8 * F.col("rerank_score") + 0.2 * T.heading_relevance("question", "heading_path")
    item = F.struct(
        (-composite).alias("neg"),
        F.col("rerank_rank").alias("r"),
        F.col("unit_id").alias("unit_id"),
        F.coalesce(F.col("document_id").cast("string"), F.col("unit_id").cast("string")).alias("doc"),
        group.alias("grp"),
        T.trigrams("text").alias("grams"),
    )
    per = reranked.groupBy("question_id").agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        F.first(required).alias("required"),
        F.first(prefer, ignorenulls=True).alias("prefer"),
    )
    kind = "struct<unit_id:string,doc:string,grp:string,grams:array<string>>"
    none = F.array().cast(f"array<{kind}>")

    def accept(taken: Column, x: Column, allowed: Column) -> Column:
        similar = F.exists(taken, lambda t: T.set_jaccard(t["grams"], x["grams"]) > 0.6)
        same_doc = F.size(F.filter(taken, lambda t: t["doc"] == x["doc"]))
        there = F.exists(taken, lambda t: t["unit_id"] == x["unit_id"])
        good = allowed & (F.size(taken) < settings.evidence_max) & ~similar & (same_doc < 2) & ~there
        new = F.struct(x["unit_id"].cast("string").alias("unit_id"), x["doc"].cast("string").alias("doc"), x["grp"].alias("grp"), x["grams"].alias("grams"))
        return F.when(good, F.concat(taken, F.array(new))).otherwise(taken)

    def reserve(taken: Column, wanted: Column) -> Column:
        filled = F.exists(taken, lambda t: t["grp"] == wanted)
        return F.aggregate(
            F.col("items"), taken,
            lambda t, x: accept(t, x, ~filled & (x["grp"] == wanted) & ~F.exists(t, lambda y: y["grp"] == wanted)),
        )

    reserved = F.aggregate(F.coalesce("required", F.array().cast("array<string>")), none, reserve)
    rows = per.withColumn("reserved", reserved)
    all_ = F.aggregate("items", F.col("reserved"), lambda t, x: accept(t, x, F.lit(True)))
    own = F.aggregate("items", F.col("reserved"), lambda t, x: accept(t, x, x["grp"] == F.col("prefer")))
    rows = rows.withColumn("own", own)
    filled = F.aggregate(
        "items", F.col("own"),
        lambda t, x: accept(t, x, (x["grp"] != F.col("prefer")) & (F.size(t) < settings.evidence_min)),
    )
    chosen = F.when(F.col("prefer").isNotNull(), filled).otherwise(all_)
    picked = rows.select("question_id", F.posexplode(F.transform(chosen, lambda t: t["unit_id"])).alias("_p", "_u"))
    picked = picked.select("question_id", F.col("_u").alias("unit_key"), (F.col("_p") + 1).alias("evidence_rank"))
    return reranked.withColumn("unit_key", F.col("unit_id").cast("string")).join(picked, ["question_id", "unit_key"]).drop("unit_key")


def evidence_gate(reranked: DataFrame, evidence: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per question ``refused``, ``gate_reason``, ``best_score`` and ``weakest_selected``."""
    best = reranked.groupBy("question_id").agg(F.max("rerank_score").alias("best_score"))
    weak = evidence.groupBy("question_id").agg(F.min("rerank_score").alias("_w"))
    a, b = F.lit(settings.min_rerank_score).cast("double"), F.lit(settings.min_evidence_score).cast("double")
    reason = F.when(F.col("best_score") < a, "BELOW_MIN_RERANK_SCORE").when(
        b.isNotNull() & (F.col("_w").isNull() | (F.col("_w") < b)), "BELOW_MIN_EVIDENCE_SCORE"
    )
    return best.join(weak, "question_id", "left").select(
        "question_id", reason.isNotNull().alias("refused"), reason.alias("gate_reason"), "best_score",
        F.coalesce("_w", "best_score").alias("weakest_selected"),
    )


def refusal_leads(reranked: DataFrame, limit: int = 3, share: float = 0.25) -> DataFrame:
    """The best few candidates with a URL that score at least a share of the best."""
    w = Window.partitionBy("question_id")
    good = reranked.withColumn("_b", F.max("rerank_score").over(w)).where(
        (F.col("rerank_score") >= F.col("_b") * share) & (F.coalesce("source_url", F.lit("")) != "")
    )
    order = w.orderBy(F.col("rerank_score").desc(), "rerank_rank")
    return good.withColumn("lead_rank", F.row_number().over(order)).where(F.col("lead_rank") <= limit).drop("_b")


def evidence_prompt(evidence: DataFrame) -> DataFrame:
    """Evidence of a question as numbered text blocks, in order."""
    block = F.concat(
        F.lit("[E"), F.col("evidence_rank").cast("string"), F.lit("] "), T.display_heading("heading_path"), F.lit("\n"), F.col("text")
    )
    listed = F.sort_array(F.collect_list(F.struct("evidence_rank", block.alias("block"))))
    return evidence.groupBy("question_id").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("prompt"))


def near_duplicate_pairs(texts: DataFrame, group: str, key: str, threshold: float = 0.6) -> DataFrame:
    """Pairs of different texts of one group whose trigram sets have a Jaccard over
    ``threshold``: ``group``, ``a``, ``b``, the least keys of either text, and ``jaccard``.

    Sets are joined on their trigrams, rarest first: a pair over the threshold shares one
    of the first n - ceil(threshold n) + 1 of them, so only those are exploded.  Sets of sizes
    too far apart are no pair, nor are those that the shared trigram leaves too little behind its
    places, were it the first they share.  Groups and keys that are null take no part.
    """
    some = texts.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col("text").isNotNull())
    some = some.groupBy(F.col(group).alias("grp"), "text").agg(F.min(key).alias("key"))
    rows = some.select("grp", "key", F.explode(T.trigrams("text")).alias("g"))
    df = rows.groupBy("g").agg(F.count("*").alias("df"))
    ordered = rows.join(df, "g").groupBy("grp", "key").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("s"))
    sets = ordered.select("grp", "key", F.transform("s", lambda x: x["g"]).alias("grams"))
    n = F.size("grams")
    prefix = F.slice("grams", F.lit(1), n - F.ceil(n * threshold).cast("int") + 1)
    keyed = sets.select("grp", "key", F.posexplode(prefix).alias("p", "g"), n.alias("n"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = F.expr("a.grp = b.grp AND a.g = b.g AND a.key < b.key") & (F.least("a.n", "b.n") > threshold * F.greatest("a.n", "b.n"))
    # a Jaccard over the threshold is an overlap over this
    overlap = (F.col("a.n") + F.col("b.n")) * threshold / (1 + threshold)
    near = near & (F.least(F.expr("a.n - a.p"), F.expr("b.n - b.p")) > overlap - 1e-9)
    pairs = a.join(b, near).select("a.grp", F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    one = sets.select("grp", F.col("key").alias("a"), F.col("grams").alias("ga"))
    two = sets.select("grp", F.col("key").alias("b"), F.col("grams").alias("gb"))
    scored = pairs.join(one, ["grp", "a"]).join(two, ["grp", "b"]).withColumn("jaccard", T.set_jaccard(F.col("ga"), F.col("gb")))
    return scored.where(F.col("jaccard") > threshold).select(F.col("grp").alias(group), "a", "b", "jaccard")


#: texts, and trigrams of theirs without a column, that are compared with each other in one task
GROUP_TEXTS, GROUP_GRAMS = 2048, 2_000_000
#: common trigrams that have a column, and texts by which they are chosen; results depend on neither
GRAM_COLUMNS, GRAM_SAMPLE = 4096, 10_000
#: times GROUP_TEXTS that a group has to have for its large classes to be sought first
FEW_BLOCKS = 16


def _gram_codes(text: str) -> np.ndarray:
    """The trigrams of a text as ascending numbers of 63 bits, 21 for each code point; a shorter text is one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    if len(c) < 3:
        c = np.concatenate((np.zeros(3 - len(c), np.int64), c))
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _common_grams(texts: DataFrame) -> np.ndarray:
    """The trigrams that have a column, the commonest first, by about GRAM_SAMPLE of the texts."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                codes, n = np.unique(np.concatenate([_gram_codes(t) for t in batch["text"].to_pylist()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["g", "n"])

    some = texts.where(F.pmod(F.xxhash64("key"), F.lit(max(texts.count() // GRAM_SAMPLE, 1))) == 0)
    counts = some.select(T.trigram_text("text").alias("text")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return np.array([r.g for r in counts.orderBy(F.desc("n"), "g").limit(GRAM_COLUMNS).collect()], np.int64)


def _gram_sets(texts: DataFrame) -> DataFrame:
    """Trigram sets of (grp, key, text): their size ``n``, a bit for each column, and the codes without one."""
    common = _common_grams(texts)
    order = np.argsort(common)
    ordered = common[order]

    def of(text: str) -> tuple[int, bytes, bytes]:
        codes = _gram_codes(text)
        at = np.minimum(np.searchsorted(ordered, codes), len(ordered) - 1)
        has = ordered[at] == codes if len(ordered) else np.zeros(len(codes), bool)
        bits = np.zeros(-(-len(ordered) // 64) * 64, np.uint8)
        bits[order[at[has]]] = 1
        return len(codes), np.packbits(bits).tobytes(), codes[~has].tobytes()

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            sets = [of(t) for t in batch["text"].to_pylist()]
            made = [pa.array([s[i] for s in sets], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch["grp"], batch["key"], *made], ["grp", "key", "n", "bits", "rest"])

    small_batches(texts.sparkSession)
    schema = texts.select("grp", "key").schema.add("n", "long").add("bits", "binary").add("rest", "binary")
    return texts.select("grp", "key", T.trigram_text("text").alias("text")).mapInArrow(run, schema)


class _Sets:
    """Trigram sets of a task, from concatenated bytes."""

    def __init__(self, n: np.ndarray, bits: bytes, rest: bytes, lengths: np.ndarray):
        self.n, self.bits = n, np.frombuffer(bits, np.uint64).reshape(len(n), len(bits) // (8 * max(len(n), 1)))
        self.rest, self.lengths, self.starts = np.frombuffer(rest, np.int64), lengths, np.cumsum(lengths) - lengths
        self.size = n.astype(np.float32)

    def first(self, most: int | None) -> _Sets:
        if most is None or most >= len(self.n):
            return self
        lengths = self.lengths[:most]
        return _Sets(self.n[:most], self.bits[:most].tobytes(), self.rest[: lengths.sum()].tobytes(), lengths)

    def columns(self, first: int, last: int, rows: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.bits[rows, first // 64 : last // 64].view(np.uint8), axis=1).astype(np.float32)


def _packed(table: pa.Table) -> tuple[np.ndarray, bytes, bytes, np.ndarray]:
    bits, rest = (table[c].to_pylist() for c in ("bits", "rest"))
    return table["n"].to_numpy().astype(np.int64), b"".join(bits), b"".join(rest), np.array([len(r) // 8 for r in rest], np.int64)


def _shared_rest(a: _Sets, b: _Sets, r: np.ndarray, c: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """How many codes without a column the sets ``r`` of ``a`` and ``c`` of ``b`` share, pair by pair."""
    out = np.zeros(len(r), np.int64)
    if not len(a.rest) or not len(b.rest):
        return out
    codes, at = np.unique(b.rest, return_inverse=True)
    held = np.repeat(np.arange(len(b.n)), b.lengths) * len(codes) + at  # ascending, as sets and their codes are
    mine = np.minimum(np.searchsorted(codes, a.rest), len(codes) - 1)
    known = codes[mine] == a.rest
    steps = np.cumsum(a.lengths[r]) // most
    for step in np.unique(steps):
        pairs = np.flatnonzero(steps == step)
        length = a.lengths[r[pairs]]
        pair = np.repeat(np.arange(len(pairs)), length)
        code = np.arange(len(pair)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(a.starts[r[pairs]], length)
        asked = c[pairs][pair] * len(codes) + mine[code]
        found = known[code] & (held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked)
        out[pairs] = np.bincount(pair[found], minlength=len(pairs))
    return out


def _links(a: _Sets, b: _Sets, apart: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets of ``a`` and ``b`` have a Jaccard over the threshold, among the pairs in ``apart``.

    Overlaps are products of 0-1 matrices, some of the commonest trigrams' columns first.  What is
    left of the smaller set then bounds the overlap, and sets without an open pair go; when few pairs are
    open, their bits are compared pair by pair, and last the codes without a column.
    """
    share, linked = np.float32(threshold / (1 + threshold)), np.zeros(apart.shape, bool)
    slack = 0.5 + float(a.size.max(initial=0) + b.size.max(initial=0)) * 1e-6  # of 32-bit floats; the last word is an exact count
    rows, columns, open_, both = np.arange(len(a.n)), np.arange(len(b.n)), apart, np.zeros(apart.shape, np.float32)
    left, at, width = [a.size, b.size], 0, a.bits.shape[1] * 64
    while at < width:
        to = min(max(512, 2 * at), width)
        # a pair takes as long by itself as about 16,000 columns of it in a product
        if np.count_nonzero(open_) <= max(open_.size * (to - at) / 16000, 2048):
            break
        x, y = a.columns(at, to, rows), b.columns(at, to, columns)
        both += x @ y.T
        at, left = to, [left[0] - x.sum(1), left[1] - y.sum(1)]
        need = (a.size[rows, None] + b.size[None, columns]) * share
        sure = open_ & (both > need + slack)
        r, c = np.nonzero(sure)
        linked[rows[r], columns[c]] = True
        open_ = open_ & ~sure & (both + np.minimum(left[0][:, None], left[1][None]) > need - slack)
        r, c = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if len(r) < len(rows) or len(c) < len(columns):
            rows, columns, left, kept = rows[r], columns[c], [left[0][r], left[1][c]], np.ix_(r, c)
            open_, both = open_[kept], both[kept]
    some = []
    for r, c in _few(*np.nonzero(open_)):
        n, r, c = both[r, c].astype(np.int64), rows[r], columns[c]
        if at < width:
            n += np.bitwise_count(a.bits[r, at // 64 :] & b.bits[c, at // 64 :]).sum(1, dtype=np.int64)
        may = n + np.minimum(a.lengths[r], b.lengths[c]) > (a.size[r] + b.size[c]) * share - slack
        some.append((r[may], c[may], n[may]))
    if some:
        r, c, n = map(np.concatenate, zip(*some))
        n += _shared_rest(a, b, r, c)
        good = n / (a.n[r] + b.n[c] - n) > threshold
        linked[r[good], c[good]] = True
    return linked


def _few(rows: np.ndarray, columns: np.ndarray, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return ((rows[i : i + most], columns[i : i + most]) for i in range(0, len(rows), most))


def _least(linked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The least key that each node of a graph, given by its matrix, reaches; a row is looked at once."""
    out, seen = keys.copy(), np.zeros(len(keys), bool)
    alone = ~linked.any(1)
    for i in np.argsort(keys, kind="stable"):
        if seen[i] or alone[i]:
            continue
        new = np.zeros(len(keys), bool)
        new[i] = True
        while new.any():
            seen |= new
            out[new] = keys[i]
            new = linked[new].any(0) & ~seen
    return out


def near_duplicate_classes(texts: DataFrame, group: str, key: str, threshold: float = 0.6) -> DataFrame:
    """``group``, ``key`` and ``class_id`` of every text: the least key that near duplicates
    and equal texts of the group reach.  ``key`` is long and of one group.

    A set is kept as bits of the common trigrams and codes of the others.  The sets of a group of at most
    GROUP_TEXTS texts are compared in one task.  The equal sets of a larger group count once and are cut into blocks of
    about that size; a block is a row, and pairs of rows are compared where tasks read them, so that what is
    written and shuffled grows with the sets, not with their pairs.  In a group of many blocks, first a block is compared
    with a few sets of each size near its own, which finds most of the large classes.  Then all pairs of blocks are compared, but for
    sets that are of one class already.  Memory is bounded; the work grows with the square of the largest group.
    """
    named = texts.select(F.col(group).alias("grp"), F.col(key).cast("long").alias("key"), "text")
    named = named.where("grp IS NOT NULL AND key IS NOT NULL AND text IS NOT NULL")
    sets = written(_gram_sets(named), "gram-sets")
    over = (F.count("*") > GROUP_TEXTS) | (F.sum(F.octet_length("rest")) > 8 * GROUP_GRAMS)
    large = written(sets.groupBy("grp").agg(over.alias("over")).where("over").select("grp"), "large-groups")
    classes = _local_classes(sets.join(F.broadcast(large), "grp", "left_anti"), threshold)
    if not large.isEmpty():
        rows = sets.join(F.broadcast(large), "grp").withColumn("hash", F.sha2(F.concat("bits", "rest"), 256))
        nodes = rows.groupBy("grp", "hash").agg(F.min("key").alias("node"), *[F.first(c).alias(c) for c in ("n", "bits", "rest")])
        nodes = written(nodes, "gram-nodes")
        known = _block_classes(nodes, threshold).select("node", "class_id")
        known = nodes.select("grp", "hash", "node").join(known, "node").select("grp", "hash", "class_id")
        classes = classes.union(rows.select("grp", "key", "hash").join(known, ["grp", "hash"]).select("grp", "key", "class_id"))
    return classes.select(F.col("grp").alias(group), F.col("key").cast(texts.schema[key].dataType).alias(key), "class_id")


def _local_classes(sets: DataFrame, threshold: float) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        least = keys = table["key"].to_numpy()
        if len(keys) > 1:
            s = _Sets(*_packed(table))
            linked = _links(s, s, np.triu(np.ones((len(keys), len(keys)), bool), 1), threshold)
            least = _least(linked | linked.T, keys)
        return pa.table({"grp": table["grp"], "key": table["key"], "class_id": pa.array(least)})

    return sets.groupBy("grp").applyInArrow(run, sets.select("grp", "key").schema.add("class_id", "long"))


def _block_classes(nodes: DataFrame, threshold: float) -> DataFrame:
    """``node`` and ``class_id`` of the sets of large groups."""
    labelled = nodes.withColumn("label", F.col("node")).withColumn("cell", F.lit(""))
    if nodes.groupBy("grp").count().where(F.col("count") > FEW_BLOCKS * GROUP_TEXTS).isEmpty():
        return _all_pairs(labelled, threshold)
    blocks = _blocks(labelled, threshold)
    first = _block_links(blocks, threshold, "b.part = 0 AND abs(a.size - b.size) <= 1", 128)
    first = written(connected_components(first), "first-classes")
    discard(blocks)
    sizes = written(first.groupBy(F.col("component").alias("label")).agg((F.count("*") * 2 >= GROUP_TEXTS).alias("big")).where("big"), "big-classes")
    labelled = nodes.join(first, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    labelled = labelled.join(sizes, "label", "left").withColumn("cell", F.when(F.col("big"), F.col("label").cast("string")).otherwise(""))
    return _all_pairs(labelled, threshold)


def _all_pairs(labelled: DataFrame, threshold: float) -> DataFrame:
    """Classes of sets from all pairs of their blocks; two blocks of one cell with a name are of one class."""
    blocks = _blocks(labelled, threshold)
    found = written(connected_components(_block_links(blocks, threshold, "a.id <= b.id AND (a.cell = '' OR a.cell != b.cell)")), "all-classes")
    discard(blocks)
    found = found.select(F.col("node").alias("label"), "component")
    return labelled.select("node", "label").join(found, "label", "left").select("node", F.coalesce("component", "label").alias("class_id"))


def _blocks(nodes: DataFrame, threshold: float) -> DataFrame:
    """The sets of a cell that are of about one size, as rows of at most about GROUP_TEXTS of them."""
    sized = nodes.withColumn("size", F.floor(F.log("n") * (2 / -math.log(threshold))).cast("long"))
    count = F.ceil(F.greatest(F.count("*") / GROUP_TEXTS, F.sum(F.octet_length("rest")) / (8 * GROUP_GRAMS))).cast("long")
    sizes = written(sized.groupBy("grp", "cell", "size").agg(count.alias("blocks")), "gram-sizes")
    placed = sized.join(F.broadcast(sizes), ["grp", "cell", "size"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")))
    names = ["grp", "cell", "size", "part"]
    placed = placed.select(*names, "node", "label", "n", "bits", "rest")

    def run(table: pa.Table) -> pa.Table:
        n, bits, rest, lengths = _packed(table)
        made = {c: [table[c].to_numpy().tobytes()] for c in ("node", "label")}
        made |= {"n": [n.tobytes()], "bits": [bits], "rest": [rest], "lengths": [lengths.tobytes()]}
        made |= {"least": pa.array([n.min()], pa.int64()), "most": pa.array([n.max()], pa.int64())}
        return pa.table({c: table[c].slice(0, 1) for c in names} | made)

    schema = placed.select(*names).schema
    for c in ("node", "label", "n", "bits", "rest", "lengths"):
        schema = schema.add(c, "binary")
    rows = placed.groupBy(*names).applyInArrow(run, schema.add("least", "long").add("most", "long"))
    return written(rows.withColumn("id", F.struct("cell", "size", "part")), "gram-blocks")


def _block_links(blocks: DataFrame, threshold: float, which: str, most: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` that span what pairs of blocks join of their sets' labels; ``most`` sets of the second count."""
    spark = blocks.sparkSession
    # a task reads some blocks of each side, and keeps those of one
    parts = max(math.ceil(blocks.count() / 32), math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)))
    a, b = (blocks.repartition(parts).alias(s) for s in "ab")
    sizes = f"a.most >= {threshold - 1e-9} * b.least AND b.most >= {threshold - 1e-9} * a.least"
    fields = ("label", "n", "bits", "rest", "lengths")
    pairs = a.join(b.hint("shuffle_replicate_nl"), F.expr(f"a.grp = b.grp AND {sizes} AND ({which})"))
    pairs = pairs.select(F.expr("a.id = b.id").alias("same"), *[F.col(f"{s}.{c}").alias(s + c) for s in "ab" for c in fields])

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                sets, labels = [], []
                for s, some in (("a", None), ("b", most)):
                    n, lengths, label = (np.frombuffer(row[s + c], np.int64) for c in ("n", "lengths", "label"))
                    sets.append(_Sets(n, row[s + "bits"], row[s + "rest"], lengths).first(some))
                    labels.append(label[:some])
                apart = labels[0][:, None] != labels[1][None]
                if row["same"] and most is None:
                    apart = np.triu(apart)
                r, c = np.nonzero(_links(*sets, apart, threshold))
                if len(r):
                    names, at = np.unique(np.concatenate((labels[0][r], labels[1][c])), return_inverse=True)
                    linked = np.zeros((len(names), len(names)), bool)
                    linked[at[: len(r)], at[len(r) :]] = True
                    least = _least(linked | linked.T, names)
                    yield pa.RecordBatch.from_arrays([pa.array(names[least != names]), pa.array(least[least != names])], ["a", "b"])

    small_batches(spark)
    return pairs.mapInArrow(run, "a long, b long")


def with_history(turns: DataFrame, last: int = 10) -> DataFrame:
    """Each turn with up to ``last`` turns before it, oldest first."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)
    return turns.withColumn("history", F.collect_list(F.struct("turn", "role", "text")).over(w))
