"""Evaluation: grades per question, run metrics, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULTS, Settings
from ..storage import written

#: metrics that must be zero, and metrics where less is better
ABSOLUTE = ("fabricated_fact_count", "invalid_citation_count")
AT_MOST = ("p95_latency_ms",)
METRICS = (
    "recall_at_5",
    "precision_at_5",
    "mrr",
    "cross_product_domain_coverage",
    "citation_validity",
    "claim_coverage",
    "faithfulness",
    "unsupported_refusal_rate",
    "fabricated_fact_count",
    "invalid_citation_count",
    "p50_latency_ms",
    "p95_latency_ms",
    "error_rate",
)


def gold_inconsistencies(gold: DataFrame) -> DataFrame:
    """Questions whose category, flag and expected refusal disagree, and repeated ids."""
    disagree = (F.col("category") == "unsupported") != F.col("is_unsupported")
    refuse = F.col("is_unsupported") & ~F.coalesce("must_refuse", F.lit(False))
    reasons = F.array_compact(F.array(F.when(disagree, "category_flag"), F.when(refuse, "must_refuse")))
    twice = gold.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("reason"))
    return gold.select("id", F.explode(reasons).alias("reason")).union(twice)


def ranked_candidates(retrieved: DataFrame, reranked: DataFrame) -> DataFrame:
    """Rerank rows over retrieval rows of a question; retrieval alone where nothing was
    reranked.  ``place`` orders them, null ranks last."""
    keys = ["question_id", "id"]
    over = reranked.select(*keys, F.col("rank").alias("_r")).join(retrieved, keys, "left").withColumn("rank", F.col("_r")).drop("_r")
    rest = retrieved.join(reranked.select("question_id").distinct(), "question_id", "left_anti")
    w = Window.partitionBy("question_id").orderBy(F.col("rank").asc_nulls_last(), "id")
    return over.select(retrieved.columns).unionByName(rest).withColumn("place", F.row_number().over(w))


def retrieval_grades(gold: DataFrame, ranked: DataFrame, hit: Column, top: int = 5) -> DataFrame:
    """Per question ``recall_at_5``, ``precision_at_5`` and ``mrr``.

    ``ranked`` (question_id, place, ...) is cut at ``top``; precision divides by what was
    returned; without candidates the grades are 0, for an unsupported question null.
    """
    rows = gold.join(ranked.where(F.col("place") <= top), "question_id", "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    got = rows.groupBy("question_id").agg(
        F.max("is_unsupported").alias("_u"),
        F.count("place").alias("_n"),
        F.count_if(F.col("_hit") & F.col("place").isNotNull()).alias("_h"),
        F.min(F.when(F.col("_hit"), F.col("place"))).alias("_first"),
    )
    graded = lambda c: F.when(~F.coalesce("_u", F.lit(False)), c)
    return got.select(
        "question_id",
        graded((F.col("_h") > 0).cast("double")).alias("recall_at_5"),
        graded(F.coalesce(F.try_divide("_h", "_n"), F.lit(0.0))).alias("precision_at_5"),
        graded(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"),
    )


def results_with_gold(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Stored results of runs with what the gold set says of their questions; a question that the set has lost
    keeps its result.  Both stored in buckets of question_id meet without a shuffle."""
    gold = questions.select("question_id", *[F.col(c) for c in questions.columns if c not in results.columns])
    return results.join(gold, "question_id", "left")


def topic_hit() -> Column:
    return T.unit_covers(F.col("product"), F.col("heading_path"), F.col("want_product"), F.col("want_heading_path"))


def answer_grades(answers: DataFrame) -> DataFrame:
    """``answers`` (question_id, question, answer, quotes, topics) with text grades."""
    return answers.select(
        "question_id",
        T.claim_coverage("topics", "answer").alias("claim_coverage"),
        T.faithfulness("answer", "quotes").alias("faithfulness"),
        T.citation_completeness("answer").alias("citation_completeness"),
        T.fabricated_count("answer").alias("fabricated_fact_count"),
        T.answer_relevance("question", "answer").alias("answer_relevance"),
    )


def citation_grades(counts: DataFrame) -> DataFrame:
    """Validity and invalid count from validation counts.  A rejected id is in stripped and
    in rejected, hence counted twice; ``distinct`` columns count it once."""
    c = F.col
    return counts.select(
        "question_id",
        T.citation_validity(c("valid"), c("stripped"), c("rejected")).alias("citation_validity"),
        (c("stripped") + c("rejected")).alias("invalid_citation_count"),
        T.citation_validity(c("valid"), F.lit(0), c("rejected")).alias("citation_validity_distinct"),
        c("rejected").alias("invalid_citation_count_distinct"),
    )


def _same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """The two joined by their key columns, nulls being equal, the keys once."""
    there = right.select(*[F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in by:
        cond = cond & left[c].eqNullSafe(there[f"_{c}"])
    return left.join(there, cond, how).drop(*[f"_{c}" for c in by])


def nearest_ranks(
    rows: DataFrame, by: list[str], value: str, shares: dict[str, float], few: int = 1_000_000, cuts: int = 64
) -> DataFrame:
    """Nearest-rank percentiles of ``value`` by the key columns, a column for each share;
    nulls are ignored, and a key without a value has no row.

    No task gathers more than about ``few`` values of a key.  While a key has more, a
    sketch of its values gives cut points, exact counts between them tell between which
    two a rank lies, and only what lies there goes on; a rank that falls on a cut point is
    found.  The cut points follow the values, so outliers and infinite values move none.
    """
    some = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in shares.items()])).alias("_q")
    total = some.groupBy(*by).agg(F.count("*").alias("_n"))
    rest = F.greatest(F.ceil(F.col("_q.p") * F.col("_n")), F.lit(1)).alias("_rest")
    open_ = total.select(*by, "_n", asked).select(*by, F.col("_q.name").alias("_name"), rest, "_n")
    most = total.agg(F.max("_n")).first()[0] or 0
    names = [*by, "_name"]
    found = None
    if most > few:
        nothing = F.lit(None).cast(some.schema["_v"].dataType)
        open_ = open_.select("*", nothing.alias("_low"), nothing.alias("_high"))
        while most > few:
            at = F.array(*[F.lit(i / cuts) for i in range(cuts + 1)])
            points = _same(some, open_, by).where(_between("_v")).groupBy(*names).agg(
                F.array_sort(F.array_distinct(F.percentile_approx("_v", at, F.lit(cuts * 32)))).alias("_cuts")
            )
            # even places are the cut points, odd ones what lies after them
            ranges = written(_same(open_, points, names), "ranges")
            under = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
            equal = F.get("_cuts", under) == F.col("_v")
            placed = _same(some, ranges, by).where(_between("_v"))
            placed = placed.select(*names, F.when(equal, 2 * under).otherwise(2 * under - 1).alias("_bin"))
            counts = placed.groupBy(*names, "_bin").agg(F.count("*").alias("_c"))
            upto = F.sum("_c").over(Window.partitionBy(*names).orderBy("_bin"))
            counts = _same(counts.withColumn("_upto", upto), ranges, names)
            hit = counts.where((F.col("_rest") <= F.col("_upto")) & (F.col("_rest") > F.col("_upto") - F.col("_c")))
            i = F.floor(F.col("_bin") / 2).cast("int")
            exact = F.col("_bin") % 2 == 0
            hit = written(hit.select(
                *names, (F.col("_rest") - F.col("_upto") + F.col("_c")).alias("_rest"), F.col("_c").alias("_n"),
                F.coalesce(F.get("_cuts", i), "_low").alias("_low"), F.coalesce(F.get("_cuts", i + 1), "_high").alias("_high"),
                exact.alias("_exact"),
            ), "hit")
            done = hit.where("_exact").select(*names, F.col("_low").alias("_v"))
            found = done if found is None else found.unionByName(done)
            open_ = hit.where("NOT _exact").drop("_exact")
            most = open_.agg(F.max("_n")).first()[0] or 0
        close = _same(some, open_, by).where(_between("_v"))
    else:
        close = _same(some, open_, by)
    close = close.groupBy(*names, "_rest", "_v").agg(F.count("*").alias("_c"))
    close = close.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*names).orderBy("_v"))).where("_upto >= _rest")
    close = close.groupBy(*names).agg(F.min("_v").alias("_v"))
    found = close if found is None else found.unionByName(close)
    return found.groupBy(*by).agg(*[F.min(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in shares])


def _between(value: str) -> Column:
    """Strictly between two cut points; a bound that is null is none."""
    return (F.col("_low").isNull() | (F.col(value) > F.col("_low"))) & (F.col("_high").isNull() | (F.col(value) < F.col("_high")))


def run_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The 13 aggregates of a run; means ignore nulls, percentiles are nearest-rank."""
    by = by or []
    share = lambda cond, of: F.avg(F.when(of, cond.cast("int")))
    cross = F.size(F.array_distinct("searched_products")) >= 2
    plain = results.groupBy(*by).agg(
        *[F.avg(m).alias(m) for m in ("recall_at_5", "precision_at_5", "mrr")],
        share(cross, F.col("category") == "cross_product").alias("cross_product_domain_coverage"),
        *[F.avg(m).alias(m) for m in ("citation_validity", "claim_coverage", "faithfulness")],
        share(F.col("refused"), F.col("is_unsupported")).alias("unsupported_refusal_rate"),
        F.sum("fabricated_fact_count").alias("fabricated_fact_count"),
        F.sum("invalid_citation_count").alias("invalid_citation_count"),
        F.avg(F.col("error").cast("int")).alias("error_rate"),
    )
    ranks = nearest_ranks(results, by, "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    return _same(plain, ranks, by, "left").select(*by, *METRICS)


def gate(metrics: DataFrame, by: list[str] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per failed gate: ``gate``, ``target``, ``actual``.  Two counts must be zero;
    latency is at most its target, the rest at least; a null actual is no failure."""
    by = by or []
    targets = {m: 0.0 for m in ABSOLUTE} | settings.gates
    table = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    long = metrics.select(*by, *[F.col(m).cast("double").alias(m) for m in METRICS if m in metrics.columns]).unpivot(
        by, [m for m in METRICS if m in metrics.columns], "gate", "actual"
    )
    rows = long.withColumn("target", F.try_element_at(table, "gate"))
    over = F.col("gate").isin(*ABSOLUTE, *AT_MOST)
    failed = F.when(over, F.col("actual") > F.col("target")).otherwise(F.col("actual") < F.col("target"))
    return rows.where(failed).select(*by, "gate", "target", "actual")


def gate_outcome(metrics: DataFrame, run: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Per run ``outcome``, pass or fail, and the failures as a sorted list."""
    failures = gate(metrics, [run], settings).groupBy(run).agg(
        F.sort_array(F.collect_list(F.struct("gate", "target", "actual"))).alias("failures")
    )
    return metrics.select(run).join(failures, run, "left").withColumn(
        "outcome", F.when(F.col("failures").isNull(), "pass").otherwise("fail")
    )
