"""Answer audit: markers, citations, granularity, refusals, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The event order that a request follows.
EVENT_ORDER = (
    "query_received",
    "query_analyzed",
    "retrieval_started",
    "retrieval_completed",
    "reranking_completed",
    "generation_started",
    "citation_validation",
    "answer_completed",
)
ANSWER = "answer string, answerable boolean, citations array<struct<evidence_id:string,source_url:string,quote:string>>"


def parse_answers(rows: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Model answers parsed, with ``malformed``: the first thing wrong, or null."""
    kind = lambda p: F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), p, "variant"))
    whole = F.try_parse_json(raw)
    parsed = F.from_json(F.col(raw), ANSWER)
    ids = F.coalesce(parsed["citations"], F.array().cast("array<struct<evidence_id:string,source_url:string,quote:string>>"))
    reason = (
        F.when(whole.isNull() | ~F.startswith(F.coalesce(F.schema_of_variant(whole), F.lit("")), F.lit("OBJECT")), "no_json_object")
        .when(~F.coalesce(kind("$.answer") == "STRING", F.lit(False)), "malformed_answer")
        .when(~F.coalesce(kind("$.answerable") == "BOOLEAN", F.lit(False)), "malformed_answer")
        .when(~F.coalesce(F.startswith(kind("$.citations"), F.lit("ARRAY")), F.lit(True)), "malformed_citations")
        .when(F.exists(ids, lambda c: c.isNull()), "non_object_citation")
        .when(F.exists(ids, lambda c: F.coalesce(c["evidence_id"], F.lit("")) == ""), "citation_without_id")
    )
    return rows.select("*", reason.alias("malformed"), F.when(reason.isNull(), parsed).alias("parsed"))


def resolve_markers(answers: DataFrame) -> DataFrame:
    """``answer`` and ``served`` (ids) to ``resolved_text``, ``cited_ids`` and ``rejected_markers``.

    ``[En]`` becomes the rank at which the n-th served id first appears; markers of what
    was not served are removed and listed.
    """
    numbers = F.transform(F.regexp_extract_all("answer", F.lit(r"\[E(\d+)\]"), 1), lambda n: n.cast("int"))
    known = lambda n: n.between(1, F.size("served"))
    cited = F.array_distinct(F.transform(F.filter(numbers, known), lambda n: F.element_at("served", n)))
    rejected = F.transform(F.filter(numbers, lambda n: ~F.coalesce(known(n), F.lit(False))), lambda n: F.concat(F.lit("E"), n.cast("string")))
    rows = answers.withColumn("cited_ids", cited).withColumn("rejected_markers", rejected)
    pieces = F.split(F.regexp_replace("answer", r"(\[E\d+\])", "\x01$1\x01"), "\x01")

    def shown(p: Column) -> Column:
        n = F.regexp_extract(p, r"^\[E(\d+)\]$", 1)
        rank = F.array_position("cited_ids", F.get(F.col("served"), n.try_cast("int") - 1))
        link = F.when(F.coalesce(rank, F.lit(0)) > 0, F.concat(F.lit("["), rank.cast("string"), F.lit("]"))).otherwise("")
        return F.when(n != "", link).otherwise(p)

    text = F.array_join(F.transform(pieces, shown), "")
    return rows.withColumn("resolved_text", T.stripped(F.regexp_replace(text, "[ \t]{2,}", " ")))


def all_cited(marked: Column | str, listed: Column | str) -> Column:
    """Ids of markers, then ids that the model listed, order kept."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.array_union(c(marked), c(listed))


def validate_citations(cited: DataFrame, served: DataFrame) -> DataFrame:
    """``cited`` (answer_id, pos, evidence_id, link) against ``served`` (answer_id,
    evidence_id, source_url, ...): one row per distinct id with ``state``.

    rejected: not served; repaired: the link is missing or differs; valid otherwise.  The
    URL always comes from the registry.
    """
    w = Window.partitionBy("answer_id", "evidence_id").orderBy("pos")
    first = cited.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    joined = first.join(served.withColumn("_s", F.lit(True)), ["answer_id", "evidence_id"], "left")
    link = F.coalesce("link", F.lit(""))
    state = (
        F.when(F.col("_s").isNull(), "rejected")
        .when((link == "") | (link != F.col("source_url")), "repaired")
        .otherwise("valid")
    )
    note = F.when(F.col("_s") & (link == ""), "no link given").when(F.col("_s") & (link != F.col("source_url")), "link replaced")
    return joined.select("*", state.alias("state"), note.alias("note")).drop("_s")


def validation_counts(validated: DataFrame) -> DataFrame:
    """Counts per answer.  A rejected id counts as stripped and as rejected."""
    n = lambda s, name: F.count_if(F.col("state") == s).alias(name)
    return validated.groupBy("answer_id").agg(
        n("valid", "valid"), n("rejected", "stripped"), n("repaired", "repaired"), n("rejected", "rejected")
    )


def granularity(marked: Column | str, cited: Column | str) -> Column:
    c = lambda x: F.size(F.col(x) if isinstance(x, str) else x)
    return F.when(c(marked) > 0, "per_claim").when(c(cited) > 0, "list").otherwise("none")


def outcomes(rows: DataFrame) -> DataFrame:
    """``outcome`` and ``refusal_reason`` of each question, from the gate to the citations."""
    reason = (
        F.when(F.col("refused") | (F.coalesce("n_evidence", F.lit(0)) == 0), "INSUFFICIENT_EVIDENCE")
        .when(~F.coalesce("answerable", F.lit(False)), "INSUFFICIENT_EVIDENCE")
        .when(T.verdict("verdict") != "SUPPORTED", "VERIFICATION_FAILED")
        .when(F.col("granularity") == "none", "INSUFFICIENT_EVIDENCE")
        .when(F.col("n_uncited") > 0, "VERIFICATION_FAILED")
    )
    return rows.select("*", F.when(reason.isNull(), "answered").otherwise("refused").alias("outcome"), reason.alias("refusal_reason"))


def citation_groups(citations: DataFrame) -> DataFrame:
    """Citations of an answer by product, ordered by rank inside."""
    product = F.coalesce("product", F.lit("unclassified")).alias("product")
    return citations.groupBy("answer_id", product).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "source_url"))), lambda x: x["source_url"]).alias("sources")
    )


def source_summary(citations: DataFrame) -> DataFrame:
    """Distinct pages and products per answer, and a sentence that says so."""
    out = citations.groupBy("answer_id").agg(
        F.array_sort(F.collect_set("source_url")).alias("pages"), F.array_sort(F.collect_set("product")).alias("products")
    )
    n, m = F.size("pages"), F.size("products")
    plural = lambda k: F.when(k == 1, "").otherwise("s")
    said = F.format_string("%d page%s from %d product%s", n, plural(n), m, plural(m))
    return out.withColumn("n_pages", n).withColumn("n_products", m).withColumn("summary", said)


def audit_rows(logs: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log rows, citations to append and citations set aside: a bad citation never costs
    its log row."""
    good = (
        (F.col("rank") > 0)
        & F.col("validation_state").isin("valid", "repaired", "stripped")
        & (F.length("quote") > 0)
        & F.coalesce(F.col("retrieval_score").between(0, 1), F.lit(True))
        & F.coalesce(F.col("rerank_score").between(0, 1), F.lit(True))
    )
    good = F.coalesce(good, F.lit(False))
    return logs, citations.where(good), citations.where(~good)


def numbered(events: DataFrame, key: str, at: str, tie: str, unit: str = "hour") -> DataFrame:
    """Events with ``number``, their place from 1 in the whole log of their key, by ``at`` and ``tie``.

    Places are found within each unit of time, and what came before a unit is added, so that no task
    sorts the whole log of a busy key.  Rows without a time come first.
    """
    rows = events.withColumn("_unit", F.date_trunc(unit, F.col(at)))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col(key).alias("_key"), F.col("_unit").alias("_of")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_unit").orderBy(at, tie)))
    same = placed[key].eqNullSafe(counts["_key"]) & placed["_unit"].eqNullSafe(counts["_of"])
    return placed.join(counts, same).select(*events.columns, (F.col("_before") + F.col("_place")).alias("number"))


def event_order(events: DataFrame) -> DataFrame:
    """Events (request_id, sequence, name) to one row per request: ``in_order``, ``n_terminal``
    and ``ok``.  Each event follows the one before it in the order; generation may repeat;
    ``error`` may stand for the last."""
    w = Window.partitionBy("request_id").orderBy("sequence")
    place = F.array_position(F.array(*[F.lit(n) for n in EVENT_ORDER]), F.col("name"))
    rows = events.withColumn("_at", F.when(F.col("name") == "error", 99).otherwise(place)).withColumn("_before", F.lag("_at").over(w))
    before = F.coalesce("_before", F.lit(0))
    fine = (
        F.when(F.col("name") == "error", ~before.isin(8, 99))
        .when(F.col("_at") == 0, False)
        .otherwise((F.col("_at") == before + 1) | ((F.col("_at") == 6) & (before == 6)))
    )
    out = rows.withColumn("_ok", fine).groupBy("request_id").agg(
        F.min("_ok").alias("in_order"), F.count_if(F.col("name").isin("answer_completed", "error")).alias("n_terminal")
    )
    return out.withColumn("ok", F.col("in_order") & (F.col("n_terminal") == 1))
