"""Registry tables: change plans, snapshots, counters, integrity, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULTS, Settings

RESERVED_KEYS = ("_id", "id", "chunk_text")


# -- change plans ----------------------------------------------------------------------


def page_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New pages (source_id, url, fingerprint) with ``change``: supersede or unchanged."""
    before = old.select("source_id", "url", F.col("fingerprint").alias("old_fingerprint"))
    changed = F.col("old_fingerprint").isNull() | (F.col("old_fingerprint") != F.col("fingerprint"))
    return new.join(before, ["source_id", "url"], "left").withColumn(
        "change", F.when(changed, "supersede").otherwise("unchanged")
    )


def supersession_plan(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new units, by document and ordinal, to one row each with ``action``:
    write, unchanged, supersede (written under the same id) or orphan (deleted)."""
    keys = ["document_id", "ordinal"]
    a = stored.select(*keys, F.col("text_fingerprint").alias("old_fingerprint"), "vector_id")
    b = new.select(*keys, F.col("text_fingerprint").alias("new_fingerprint"))
    action = (
        F.when(F.col("new_fingerprint").isNull(), "orphan")
        .when(F.col("old_fingerprint").isNull(), "write")
        .when(F.col("old_fingerprint") == F.col("new_fingerprint"), "unchanged")
        .otherwise("supersede")
    )
    return a.join(b, keys, "full_outer").select(
        *keys, F.coalesce("vector_id", T.vector_id("document_id", "ordinal")).alias("vector_id"), action.alias("action")
    )


def page_outcomes(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents after a crawl: ``outcomes`` (document_id, ok, code) move the state to
    processed or failed; a failed page keeps its vectors, a deleted one is untouched."""
    joined = documents.join(outcomes.select("document_id", "ok", "code"), "document_id", "left")
    touched = F.col("ok").isNotNull() & (F.col("state") != "deleted")
    detail = F.to_json(F.struct(F.col("code")))
    return joined.select(
        *[c for c in documents.columns if c not in ("state", "state_detail")],
        F.when(touched, F.when(F.col("ok"), "processed").otherwise("failed")).otherwise(F.col("state")).alias("state"),
        F.when(touched & ~F.col("ok"), detail).when(touched, F.lit(None)).otherwise(F.col("state_detail")).alias("state_detail"),
    )


def bad_transitions(history: DataFrame) -> DataFrame:
    """History rows (document_id, at, state) that leave the state deleted."""
    w = Window.partitionBy("document_id").orderBy("at")
    return history.withColumn("before", F.lag("state").over(w)).where("before = 'deleted' AND state != 'deleted'")


# -- snapshots -------------------------------------------------------------------------


def _one_per_key(rows: DataFrame, key: list[str], *first: Column) -> DataFrame:
    """Of the rows with one key one, by ``first`` and then by all they hold as text."""
    if not first:  # a grouped minimum, of which each task sends one row for each key
        return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(
            F.min_by(F.struct(*rows.columns), F.to_json(F.struct(*rows.columns))).alias("_row")
        ).select("_row.*")
    w = Window.partitionBy(*key).orderBy(*first, F.to_json(F.struct(*rows.columns)))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(current: DataFrame, new: DataFrame, key: str | list[str], newest: str | None = None) -> DataFrame:
    """The current rows that no new row replaces, and of the new rows with one key the one
    with the greatest ``newest``, ties being broken by what the rows hold.  Applied twice
    it gives the same."""
    key = [key] if isinstance(key, str) else key
    new = _one_per_key(new, key, *([F.col(newest).desc()] if newest else []))
    return current.join(new.select(*key), key, "left_anti").unionByName(new)


def upsert_counts(new: DataFrame, key: str | list[str], newest: str | None = None) -> DataFrame:
    """One row: how many records were ``submitted``, and how many an upsert has ``written``."""
    key = [key] if isinstance(key, str) else key
    return new.groupBy(*key).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("submitted"), F.count("*").alias("written")
    )


def delete_ids(current: DataFrame, ids: DataFrame, key: str = "vector_id") -> DataFrame:
    """Current rows without those ids.  An empty list of ids is refused."""
    if ids.isEmpty():
        raise ValueError("no ids to delete")
    return current.join(ids.select(key).distinct(), key, "left_anti")


def delete_count(current: DataFrame, ids: DataFrame, key: str = "vector_id") -> DataFrame:
    """One row: how many rows ``delete_ids`` takes away."""
    return current.join(ids.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("deleted"))


def fetch_ids(current: DataFrame, ids: DataFrame, key: str = "vector_id") -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_semi")


def lookup(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row per id asked for, with ``found``."""
    mark = current.withColumn("found", F.lit(True))
    return ids.select(key).distinct().join(mark, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def index_records(units: DataFrame, documents: DataFrame) -> DataFrame:
    """Units as records: vector_id, text and flat metadata, null values left out."""
    joined = units.join(documents.select("document_id", "source_id", "url", "title", "product", "category"), "document_id")
    pairs = [(n, F.col(n).cast("string")) for n in ("document_id", "source_id", "url", "title", "product", "category")]
    pairs += [("ordinal", F.col("ordinal").cast("string")), ("heading", T.display_heading("heading_path"))]
    whole = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[v for _, v in pairs]))
    return joined.select(
        T.vector_id("document_id", "ordinal").alias("vector_id"),
        "text",
        F.map_filter(whole, lambda _, v: v.isNotNull()).alias("metadata"),
    )


def reserved_key_violations(records: DataFrame) -> DataFrame:
    clash = F.array_intersect(F.map_keys("metadata"), F.array(*[F.lit(k) for k in RESERVED_KEYS]))
    return records.withColumn("clash", clash).where(F.size("clash") > 0).select("vector_id", "clash")


def vector_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("namespace").agg(F.count("*").alias("n_vectors"))


def cascade_delete(documents: DataFrame, units: DataFrame, sources: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Documents of the given sources become tombstones and lose their units."""
    gone = documents.join(sources.select("source_id").distinct(), "source_id", "left_semi").select("document_id")
    marked = documents.join(gone.withColumn("_gone", F.lit(True)), "document_id", "left")
    fresh = F.col("_gone") & F.col("tombstoned_at").isNull()
    out = marked.select(
        *[c for c in documents.columns if c not in ("state", "vectors_live", "tombstoned_at")],
        F.when(F.col("_gone"), "deleted").otherwise(F.col("state")).alias("state"),
        F.when(F.col("_gone"), False).otherwise(F.col("vectors_live")).alias("vectors_live"),
        F.when(fresh, at).otherwise(F.col("tombstoned_at")).alias("tombstoned_at"),
    )
    return out, units.join(gone, "document_id", "left_anti")


def register_new(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not there yet, once each; of several the first by what they hold."""
    return _one_per_key(new, key).join(current.select(*key), key, "left_anti")


def admit_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (source_id, job_id, requested_at) with ``admitted`` and, if refused, the
    ``running_job``: a source has one active job at most."""
    active = jobs.where(F.col("status").isin("queued", "running")).groupBy("source_id").agg(F.min("job_id").alias("running"))
    w = Window.partitionBy("source_id").orderBy("requested_at", "job_id")
    rows = requests.withColumn("_first", F.first("job_id").over(w)).join(active, "source_id", "left")
    admitted = F.col("running").isNull() & (F.col("job_id") == F.col("_first"))
    return rows.select(
        *requests.columns,
        admitted.alias("admitted"),
        F.when(~admitted, F.coalesce("running", "_first")).alias("running_job"),
    )


def patch(current: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Only the fields named in a patch's ``set_fields`` change; a null there clears."""
    p = patches.select(key, "set_fields", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = current.join(p, key, "left")
    pick = lambda f: F.when(F.array_contains("set_fields", f), F.col(f"_{f}")).otherwise(F.col(f)).alias(f)
    return joined.select(*[pick(c) if c in fields else F.col(c) for c in current.columns])


# -- counters --------------------------------------------------------------------------


def crawl_counters(outcomes: DataFrame, job: str = "job_id") -> DataFrame:
    """``outcomes`` (job, outcome, units, rejected, vectors) to a row of counters per job."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names)).alias(names[0])
    return (
        outcomes.groupBy(job)
        .agg(
            F.count("*").alias("discovered"),
            F.count_if(F.col("outcome").isin("processed", "unchanged")).alias("processed"),
            n("unchanged"),
            n("skipped"),
            n("failed"),
            F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"),
            F.coalesce(F.sum("vectors"), F.lit(0)).alias("vectors"),
        )
        .withColumn("indexed", F.col("processed") - F.col("unchanged"))
    )


def skip_reasons(skips: DataFrame, job: str = "job_id") -> DataFrame:
    """Reasons of a job as a sorted map to their counts."""
    counts = skips.groupBy(job, "reason").count()
    pairs = F.array_sort(F.collect_list(F.struct("reason", "count")))
    return counts.groupBy(job).agg(F.map_from_entries(pairs).alias("skipped_reasons"))


def job_status(counters: DataFrame) -> DataFrame:
    """A finished job's ``status``: completed, with errors if any page failed."""
    return counters.withColumn("status", F.when(F.col("failed") == 0, "completed").otherwise("completed_with_errors"))


def source_status(enabled: Column, stored: Column) -> Column:
    """The status shown: disabling wins, and an unknown stored value is an error."""
    known = stored.isin("active", "disabled", "error")
    return F.when(~enabled, "disabled").when(known, stored).otherwise("error")


def after_crawl(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """``sources`` with the ``status`` and ``last_crawl_at`` that their last finished job
    (source_id, job_id, status, indexed, finished_at) leaves: error if it failed or indexed
    nothing, else active unless the source is disabled.  Without a job nothing changes."""
    last = latest_per(jobs.where("finished_at IS NOT NULL"), "source_id", "finished_at", "job_id")
    last = last.select("source_id", F.col("status").alias("_job"), F.col("indexed").alias("_indexed"), F.col("finished_at").alias("_at"))
    bad = (F.col("_job") == "failed") | (F.coalesce("_indexed", F.lit(0)) == 0)
    status = F.when(F.col("_at").isNull() | (~bad & (F.col("status") == "disabled")), F.col("status")).otherwise(
        F.when(bad, "error").otherwise("active")
    )
    kept = [c for c in sources.columns if c not in ("status", "last_crawl_at")]
    return sources.join(last, "source_id", "left").select(
        *kept, status.alias("status"),
        (F.coalesce("_at", "last_crawl_at") if "last_crawl_at" in sources.columns else F.col("_at")).alias("last_crawl_at"),
    )


def source_overview(sources: DataFrame, documents: DataFrame, units: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sources with live counts, their status as shown, and their latest job or null."""
    last = latest_per(jobs, "source_id", "requested_at", "job_id")
    last = last.select("source_id", F.col("job_id").alias("latest_job"), F.col("status").alias("latest_status"))
    shown = live_counts(sources, documents, units).withColumn("status", source_status(F.col("enabled"), F.col("status")))
    return shown.join(last, "source_id", "left")


def live_counts(sources: DataFrame, documents: DataFrame, units: DataFrame) -> DataFrame:
    """Sources with live documents and units, 0 where there are none."""
    live = documents.where("state != 'deleted'")
    docs = live.groupBy("source_id").agg(F.count("*").alias("n_documents"))
    n_units = live.select("document_id", "source_id").join(units, "document_id").groupBy("source_id").agg(F.count("*").alias("n_units"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sources.join(docs, "source_id", "left").join(n_units, "source_id", "left").select(
        *sources.columns, zero("n_documents"), zero("n_units")
    )


def unit_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("document_id").agg(F.count("*").alias("n_units"))


def corpus_totals(sources: DataFrame, documents: DataFrame, units: DataFrame) -> DataFrame:
    live = documents.where("state != 'deleted'")
    return (
        sources.agg(F.count("*").alias("n_sources"))
        .join(live.agg(F.count("*").alias("n_documents")))
        .join(units.join(live, "document_id", "left_semi").agg(F.count("*").alias("n_units")))
    )


def latest_per(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Of each key the row with the greatest ``at``, and of those the greatest ``tie``."""
    last = F.max_by(F.struct(*rows.columns), F.struct(at, tie)).alias("_row")
    return rows.groupBy(F.col(key).alias("_key")).agg(last).select("_row.*")


def listing(
    rows: DataFrame, at: str, tie: str, offset: int, limit: int, ascending: bool = False, after: tuple | None = None, **equals
) -> tuple[DataFrame, DataFrame]:
    """One page of the rows that match, newest first or in ascending order, and how many
    match in all.  ``after`` is the (at, tie) of the row that the page follows: with it, and an offset of
    0, a page far down costs a filter and the rows of the page, not a sort of all before it."""
    for name, value in equals.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in (at, tie)]
    page = rows
    if after is not None:
        beyond = (lambda c, v: F.col(c) > F.lit(v)) if ascending else (lambda c, v: F.col(c) < F.lit(v))
        page = rows.where(beyond(at, after[0]) | (F.col(at) == F.lit(after[0])) & beyond(tie, after[1]))
    page = page.orderBy(*order)
    return (page.offset(offset) if offset else page).limit(limit), rows.agg(F.count("*").alias("total"))


def source_documents(documents: DataFrame, source_id, include_deleted: bool = False) -> DataFrame:
    rows = documents.where(F.col("source_id") == source_id)
    return (rows if include_deleted else rows.where("state != 'deleted'")).orderBy("created_at", "document_id")


def expired(rows: DataFrame, at: str, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    return rows.where(F.col(at) < now - F.make_dt_interval(F.lit(settings.retention_days)))


def purge(logs: DataFrame, citations: DataFrame, now: Column, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Log rows within the retention and the citations that belong to them."""
    kept = logs.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(settings.retention_days)))
    return kept, citations.join(kept.select("log_id"), "log_id", "left_semi")


def orphaned_runs(runs: DataFrame, cutoff: Column) -> DataFrame:
    stale = F.col("status").isin("queued", "running") & (F.col("started_at") < cutoff)
    return runs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


# -- integrity -------------------------------------------------------------------------

#: predicates that hold for every row of a registry table; a null counts as true
CHECKS = {
    "sources": {
        "max_pages_positive": "max_pages > 0",
        "max_depth_not_negative": "max_depth >= 0",
        "delay_not_negative": "delay_seconds >= 0",
        "domains_not_empty": "size(allowed_domains) > 0",
    },
    "documents": {
        "state_known": "state IN ('discovered', 'processed', 'indexed', 'unchanged', 'failed', 'deleted')",
        "tombstone_means_deleted": "tombstoned_at IS NULL OR state = 'deleted'",
        "deleted_has_no_vectors": "state != 'deleted' OR NOT vectors_live",
    },
    "units": {
        "ordinal_not_negative": "ordinal >= 0",
        "tokens_positive": "token_count > 0",
        "overlap_not_negative": "overlap_tokens >= 0",
    },
    "crawl_jobs": {
        "status_known": "status IN ('queued', 'running', 'completed', 'completed_with_errors', 'failed', 'cancelled')",
    },
    "query_logs": {
        "outcome_known": "outcome IN ('answered', 'refused', 'error')",
        "outcome_payload": "CASE outcome WHEN 'answered' THEN answer IS NOT NULL AND refusal_reason IS NULL"
        " WHEN 'refused' THEN answer IS NULL AND refusal_reason IS NOT NULL WHEN 'error' THEN answer IS NULL ELSE false END",
        "latency_not_negative": "total_latency_ms >= 0",
    },
    "citations": {
        "rank_positive": "rank > 0",
        "state_known": "validation_state IN ('valid', 'stripped', 'repaired')",
        "quote_not_empty": "length(quote) > 0",
        "scores_in_range": "retrieval_score BETWEEN 0 AND 1 AND rerank_score BETWEEN 0 AND 1",
    },
    "questions": {
        "category_known": "category IN ('simple_lookup', 'multi_part', 'cross_product', 'troubleshooting', 'permissions',"
        " 'api', 'ambiguous', 'unsupported')",
        "difficulty_known": "difficulty IN ('easy', 'medium', 'hard')",
        "topics_not_empty": "size(topics) > 0",
        "question_not_empty": "question != ''",
        "unsupported_refuses": "NOT is_unsupported OR must_refuse",
    },
    "runs": {
        "gate_known": "gate_outcome IN ('pass', 'fail')",
        "status_known": "status IN ('queued', 'running', 'completed', 'failed')",
        "count_not_negative": "question_count >= 0",
        "time_order": "finished_at >= started_at",
    },
    "results": {
        "fabricated_not_negative": "fabricated_fact_count >= 0",
        "invalid_not_negative": "invalid_citation_count >= 0",
        "latency_not_negative": "latency_ms >= 0",
    },
}
UNIQUE = {
    "sources": {"start_url": ["start_url"]},
    "documents": {"source_url": ["source_id", "url"]},
    "units": {"vector_id": ["vector_id"], "document_ordinal": ["document_id", "ordinal"]},
    "crawl_jobs": {"one_active_job": ["CASE WHEN status IN ('queued', 'running') THEN source_id END"]},
    "citations": {"log_rank": ["log_id", "rank"]},
    "results": {"run_question": ["run_id", "question_id"]},
}


def registry_violations(name: str, rows: DataFrame, key: str) -> DataFrame:
    """Violations of a registry table's own rules."""
    return violations(rows, key, CHECKS[name], UNIQUE.get(name))


def violations(rows: DataFrame, key: str, checks: dict[str, str], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """``rule`` and ``key`` of every row that breaks a rule; the key of a uniqueness rule is
    the smallest of the rows that share the values."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(e), F.lit(True)), F.lit(n)) for n, e in checks.items()]))
    key_text = F.col(key).cast("string").alias("key")
    out = rows.select(F.explode(failed).alias("rule"), key_text)
    for name, columns in (unique or {}).items():
        some = rows.where(" AND ".join(f"({c}) IS NOT NULL" for c in columns))
        twice = some.groupBy(*[F.expr(c) for c in columns]).agg(F.min(key).cast("string").alias("key"), F.count("*").alias("n")).where("n > 1")
        out = out.union(twice.select(F.lit(name).alias("rule"), "key"))
    return out
