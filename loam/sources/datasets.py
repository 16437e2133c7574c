"""Declared inputs: source manifests, gold questions, registry tables, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..settings import DEFAULTS, Settings

MANIFEST = (
    "manifest_version string, sources array<struct<name:string,start_url:string,sitemap_url:string,scope_prefix:string,"
    "product_domain:string,allowed_domains:array<string>,max_pages:int,max_depth:int,delay_seconds:double,"
    "enabled:boolean,notes:string>>"
)
GOLD = (
    "version string, questions array<struct<id:string,question:string,category:string,difficulty:string,"
    "is_unsupported:boolean,expected:struct<must_refuse:boolean,product:string,category:string,"
    "heading_path:array<string>,topics:array<string>,notes:string>>>"
)
SCHEMAS = {
    "sources": "source_id string, name string, start_url string, sitemap_url string, scope_prefix string, product_domain string, allowed_domains array<string>, max_pages int, max_depth int, delay_seconds double, enabled boolean, status string, created_at timestamp",
    "documents": "document_id string, source_id string, url string, canonical_url string, title string, product string, category string, page_type string, language string, fingerprint string, state string, state_detail string, vectors_live boolean, tombstoned_at timestamp, created_at timestamp",
    "units": "document_id string, ordinal int, vector_id string, text string, text_fingerprint string, heading_path array<string>, block_types array<string>, token_count int, overlap_tokens int",
    "crawl_jobs": "job_id string, source_id string, status string, requested_at timestamp, started_at timestamp, finished_at timestamp, discovered bigint, processed bigint, unchanged bigint, skipped bigint, failed bigint, skipped_reasons map<string,bigint>",
    "query_logs": "log_id string, request_id string, question string, answer string, outcome string, refusal_reason string, total_latency_ms int, stage_latency_ms map<string,int>, trace string, created_at timestamp",
    "citations": "log_id string, rank int, evidence_id string, source_url string, quote string, validation_state string, retrieval_score double, rerank_score double",
    "questions": "question_id string, question string, category string, difficulty string, is_unsupported boolean, must_refuse boolean, want_product string, want_heading_path array<string>, topics array<string>",
    "runs": "run_id string, dataset_fingerprint string, status string, gate_outcome string, question_count int, metrics map<string,double>, thresholds map<string,double>, started_at timestamp, finished_at timestamp",
    "results": "run_id string, question_id string, recall_at_5 double, precision_at_5 double, mrr double, citation_validity double, claim_coverage double, faithfulness double, fabricated_fact_count int, invalid_citation_count int, latency_ms int, refused boolean, error boolean, searched_products array<string>",
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A registry table with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per source of the manifest files at ``path``, with ``manifest_version``."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return rows.select("manifest_version", F.posexplode("sources").alias("pos", "s")).select("manifest_version", "pos", "s.*")


MANIFEST_RULES = {
    "name": "length(name) > 0",
    "start_url": "start_url RLIKE '^https://'",
    "allowed_domains": "size(allowed_domains) > 0",
    "max_pages": "max_pages BETWEEN 1 AND 1000",
    "max_depth": "max_depth BETWEEN 0 AND 10",
    "delay_seconds": "delay_seconds >= 0",
}


def manifest_violations(sources: DataFrame) -> DataFrame:
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.expr(e), F.lit(False)), F.lit(n)) for n, e in MANIFEST_RULES.items()])
    )
    return sources.select("pos", F.explode(failed).alias("field"))


def unknown_fields(spark: SparkSession, path: str) -> DataFrame:
    """``field``s of manifest files, of the whole (``$``) and of each source, that the
    schema does not name."""
    whole = spark.read.option("wholetext", True).text(path).select("value", F.from_json("value", "sources array<string>").alias("m"))
    top = whole.select(F.lit(-1).alias("pos"), F.explode(F.json_object_keys("value")).alias("field"))
    each = whole.select(F.posexplode("m.sources").alias("pos", "s")).select("pos", F.explode(F.json_object_keys("s")).alias("field"))
    known = StructType.fromDDL(MANIFEST)
    inner = known["sources"].dataType.elementType.names
    return top.where(~F.col("field").isin(known.names)).union(each.where(~F.col("field").isin(inner)))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions flattened to one row each."""
    rows = spark.read.schema(GOLD).option("multiLine", True).json(path)
    return rows.select("version", F.inline("questions")).select(
        "version", F.col("id").alias("question_id"), "question", "category", "difficulty", "is_unsupported",
        F.coalesce("expected.must_refuse", F.lit(False)).alias("must_refuse"), F.col("expected.product").alias("want_product"),
        F.col("expected.heading_path").alias("want_heading_path"), F.col("expected.topics").alias("topics"),
    )


def dataset_fingerprint(rows: DataFrame) -> DataFrame:
    """One hash of all rows, whatever the order of rows and columns.

    Rows are hashed each, then hashed together by the first two bytes of their hash and
    those 65,536 hashes at most once more, so that no task gathers the dataset.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])), 256)
    counted = rows.select(row.alias("h")).groupBy("h").count()
    part = F.substring("h", 1, 4)
    parts = counted.groupBy(part.alias("p")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("x", "h", F.col("count").cast("string")))), ","), 256).alias("h")
    )
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "h"))), ","), 256).alias("fingerprint"))


def run_snapshot(run_id: str, gold: DataFrame, documents: DataFrame, units: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """A run's first row: dataset, thresholds and corpus counts as they are now."""
    live = documents.where("state != 'deleted'")
    thresholds = F.create_map(*[F.lit(x) for pair in sorted(settings.gates.items()) for x in pair])
    return (
        dataset_fingerprint(gold)
        .join(gold.agg(F.count("*").alias("n_questions")))
        .join(live.agg(F.count("*").alias("n_documents")))
        .join(units.join(live, "document_id", "left_semi").agg(F.count("*").alias("n_units")))
        .select(F.lit(run_id).alias("run_id"), "*", thresholds.alias("thresholds"), F.lit("running").alias("status"))
    )


def upsert_questions(stored: DataFrame, gold: DataFrame) -> DataFrame:
    """Stored questions with the gold set's values where it has them."""
    key = "question_id"
    columns = [c for c in stored.columns if c != key]
    new = gold.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return stored.join(new, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


# -- sinks -----------------------------------------------------------------------------


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("run_id").parquet(path)


def save_bucketed(rows: DataFrame, table: str, key: str, path: str, buckets: int = 64) -> DataFrame:
    """Rows written to ``path`` in buckets of ``key``, sorted in each, as a table of the session.  Tables with
    equal buckets are joined on the key without a shuffle."""
    rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).mode("overwrite").saveAsTable(table)
    return rows.sparkSession.table(table)


def append_logs(logs: DataFrame, path: str) -> None:
    logs.withColumn("log_date", F.to_date("created_at")).write.mode("append").partitionBy("log_date").parquet(path)


def write_snapshot(rows: DataFrame, path: str, version: int) -> str:
    """A whole new version beside the old ones, never over a path that is being read."""
    to = f"{path}/version={version:010d}"
    rows.write.mode("errorifexists").parquet(to)
    return to


def drop_namespace(rows: DataFrame, namespace: str) -> DataFrame:
    return rows.where(F.col("namespace") != namespace)
