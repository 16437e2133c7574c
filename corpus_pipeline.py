"""A training corpus in five stages: quality, line dedup, near duplicates,
decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet before the next one reads it.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import decontaminate, jaccard, lines, packing, quality
from loam.llm.common import discard, table, written


def _without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id and text are those of ``out``; a null id is a
    value like others."""
    out = out.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(out["_id"]) & (F.xxhash64(docs["text"]) == out["_hash"])
    return docs.join(out, same, "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine trained on their labels predicts to be good.  Null and
    empty texts and null ids are scored like others, repeated rows each for itself; no
    rows give no rows; any columns pass."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    n_chars = docs["n_chars"] if "n_chars" in docs.columns else F.lit(None).cast("long").alias("n_chars")
    rows = docs.select("doc_id", "text", n_chars, F.struct("*").alias("row"))
    return quality.score_quality(rows, machine).where("predicted = 1").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier, and n_chars of what is left.  A document
    goes if lines were removed and nothing but white space is left.  A null text stays
    null, a null id stands before all others, repeated rows are one document and treated
    alike; no rows give no rows; any columns pass."""
    out = lines.dedup_lines(docs).where(r"n_removed = 0 OR text RLIKE '\\S'")
    kept = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return out.select(*[kept[c].alias(c) if c in kept else F.col("row")[c].alias(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row: the first by doc_id
    (null ids last), hash of the text and the row itself; of repeated rows one stays.
    Null and empty texts are in no group and stay; no rows give no rows; any columns
    pass."""
    found = written(jaccard.jaccard_components(docs, n=5, percent=80), "found")
    firsts = _without(docs, found.where("NOT (doc_id <=> component_id AND text_hash = first_hash)"))
    again = found.where("n_shingles > 0 AND doc_id <=> component_id AND text_hash = first_hash")
    again = written(again.groupBy("doc_id", "text_hash").count().where("count > 1"), "again")
    same = firsts["doc_id"].cast("long").eqNullSafe(again["doc_id"]) & (F.xxhash64(firsts["text"]) == again["text_hash"])
    repeated = firsts.join(again, same, "left_semi").select(F.struct("*").alias("row"))
    repeated = repeated.groupBy(F.col("row.doc_id"), F.xxhash64("row.text")).agg(F.min("row").alias("row"))
    return _without(firsts, again).unionByName(repeated.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.  Null and empty texts overlap none and
    stay, repeated rows go or stay together, a null id is a value like others; no rows give
    no rows; any columns pass."""
    return _without(docs, decontaminate.contaminated_documents(docs, table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed: a row for each piece, of a null or empty text the end
    id alone, of repeated rows each; no rows give no rows; other columns play no part."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the first and the last stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)  # all that was needed of it is in the new one
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
