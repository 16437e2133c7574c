"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A mask looks at three words of a run and ignores those between, so that a substituted
word there does not break the match.  Hashes of the masked runs of the benchmark are
joined with those of all documents; a hit gives a document, an item and the shift between
their words.  Along each shift with enough hits the words are compared, and the best
stretch, with substitutions allowed, decides.  No overlap is lost: every pattern of
substitutions that scores enough has that many hits, which a test enumerates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: 1 looks at a word, 0 ignores it.  A stretch gains 3 - g at a gap g between shared words,
#: so one that scores has neighbouring gaps of five in sum at most, which makes ten masks;
#: these are the fewest of them that no stretch that scores enough can avoid
MASKS = ("111", "1101", "11001", "110001", "1011", "10101", "101001")
#: hits that a stretch that scores enough has at least, by the item's words; of more words, HITS
SHORT_HITS = {5: 3, 6: 4, 7: 9, 8: 10, 9: 9}
HITS = 11
#: items of fewer words have no room for masks: they are sought as whole runs of words
SHORTEST = 5
#: words that a stretch has to share, or two thirds of a shorter item
OVERLAP = 13
#: seeds of the benchmark (some 50 bytes each) up to which they are broadcast
BROADCAST_SEEDS = 1_000_000

_APART = r"[^\p{L}\p{N}]+"


def words(text: str) -> Column:
    """Runs of letters and digits in lower case; what stands at either end is cut first,
    so that no word is empty.  A null or empty text is one empty word."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"^{_APART}|{_APART}$", "")
    return F.split(F.lower(trimmed), _APART)


def _seeds(df: DataFrame) -> DataFrame:
    """Rows of ``df`` (with ``words``) by position and mask: its other columns, ``at`` and ``seed``."""
    shortest = min(map(len, MASKS))
    size = F.size("words")
    hashed = df.withColumn("words", F.transform("words", lambda w: F.xxhash64(w)))  # each word once
    at = hashed.withColumn("at", F.explode(F.when(size >= shortest, F.sequence(F.lit(0), size - shortest))))

    def seed(k: int, mask: str) -> Column:
        looked = [F.get("words", F.col("at") + i) for i, x in enumerate(mask) if x == "1"]
        return F.when(F.col("at") + len(mask) <= size, F.xxhash64(F.lit(k), *looked))

    out = at.withColumn("seed", F.explode(F.array(*[seed(k, m) for k, m in enumerate(MASKS)])))
    return out.where("seed IS NOT NULL").drop("words")


def _score(shift: Column) -> Column:
    """The best stretch of ``item`` laid on ``words`` at a shift."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, i: Column) -> Column:
        there = i + shift
        same = F.when(there >= 0, F.get("words", there) == F.get("item", i))
        run = F.greatest(F.lit(0), state["run"] + F.when(same, 2).otherwise(-1))
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.size("item") - 1), start, step)["best"]


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` (doc_id, text) and ``benchmark`` (item_id, text), other columns being
    ignored, to one row per pair that overlaps: ``doc_id``, ``text_hash``, ``item_id`` and
    ``score``.

    A stretch scores 2 for a word shared and -1 for one substituted; a pair overlaps if
    its best stretch scores at least 2 ``overlap``, or two thirds of twice the item's
    words where that is less.  An item of fewer than ``SHORTEST`` words overlaps every text
    that holds its words in one run, wherever it stands, and scores 2 for each; an item
    of one common word thus meets very many texts.  Items and texts without a word
    match nothing.  Repeated rows count once; a null doc_id or item_id is a value like
    others; no rows give no rows.
    """
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("item"))
        .where("item[0] != ''")
        .distinct()
    )
    items = written(items.withColumn("number", F.monotonically_increasing_id()), "items")
    n = F.size("item")
    least = F.lit(HITS)
    for size, hits in SHORT_HITS.items():
        least = F.when(n == size, hits).otherwise(least)
    of_items = _seeds(items.where(n >= SHORTEST).select("number", F.col("item").alias("words"), least.alias("least")))
    of_items = written(of_items.withColumnRenamed("at", "from"), "seeds")
    seeds = F.broadcast(of_items) if of_items.count() <= BROADCAST_SEEDS else of_items

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    of_docs = _seeds(texts.select("doc_id", "text_hash", words("text").alias("words")))
    shifts = (
        of_docs.join(seeds, "seed")
        .groupBy("doc_id", "text_hash", "number", "least", (F.col("at") - F.col("from")).alias("shift"))
        .agg(F.count("*").alias("hits"))  # of repeated rows more, which only costs a comparison
        .where("hits >= least")
    )
    # a pair has no more shifts than words, and its words are held once for all of them
    found = written(shifts.groupBy("doc_id", "text_hash", "number").agg(F.collect_list("shift").alias("shifts")), "shifts")
    same_id = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash"))
    pairs = texts.alias("d").join(found.alias("s"), same_id)
    pairs = pairs.select("d.doc_id", "d.text_hash", words("text").alias("words"), "number", "shifts").join(items, "number")
    scored = pairs.select(
        "doc_id", "text_hash", "item_id", "item", F.array_max(F.transform("shifts", _score)).alias("score")
    )
    long = scored.where(F.col("score") >= F.least(F.lit(2 * overlap), F.ceil(n * 4 / 3))).drop("item")

    short = items.where(n < SHORTEST).select("item_id", n.alias("size"), F.array_join("item", " ").alias("run"))
    found = long.unionByName(_whole_runs(texts, short)) if not short.isEmpty() else long
    return found.groupBy("doc_id", "text_hash", "item_id").agg(F.max("score").cast("long").alias("score"))


def _whole_runs(texts: DataFrame, short: DataFrame) -> DataFrame:
    """Texts that hold the run of a short item (item_id, size, run): each text's distinct runs of the
    sizes that occur, joined with the items' as text, which no word's letters can mimic."""
    sizes = sorted(r.size_ for r in short.select(F.col("size").alias("size_")).distinct().collect())  # 1 to 4
    n = F.size("words")

    def runs(k: int) -> Column:
        at = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("words", i, k), " ")))

    few = short.count() <= BROADCAST_SEEDS
    held = texts.select("doc_id", "text_hash", words("text").alias("words")).where("words[0] != ''")
    held = held.select("doc_id", "text_hash", F.explode(F.flatten(F.array(*[runs(k) for k in sizes]))).alias("run"))
    met = held.join(F.broadcast(short) if few else short, "run")
    return met.select("doc_id", "text_hash", "item_id", (2 * F.col("size")).alias("score"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document: whether it is contaminated, and by which items.  Null and empty
    texts are not; repeated rows give a row each; no documents give no rows."""
    pairs = contaminated_documents(docs, benchmark)
    per_doc = pairs.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("score").alias("score")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    same = texts["doc_id"].eqNullSafe(per_doc["doc_id"]) & (texts["text_hash"] == per_doc["text_hash"])
    return texts.join(per_doc, same, "left").select(
        texts["doc_id"],
        F.col("score").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("score", F.lit(0)).cast("long").alias("score"),
    )
