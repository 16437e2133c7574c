"""Substring dedup by super-k-mer partitioning.

A window is ``size`` consecutive words of one document.  Its minimiser is the least hash
of its runs of ``run`` words, and consecutive windows with one minimiser form a super-k-mer.
First only minimisers travel, to find those that occur more than once.  Then the words of
their super-k-mers travel as one packed string to the minimiser's bucket, where the
strings are sorted by document and start and their windows are compared word for word.
Every window seen before marks its words.

Minimisers with very many super-k-mers, as of a passage that a third of all documents
quote, would be one hot bucket: their windows go one by one, by a 128-bit hash, to a
grouped minimum instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Words, map_batches, mix, pieces, repeated_keys, shingle_hashes, written

SIZE, RUN = 20, 6
#: super-k-mers of one minimiser beyond which its windows go one by one
HOT = 4096

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def super_kmers(docs: list[bytes], size: int = SIZE, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Minimiser, document, first word and number of windows of each super-k-mer."""
    w = Words(docs)
    n = len(w.hash)
    if n < size:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    grams = shingle_hashes(w.hash, run)
    # the first least hash of each window: where words repeat, a run ends with its place
    place = np.lib.stride_tricks.sliding_window_view(grams, size - run + 1).argmin(axis=1)
    place += np.arange(len(place))
    doc = np.repeat(np.arange(len(docs)), np.diff(w.first))
    whole = doc[: n - size + 1] == doc[size - 1 :]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1 : len(place)] != doc[: len(place) - 1]) | ~whole[:-1]
    at = np.flatnonzero(whole)
    begin = np.flatnonzero(new & whole)
    count = np.diff(np.append(np.searchsorted(at, begin), len(at)))
    return mix(grams[place[begin]]).view(np.int64), doc[begin], begin - w.first[doc[begin]], count


def _emit(size: int, run: int):
    def emit(batch: dict) -> Iterator[tuple]:
        docs = [(t or "").encode() for t in batch["text"]]
        ids, hashes = np.array(batch["doc"], np.int64), np.array(batch["text_hash"], np.int64)
        for i, j in pieces(docs):
            mini, doc, start, n = super_kmers(docs[i:j], size, run)
            yield mini, [ids[i:j][doc], hashes[i:j][doc], start, n]

    return emit


def _again(keys: list, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which keys stand at a later place than an equal one among them."""
    out = np.zeros(len(keys), bool)
    first: dict = {}
    for i in np.lexsort((starts, docs)).tolist():
        place = docs[i], starts[i]
        out[i] = first.setdefault(keys[i], place) != place
    return out


def _strings(size: int):
    """The repeated super-k-mers as packed strings of words; those of hot minimisers that
    this batch has at an earlier place are ``again``, and need not travel."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            doc, text_hash = (batch.column(n).to_numpy() for n in ("doc", "text_hash"))
            kmers = batch.column("kmers")
            ends = np.cumsum(kmers.value_lengths().to_numpy())
            start, n, mini, hot = (x.to_numpy(zero_copy_only=False) for x in kmers.flatten().flatten())
            packed = []
            for text, lo, hi in zip(batch.column("text").to_pylist(), np.concatenate(([0], ends[:-1])), ends):
                w = Words([text.encode()])
                # words as they stand if one space parts them, else joined anew
                plain = b" ".join(w.data.split())
                begin = np.concatenate(([0], np.cumsum(w.end - w.start + 1)[:-1]))
                stop = begin + (w.end - w.start)
                s = start[lo:hi]
                packed += [plain[x:y] for x, y in zip(begin[s].tolist(), stop[s + n[lo:hi] + size - 2].tolist())]
            of = np.repeat(np.arange(len(doc)), np.diff(np.concatenate(([0], ends))))
            again = np.zeros(len(packed), bool)
            some = np.flatnonzero(hot)
            again[some] = _again([packed[i] for i in some], doc[of][some], start[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(mini), pa.array(doc[of]), pa.array(text_hash[of]), pa.array(start), pa.array(n), pa.array(hot), pa.array(again), pa.array(packed, pa.binary())],
                names=["key", "doc", "text_hash", "start", "n", "hot", "again", "words"],
            )

    return run, "key long, doc long, text_hash long, start long, n long, hot boolean, again boolean, words binary"


def _seen_before(size: int):
    """Sorted by minimiser, document and start: runs of windows that occurred earlier."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        last, seen, whole = None, {}, {}
        for batch in batches:
            spans = []
            for key, doc, text_hash, start, n, packed in zip(*(batch[k] for k in ("key", "doc", "text_hash", "start", "n", "words"))):
                if key != last:
                    last, seen, whole = key, {}, {}
                # a string seen before has no window that is new
                first = whole.setdefault(packed, (doc, start))
                if first < (doc, start):
                    spans.append((doc, text_hash, start, start + n + size - 1))
                    continue
                words = packed.split(b" ")
                begins = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
                since = None
                for k in range(n):
                    first = seen.setdefault(packed[begins[k] : begins[k + size] - 1], (doc, start + k))
                    if first < (doc, start + k):
                        since = k if since is None else since
                    elif since is not None:
                        spans.append((doc, text_hash, start + since, start + k + size - 1))
                        since = None
                if since is not None:
                    spans.append((doc, text_hash, start + since, start + n + size - 1))
            yield dict(zip(("doc", "text_hash", "from", "to"), map(list, zip(*spans)))) if spans else {
                k: [] for k in ("doc", "text_hash", "from", "to")
            }

    return run


def _windows(size: int):
    """Each window of packed strings, by its 128-bit hash."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {k: [] for k in ("key", "doc", "text_hash", "start")}
            for doc, text_hash, start, n, packed in zip(*(batch[k] for k in ("doc", "text_hash", "start", "n", "words"))):
                words = packed.split(b" ")
                for k in range(n):
                    key = hashlib.blake2b(b" ".join(words[k : k + size]), digest_size=16).digest()
                    for into, x in zip(out.values(), (key, doc, text_hash, start + k)):
                        into.append(x)
            again = _again(out["key"], np.array(out["doc"], np.int64), np.array(out["start"], np.int64))
            yield out | {"again": again.tolist()}

    return run


def _cut(with_text: bool):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {k: [] for k in ("n_removed", "kept_sha256", "kept")}
            for text, spans in zip(batch["text"], batch["spans"]):
                words = _WORD.findall((text or "").encode())
                gone = np.zeros(len(words), bool)
                for s in spans or ():
                    gone[s["from"] : s["to"]] = True
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                row = (int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None)
                for into, x in zip(out.values(), row):
                    into.append(x)
            yield {"doc_id": batch["doc_id"], "n_words": batch["n_words"]} | out

    return run


def _later(rows: DataFrame, key: str) -> DataFrame:
    """Rows that are not the earliest with their key; the minimum is written, so that a hot key is one skewed side of a join."""
    place = F.struct("doc", "start")
    earliest = rows.groupBy(key).agg(F.min(place).alias("first"), F.count("*").alias("_n"))
    earliest = written(earliest.where("_n > 1").drop("_n"), "earliest")
    return rows.join(earliest, key).where(F.col("first") < place).drop("first")


def remove_repeats(docs: DataFrame, size: int = SIZE, run: int = RUN, with_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text; others are ignored) to ``doc_id``, ``n_words``,
    ``n_removed``, ``kept_sha256`` and, if asked for, the ``kept`` words joined by one
    space; one row per row.

    Removed is each word covered by a window whose words also start earlier, in a smaller
    doc_id or in the same document; windows are judged on the input.  A null text has no
    words; a null doc_id stands before all others; rows repeated with id and text are
    one document and treated alike; texts shorter than a window stay whole; no rows give
    no rows.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )
    kmers = repeated_keys(texts.drop("doc_id"), _emit(size, run), ["doc", "text_hash", "start", "n"])
    kmers = written(kmers.withColumnRenamed("key", "mini"), "kmers")
    hot = written(kmers.groupBy("mini").count().where(F.col("count") > HOT).select("mini"), "hot")
    per_doc = (
        kmers.join(hot.withColumn("hot", F.lit(True)), "mini", "left")
        .groupBy("doc", "text_hash")
        .agg(F.collect_set(F.struct("start", "n", "mini", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("kmers"))
    )
    kmer = "array<struct<start:long,n:long,mini:long,hot:boolean>>"
    # documents without such super-k-mers are done; the others keep their text
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    open_ = F.col("kmers").isNotNull()
    seen = texts.join(per_doc.hint("merge"), ["doc", "text_hash"], "left").withColumn("plain", plain)
    seen = seen.select(
        "doc_id", "doc", "text_hash", "kmers",
        F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "))) + 1)
        .cast("long").alias("n_words"),
        F.when(~open_, F.sha2("plain", 256)).alias("kept_sha256"),
        F.when(~open_ & F.lit(with_text), F.col("plain")).alias("kept"),
        F.when(open_, F.col("text")).alias("text"),
    )
    seen = written(seen, "seen")
    todo = seen.where(open_)

    run_, types = _strings(size)
    packed = todo.select("doc", "text_hash", "text", "kmers").mapInArrow(run_, types)
    cold = packed.where("NOT hot").drop("hot", "again").repartition("key").sortWithinPartitions("key", "doc", "start")
    span = "doc long, text_hash long, from long, to long"
    spans = map_batches(cold, _seen_before(size), span)

    # equal strings first: what a third of all documents quote is mostly that
    of_hot = todo.withColumn("kmers", F.filter("kmers", lambda k: k["hot"])).where(F.size("kmers") > 0)
    hot_rows = of_hot.select("doc", "text_hash", "text", "kmers").mapInArrow(run_, types)
    hot_rows = written(hot_rows.withColumn("key", F.unhex(F.md5("words"))).drop("hot"), "hot_rows")
    travel = hot_rows.where("NOT again")
    again = _later(travel.select("key", "doc", "text_hash", "start", "n"), "key")
    end = (F.col("start") + F.col("n") + size - 1).alias("to")
    whole = (
        hot_rows.where("again").select("doc", "text_hash", F.col("start").alias("from"), end)
        .union(again.select("doc", "text_hash", F.col("start").alias("from"), end))
    )
    firsts = travel.join(again.select("doc", "text_hash", "start"), ["doc", "text_hash", "start"], "left_anti")
    windows = map_batches(
        firsts.select("doc", "text_hash", "start", "n", "words"),
        _windows(size),
        "key binary, doc long, text_hash long, start long, again boolean",
    )
    windows = written(windows, "windows")
    partly = _later(windows.where("NOT again").drop("again"), "key").select("doc", "text_hash", "start")
    partly = partly.union(windows.where("again").select("doc", "text_hash", "start")).select(
        "doc", "text_hash", F.col("start").alias("from"), (F.col("start") + size).alias("to")
    )

    spans = spans.union(whole).union(partly)
    cut = spans.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    done = seen.where("kmers IS NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", "kept"
    )
    rest = map_batches(
        todo.select("doc_id", "doc", "text_hash", "n_words", "text").join(cut, ["doc", "text_hash"], "left"),
        _cut(with_text),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string",
    )
    out = done.union(rest)
    return out if with_text else out.drop("kept")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of ``remove_repeats`` without the texts; no rows give none."""
    return remove_repeats(docs, with_text=False)
