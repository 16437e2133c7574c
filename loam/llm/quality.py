"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The model is fitted on a bounded sample of labelled documents and scores every whole
text.  A score takes time linear in a document's features, since the pairwise term is
``sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2) / 2``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, map_batches, pieces, small_batches

#: words are hashed to so many features
WORD_FEATURES = 1 << 14
#: factors of each feature
RANK = 8
#: labelled documents that the fit uses at most; bounds the driver's part
SAMPLE = 8192
#: rows that the fit visits at least, in 12 to 100 passes
VISITS = 98304
THRESHOLD = 0.3

#: what the structure features measure, each in BINS steps of its logarithm
STATISTICS = (
    "characters", "words", "lines", "characters a word", "words a line", "characters column",
    "upper case", "digits", "sentence marks", "commas", "exclamation and question marks", "bars", "symbols",
    "brackets and quotes", "beyond ASCII", "distinct words", "one-letter words", "lines without a sentence end",
)
BINS = 16
N_FEATURES = WORD_FEATURES + len(STATISTICS) * BINS


def _byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = [
    _byte_class(c)
    for c in (bytes(range(65, 91)), b"0123456789", b".", b",", b"!?", b"|", b"#$%&*+/<=>@\\^_~`", b"()[]{}\"'")
] + [np.arange(256) >= 0xC0]


@dataclass
class Features:
    """Features of some documents: rows ``first[k]:first[k + 1]`` are document ``k``'s."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray


def features(docs: list[bytes], n_chars: list[int | None]) -> Features:
    w = Words(docs)
    index, value, first = [], [], [0]
    a = np.frombuffer(w.data, np.uint8)
    length = w.end - w.start
    # how often each class of bytes occurs up to each document's end
    ends = np.cumsum([0] + [len(d) + 1 for d in docs])
    counts = np.stack([np.diff(np.concatenate(([0], np.cumsum(c[a])))[ends]) for c in _CLASSES])
    for k, doc in enumerate(docs):
        lo, hi = w.first[k], w.first[k + 1]
        n_words, n_bytes = hi - lo, len(doc)
        hashed, n = np.unique((w.hash[lo:hi] % np.uint64(WORD_FEATURES)).astype(np.int64), return_counts=True)
        lines = doc.split(b"\n")
        open_ended = sum(1 for x in lines if x and x[-1] not in b".!?:;\"')")
        counted = np.array([n_bytes, n_words, len(lines), n_bytes / (n_words + 1), n_words / len(lines), n_chars[k] or 0])
        shares = np.concatenate(
            (
                counts[:, k] / max(1, n_bytes),
                [len(hashed) / max(1, n_words), (length[lo:hi] == 1).sum() / max(1, n_words), open_ended / len(lines)],
            )
        )
        steps = np.concatenate((np.log2(1 + counted), 1.6 * np.log2(1 + 500 * shares)))
        steps = np.minimum(steps.astype(np.int64), BINS - 1)
        index += [hashed, WORD_FEATURES + np.arange(len(STATISTICS)) * BINS + steps]
        value += [np.sqrt(n) / max(1.0, np.sqrt(n.sum())), np.full(len(STATISTICS), 0.3)]
        first.append(first[-1] + len(hashed) + len(STATISTICS))
    return Features(np.concatenate(index), np.concatenate(value), np.array(first))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, x: Features) -> np.ndarray:
        """Every document has features, so that no stretch is empty."""
        at = x.first[:-1]
        vx = self.factor[x.index] * x.value[:, None]
        pair = np.add.reduceat(vx, at) ** 2 - np.add.reduceat(vx * vx, at)
        return self.bias + np.add.reduceat(self.weight[x.index] * x.value, at) + pair.sum(axis=1) / 2

    def score(self, docs: list[bytes], n_chars: list[int | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for i, j in pieces(docs):
            out.append(1 / (1 + np.exp(-np.clip(self.margin(features(docs[i:j], n_chars[i:j])), -30, 30))))
        return np.concatenate(out)


def fit(rows: list[Features], labels: np.ndarray, visits: int = VISITS, seed: int = 1) -> Machine:
    """AdaGrad on the logistic loss, one document's ``Features`` and label per row; no
    rows give the even score 1/2."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, RANK)))
    if not len(rows):
        m.factor[:] = 0
        return m
    share = np.clip(labels.mean(), 0.01, 0.99)
    m.bias = float(np.log(share / (1 - share)))
    past_w, past_v, past_b = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, RANK), 1e-6), 1e-6
    for _ in range(min(100, max(12, visits // len(rows)))):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(order) // 64)):
            some = [rows[i] for i in part]
            first = np.concatenate(([0], np.cumsum([len(r.index) for r in some])))
            x = Features(np.concatenate([r.index for r in some]), np.concatenate([r.value for r in some]), first)
            p = 1 / (1 + np.exp(-np.clip(m.margin(x), -30, 30)))
            each = np.repeat((p - labels[part]) / len(part), np.diff(first)) * x.value
            vx = m.factor[x.index] * x.value[:, None]
            total = np.repeat(np.add.reduceat(vx, first[:-1]), np.diff(first), axis=0)
            used, where = np.unique(x.index, return_inverse=True)
            g_w = np.bincount(where, each) + 1e-5 * m.weight[used]
            per = each[:, None] * (total - vx)
            g_v = np.stack([np.bincount(where, per[:, f]) for f in range(RANK)], 1) + 1e-5 * m.factor[used]
            past_w[used] += g_w**2
            past_v[used] += g_v**2
            m.weight[used] -= 0.1 * g_w / np.sqrt(past_w[used])
            m.factor[used] -= 0.02 * g_v / np.sqrt(past_v[used])
            g_b = float((p - labels[part]).mean())
            past_b += g_b**2
            m.bias -= 0.1 * g_b / np.sqrt(past_b)
    return m


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the fifth of the ids, by checksum of their text, that no fit may see; a
    null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars; a missing n_chars column counts as null."""
    n = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n.cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from the labelled documents outside the held-out fold: the ``sample``
    first by a hash of the id, a bound that makes what reaches the driver a constant.

    Null labels and ids are left out; a document with several labels takes their mean,
    rounded up; of several texts with one id the first by its hash and itself counts;
    without any label the score is 1/2.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {"quality": batch["quality"], "index": [], "value": []}
            for text, n in zip(batch["text"], batch["n_chars"]):
                x = features([(text or "").encode()], [n])
                out["index"].append(x.index.astype("<i4").tobytes())
                out["value"].append(x.value.astype("<f4").tobytes())
            yield out

    # at most ``sample`` ids and labels are broadcast
    joined = _prepared(docs).join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text"), "text", "n_chars", "quality")).alias("one")
    joined = joined.groupBy("doc_id").agg(one).select("one.text", "one.n_chars", "one.quality")
    got = map_batches(joined, run, "quality int, index binary, value binary").collect()  # no more rows than ids
    got = sorted((r["index"], r["value"], r["quality"]) for r in got)
    x = [
        Features(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float), np.array([0, len(i) // 4]))
        for i, v, _ in got
    ]
    return fit(x, np.array([q for *_, q in got], float))


def score_quality(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted``, one row per row.

    Inputs of a score are the whole text and n_chars alone.  Null and empty texts are
    scored by their structure; doc_id, repeated rows and other columns play no part;
    columns named score or predicted are replaced; no rows give no rows.
    """
    docs = docs.drop("score", "predicted")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(
        (machine.bias, machine.weight.astype(np.float32), machine.factor.astype(np.float32))
    )  # a fixed size, whatever the input

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = Machine(*shared.value)
        for text, n in batches:
            docs = [(t or "").encode() for t in text]
            yield pd.Series(m.score(docs, [None if x < 0 else int(x) for x in n]), dtype="float64")

    n = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    scored = docs.withColumn("score", score("text", F.coalesce(n.cast("long"), F.lit(-1))))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row, null and empty
    texts included; a null id is of neither fold; no rows give none."""
    scored = score_quality(_prepared(docs), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
