"""Line dedup by a deletion-neighbourhood join.

Two lines are within one edit exactly if one is the other less a character, or both are
equal less a character at the same place.  So each line gives its own hash, and the hash
of each variant with one character deleted; lines that share one are joined, the edit
distance is verified, and the earliest line stays.

Variants are many, so lines that cannot need them are set aside first, without loss.  An
edit stands in one of ``q`` segments of a line, and what stands before and after that
segment is equal in both lines.  Lines that share no such rest with another line have no
partner (``q`` = 2); of the others, finer segments (``q`` = 16) tell where the edit has to
be, and only variants that delete there are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, discard, map_batches, mix, powers, repeated_keys, written

#: an edit among so many code points leaves a similarity of 0.8; among fewer, less
SHORTEST = 5
#: a line of nothing else is blank
BLANK = " \t\r\x0b\x0c"
COARSE, FINE = 2, 16
#: lines that one task groups before the shuffle
LOCAL_LINES = 1 << 16

_M = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_M, -1, 1 << 64))
_PLACE = ("doc", "text_hash", "line")


def segments(n: int, q: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(t, j, a, b, tail) of a line of ``n`` characters: with a partner such that the
    shorter of both has ``t``, an edit in segment ``j`` of it leaves the first ``a`` and
    the last ``tail`` equal, and deletes one of the characters from ``a`` to ``b``."""
    for t in (n - 1, n):
        for j in range(q):
            a, tail = t * j // q, t - t * (j + 1) // q
            yield t, j, a, n - tail, tail


def rest_keys(line: str, q: int) -> list[int]:
    """A key for each segment: what stands around it, and the shorter length."""
    out, n = [], len(line)
    for t, j, a, _, tail in segments(n, q):
        rest = f"{t},{j},{line[:a]}".encode() + b"\xff" + line[n - tail :].encode()
        out.append(xxhash.xxh3_64_intdigest(rest) - (1 << 63))
    return out


def variant_keys(line: str, spans: list[tuple[int, int]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Hash of the line itself, of its variants that delete a character in one of the
    spans, and of these variants together with the place."""
    chars = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(chars)
    with np.errstate(over="ignore"):
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(chars) * powers(_M, n))))
        at = np.unique(np.concatenate([np.arange(a, b) for a, b in spans] or [np.zeros(0, np.int64)]))
        less = upto[at] + (upto[n] - upto[at + 1]) * _INVERSE
        size = mix(np.array([2 * n, 2 * n - 2], np.uint64))
        own = mix(upto[n : n + 1] ^ size[0])[0]
        return own, mix(less ^ size[1]), mix(less ^ mix(2 * at.astype(np.uint64) + np.uint64(1)))


def _first_lines(batches: Iterator[dict], shortest: int) -> Iterator[dict]:
    """Lines by a 128-bit hash; of equal ones in this task only the earliest travels, and
    the others are gone already (``how`` 1, dealt out evenly)."""
    first: dict[bytes, tuple] = {}
    names = ("at", "key2", "how", *_PLACE, "rests")

    def columns(rows: list) -> dict:
        return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

    def out_of(place: tuple) -> tuple:
        spread = xxhash.xxh3_64_intdigest(repr(place)) - (1 << 63)
        return spread, 0, 1, *place, None

    def flush() -> Iterator[dict]:
        rows = [
            (int.from_bytes(k[:8], "big", signed=True), int.from_bytes(k[8:], "big", signed=True), 0, *v[0], v[1])
            for k, v in first.items()
        ]
        first.clear()
        for lo in range(0, len(rows), 20_000):
            yield columns(rows[lo : lo + 20_000])

    for batch in batches:
        gone = []
        for doc, text_hash, text in zip(batch["doc"], batch["text_hash"], batch["text"]):
            for i, line in enumerate((text or "").split("\n")):
                if not line.strip(BLANK):
                    continue
                place, key = (doc, text_hash, i), xxhash.xxh3_128_digest(line.encode())
                had = first.get(key)
                if had is None or place < had[0]:
                    first[key] = place, had[1] if had else rest_keys(line, COARSE) if len(line) >= shortest else []
                    if had:
                        gone.append(out_of(had[0]))
                elif place != had[0]:
                    gone.append(out_of(place))
        yield columns(gone)
        if len(first) >= LOCAL_LINES:
            yield from flush()
    yield from flush()


def _settle_equal(batches: Iterator[dict]) -> Iterator[dict]:
    """Sorted by hash and place: the first of equal lines stays, with its rests."""
    last = kept = None
    for batch in batches:
        rows = []
        for at, key2, how, doc, text_hash, line, rests in zip(*(batch[k] for k in ("at", "key2", "how", *_PLACE, "rests"))):
            place = (doc, text_hash, line)
            if how == 1:
                rows.append((*place, True, None))
            elif (at, key2) != last:
                last, kept = (at, key2), place
                rows.append((*place, False, rests))
            elif place != kept:
                rows.append((*place, True, None))
        names = (*_PLACE, "gone", "rests")
        yield dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def _emit_rests(batch: dict) -> Iterator[tuple]:
    n = [len(r) for r in batch["rests"]]
    if n:
        keys = np.array([k for r in batch["rests"] for k in r], np.int64)
        yield keys, [np.repeat(np.array(batch[c], np.int64), n) for c in _PLACE]


def _emit_fine(batch: dict) -> Iterator[tuple]:
    keys, places = [], []
    for doc, text_hash, text, lines in zip(batch["doc"], batch["text_hash"], batch["text"], batch["close"]):
        split = text.split("\n")
        for i in lines:
            k = rest_keys(split[i], FINE)
            keys += k
            places += [(doc, text_hash, i, s) for s in range(len(k))]
    if keys:
        yield np.array(keys, np.int64), list(np.array(places, np.int64).T.copy())


def _variants(batches: Iterator[dict]) -> Iterator[dict]:
    """Keys with what the line is to them: 0 itself, 1 longer, 2 equal but for a place."""
    names = ("key", "role", *_PLACE)
    for batch in batches:
        parts: list[list] = [[] for _ in names]
        for doc, text_hash, text, fine in zip(batch["doc"], batch["text_hash"], batch["text"], batch["fine"]):
            split = text.split("\n")
            spans: dict[int, list] = {}
            for f in fine:
                cut = list(segments(len(split[f["line"]]), FINE))[f["segment"]]
                spans.setdefault(f["line"], []).append((cut[2], cut[3]))
            for i, where in spans.items():
                own, longer, placed = variant_keys(split[i], where)
                keys = np.concatenate((np.array([own], np.uint64), longer, placed)).view(np.int64).tolist()
                roles = [0] + [1] * len(longer) + [2] * len(placed)
                for into, x in zip(parts, (keys, roles, [doc] * len(keys), [text_hash] * len(keys), [i] * len(keys))):
                    into += x
        yield dict(zip(names, parts))


def _texts(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        rows = []
        for doc, text_hash, text, fine in zip(batch["doc"], batch["text_hash"], batch["text"], batch["fine"]):
            split = text.split("\n")
            rows += [(doc, text_hash, i, split[i]) for i in sorted({f["line"] for f in fine})]
        names = (*_PLACE, "words")
        yield dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def _cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    rows = []
    for t, g in zip(text, gone):
        lines = (t or "").split("\n")
        drop = () if g is None else set(g)
        kept = [x for i, x in enumerate(lines) if i not in drop] if drop else lines
        rows.append((len(lines), len(lines) - len(kept), "\n".join(kept) if drop else t))
    return pd.DataFrame(rows, columns=["n_lines", "n_removed", "kept"])


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` (doc_id, text, and any others) to ``row``, a struct of all columns but the
    text, ``text`` without the removed lines, ``n_lines`` and ``n_removed``; one row per
    row.

    Lines end with a newline.  A line is removed if an earlier one, by doc_id and then by
    its number, is equal, or one edit away (one character put in, left out or replaced) and
    similar to 0.8 or more: both have at least ``shortest`` code points.  Lines of white space alone stay.  Lines
    are judged on the input, not on what is left.  A null text stays null and has one empty line; a null doc_id stands before
    all others; rows repeated with id and text are one document and treated alike; no
    rows give no rows.
    """
    texts = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )
    place = "doc long, text_hash long, line int"
    first = map_batches(
        texts.drop("row"), lambda batches: _first_lines(batches, shortest), f"at long, key2 long, how int, {place}, rests array<long>"
    )
    first = first.repartition("at").sortWithinPartitions("at", "key2", *_PLACE)
    first = written(map_batches(first, _settle_equal, f"{place}, gone boolean, rests array<long>"), "first")

    close = repeated_keys(first.where("NOT gone").select(*_PLACE, "rests"), _emit_rests, list(_PLACE))
    marks = first.where("gone").select(*_PLACE, F.lit(True).alias("gone")).union(
        close.select("doc", "text_hash", F.col("line").cast("int"), F.lit(False))
    )

    def numbers(condition: Column, name: str) -> Column:
        return F.collect_set(F.when(condition, F.col("line"))).alias(name)

    marks = marks.groupBy("doc", "text_hash").agg(numbers(F.col("gone"), "gone"), numbers(~F.col("gone"), "close"))
    texts = texts.join(marks.hint("merge"), ["doc", "text_hash"], "left")
    # documents that no closer look concerns are settled; the others keep their text
    cut_udf = F.pandas_udf(_cut, "n_lines long, n_removed long, kept string")
    open_ = F.size(F.coalesce("close", F.array())) > 0
    cut = cut_udf("text", F.when(~open_, F.col("gone")))
    seen = texts.withColumn("cut", F.when(~open_, cut)).select(
        "row", "doc", "text_hash", "cut", *[F.when(open_, F.col(c)).alias(c) for c in ("text", "gone", "close")]
    )
    seen = written(seen, "seen")
    discard(first)
    todo = seen.where("cut IS NULL").drop("cut")

    fine = repeated_keys(
        todo.dropDuplicates(["doc", "text_hash"]).select("doc", "text_hash", "text", "close"),
        _emit_fine,
        [*_PLACE, "segment"],
    )
    fine = fine.groupBy("doc", "text_hash").agg(
        F.collect_set(F.struct(F.col("line").cast("int").alias("line"), F.col("segment").cast("int").alias("segment")))
        .alias("fine")
    )
    candidates = written(
        todo.dropDuplicates(["doc", "text_hash"]).select("doc", "text_hash", "text").join(fine, ["doc", "text_hash"]),
        "candidates",
    )
    variants = written(map_batches(candidates, _variants, f"key long, role int, {place}"), "variants")
    own = F.struct(*_PLACE)
    role = F.col("role")
    groups = variants.groupBy("key").agg(
        F.count("*").alias("n"),
        *[F.min(F.when(role == r, own)).alias(f"first{r}") for r in (0, 1, 2)],
    )
    groups = written(groups.where("n > 1").drop("n"), "groups")
    partner = F.when(role == 0, F.col("first1")).when(role == 1, F.col("first0")).otherwise(F.col("first2"))
    pairs = (
        variants.join(groups, "key")
        .select(own.alias("own"), partner.alias("partner"))
        .where("partner < own")
        .distinct()
    )
    line_texts = map_batches(candidates, _texts, f"{place}, words string").select(own.alias("own"), "words")
    near = (
        pairs.join(line_texts, "own")
        .join(line_texts.select(F.col("own").alias("partner"), F.col("words").alias("words2")), "partner")
        .where(F.levenshtein("words", "words2", 1) >= 0)
        .select("own.*")
        .distinct()
        .groupBy("doc", "text_hash")
        .agg(F.collect_set("line").alias("near"))
    )
    near = written(near, "near")
    discard(candidates, variants, groups)
    gone = F.concat("gone", F.coalesce("near", F.array().cast("array<int>")))
    rest = todo.join(near, ["doc", "text_hash"], "left").select("row", cut_udf("text", gone).alias("cut"))
    done = seen.where("cut IS NOT NULL").select("row", "cut")
    return done.union(rest).select("row", F.col("cut.kept").alias("text"), "cut.n_lines", "cut.n_removed")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed`` and ``kept_sha256`` of each row.  A null text
    counts as empty, which is one line; repeated rows give a row each; no rows give none."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
