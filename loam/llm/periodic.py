"""Periodic runs of words: stretches that repeat with a period, by seeds and diagonals.

A run of smallest period ``q`` matches itself ``q`` words on over a stretch of at least
``max(least - q, q)`` words, its diagonal.  So each run holds two equal seeds ``q`` words
apart, as long as the overlap that its period guarantees:

- periods below ``least`` guarantee ``least // 2`` words.  Seeds of that length at every
  place are compared at each such lag; neighbouring ones are one diagonal.
- a longer period ``q`` guarantees ``q`` words.  Of seeds of ``k`` words with
  ``2 k <= q < 4 k`` it is enough to take those at places divisible by ``k``, since a stretch
  of ``q`` words holds a whole one.  They are looked up in an index of the repeated k-grams
  of the document; each has less than ``2 k`` partners, so a length ``k`` gives
  at most twice as many pairs as there are words, even where one word fills a text.  The
  k-grams of twice the length are made of pairs of those that repeat.

Pairs are sorted by lag and place, and a seed that begins where the one before it on its lag
ended is covered by it: only the ends of such a chain are extended, by less than a seed.
Pairs inside a run whose period divides their lag are left out, as what they lead to
has that smaller period.

A document's runs depend on its own words alone, so no row is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, map_batches, mix, pieces, powers

#: words that a run has at least
LEAST = 12

#: pairs of places that are compared at once
STEP = 1 << 20


def _grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each place on that has so many."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(word) - k + 1, np.uint64)
        for j, p in enumerate(powers(0xD6E8FEB86659FD93, k)):
            total += word[j : len(word) - k + 1 + j] * p
        return mix(total)


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _index(place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key occurs more than once, ordered by key and place, and the
    number of the key of each."""
    order = np.lexsort((place, key))
    place, key = place[order], key[order]
    same = key[1:] == key[:-1]
    again = np.append(same, False) | np.concatenate(([False], same)) if len(key) else np.zeros(0, bool)
    number = np.cumsum(np.concatenate(([0], ~same)))[: len(key)]
    return place[again], number[again]


def _reach(n: int, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how far the runs that begin at or before it reach, and the period
    of the one that reaches furthest."""
    end, period = np.zeros(n, np.int64), np.ones(n, np.int64)
    if runs:
        start, to, q = np.concatenate(runs, axis=1)
        order = np.lexsort((-q, to))  # of equal ends the smallest period stands last
        end[start[order]], period[start[order]] = to[order], q[order]
    best = np.maximum.accumulate(end)
    since = np.maximum.accumulate(np.where(end == best, np.arange(n), 0))
    return best, period[since]


def _matched(word: np.ndarray, at: np.ndarray, lag: np.ndarray, step: int, most: int) -> np.ndarray:
    """Words, up to ``most``, from ``at`` on (``step`` 1) or before it (-1) that are equal to those ``lag``
    words after them."""
    out = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    done, width = 0, 8
    while len(open_) and done < most:
        width = min(width * 2, most - done)
        ahead = np.arange(done, done + width)
        nxt = []
        for lo in range(0, len(open_), max(1, STEP // width)):
            some = open_[lo : lo + max(1, STEP // width)]
            i = at[some][:, None] + step * ahead - (step < 0)
            j = i + lag[some][:, None]
            inside = (i >= 0) & (j < len(word))
            equal = inside & (word[np.where(inside, i, 0)] == word[np.where(inside, j, 0)])
            n = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
            out[some] += n
            nxt.append(some[n == width])
        open_ = np.concatenate(nxt)
        done += width
    return out


def find_runs(word: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Start, end and period of the runs of ``word`` (uint64 hashes; a run never leaves
    its ``doc``, which grows along the words), ordered by start, then period."""
    # a mark between documents equals nothing else, so that no diagonal crosses it
    cut = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    place = np.arange(len(word)) + np.searchsorted(cut, np.arange(len(word)), "right")
    n = len(word) + len(cut)
    w = np.zeros(n, np.uint64)
    w[place] = word
    marks = cut + np.arange(len(cut))
    w[marks] = mix(np.arange(len(cut), dtype=np.uint64) + np.uint64(1 << 40))
    found: list[np.ndarray] = []
    k = least // 2
    if n < k:
        return np.zeros((3, 0), np.int64)
    gram = _grams(w, k)
    for q in range(1, min(least, n - k + 1)):
        a, b = _stretches(gram[:-q] == gram[q:])
        b += k - 1
        long = b - a >= max(least - q, q)
        if long.any():
            found.append(np.array([a[long], b[long] + q, np.full(long.sum(), q)]))
    # a gram is known by its document as well; grams over a mark occur once
    number_of = np.zeros(n, np.int64)
    number_of[place] = doc
    with np.errstate(over="ignore"):
        key = mix(gram + number_of[: len(gram)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    place_k, key_k = _index(np.arange(len(gram)), key)
    while len(place_k):
        base = key_k * n + place_k
        seed = place_k % k == 0
        x, x_key = place_k[seed], key_k[seed]
        lo = np.searchsorted(base, x_key * n + np.minimum(x + 2 * k, n))
        hi = np.searchsorted(base, x_key * n + np.minimum(x + 4 * k, n))
        x, lag = _pairs(place_k, x, lo, hi)
        reach, period = _reach(n, found)
        inside = (x + lag + k <= reach[x]) & (lag % period[x] == 0)
        x, lag = x[~inside], lag[~inside]
        if len(x):
            order = np.lexsort((x, lag))
            x, lag = x[order], lag[order]
            new = np.concatenate(([True], (lag[1:] != lag[:-1]) | (x[1:] != x[:-1] + k)))
            first = np.flatnonzero(new)
            a, q = x[first], lag[first]
            b = x[np.append(first[1:], len(x)) - 1] + k
            some = b - a + 2 * (k - 1) >= q
            a, b, q = a[some], b[some], q[some]
            back, on = _matched(w, a, q, -1, k), _matched(w, b, q, 1, k)
            # a whole seed more would be a pair: it was left out, for a smaller period
            whole = (back < k) & (on < k) & (b - a + back + on >= q)
            a, b, q = (a - back)[whole], (b + on)[whole], q[whole]
            found.append(np.array([a, b + q, q]))
        # grams of twice the length: pairs of repeated ones
        at = np.full(n + 1, -1, np.int64)
        at[place_k] = key_k
        after = at[np.minimum(place_k + k, n)]
        both = after >= 0
        with np.errstate(over="ignore"):
            key = mix(mix(key_k[both].astype(np.uint64)) + after[both].astype(np.uint64))
        place_k, key_k = _index(place_k[both], key)
        k *= 2
    if not found:
        return np.zeros((3, 0), np.int64)
    start, end, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    # a stretch found with a multiple of its period has the same ends
    least_q = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1]))) if len(q) else np.zeros(0, bool)
    start, end, q = start[least_q], end[least_q], q[least_q]
    order = np.lexsort((q, start))
    shift = np.searchsorted(marks, start[order])
    return np.array([start[order] - shift, end[order] - shift, q[order]])


def _pairs(place: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each ``x`` with the places ``lo:hi`` of the index: the first of both, and the lag."""
    count = hi - lo
    left = np.repeat(x, count)
    within = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
    return left, place[np.repeat(lo, count) + within] - left


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _read(least: int, with_text: bool):
    names = ["n_words", "runs", "best", "collapsed_sha256"] + ["collapsed"] * with_text

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"]]
            for lo, hi in pieces(texts):
                part = Words(texts[lo:hi])
                count = np.diff(part.first)
                start, end, q = find_runs(part.hash, np.repeat(np.arange(hi - lo), count), least)
                of = np.searchsorted(part.first, start, "right") - 1
                bounds = np.searchsorted(of, np.arange(hi - lo + 1))
                out: dict = {n: [] for n in names}
                for d in range(hi - lo):
                    w0, w1 = part.first[d], part.first[d + 1]
                    mine = slice(bounds[d], bounds[d + 1])
                    s, e, p = start[mine] - w0, end[mine] - w0, q[mine]
                    keep = np.ones(w1 - w0, bool)
                    if len(s):
                        dropped = np.zeros(w1 - w0 + 1, np.int64)
                        np.add.at(dropped, s + p, 1)
                        np.add.at(dropped, e, -1)
                        keep = np.cumsum(dropped)[:-1] == 0
                    words = part.data[part.start[w0] : part.end[w1 - 1]].split() if w1 > w0 else []
                    if not keep.all():
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    text = b" ".join(words)
                    rows = list(zip(s.tolist(), (e - s).tolist(), p.tolist()))
                    best = max(rows, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                    value = [int(w1 - w0), rows, best, _sha(text)] + ([text.decode()] if with_text else [])
                    for name, v in zip(names, value):
                        out[name].append(v)
                yield {n: batch[n][lo:hi] for n in ("doc_id",)} | {
                    "n_words": out["n_words"],
                    "runs": [[dict(zip(("start", "length", "period"), r)) for r in rows] for rows in out["runs"]],
                    "longest": [None if r is None else dict(zip(("start", "length", "period"), r)) for r in out["best"]],
                    "collapsed_sha256": out["collapsed_sha256"],
                } | ({"collapsed": out["collapsed"]} if with_text else {})

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, with_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text; others are ignored) to ``doc_id``, ``n_words``, ``runs`` (start,
    length, period: words, from 0, by start and then period), ``longest`` (of equal
    lengths the smallest start, then period), ``collapsed_sha256`` and, if asked for, the
    ``collapsed`` text: the words joined by one space, without those that a run holds
    after its first period.  One row per row.

    A run has at least ``least`` words (an even number, 4 or more) and two periods, its
    period is its smallest, and no neighbouring word keeps it.  A null text has no words; a
    text without runs has an empty list and a null ``longest``; null ids and repeated rows
    are rows like others; no rows give no rows.
    """
    if least < 4 or least % 2:
        raise ValueError("least has to be an even number, 4 or more")
    run = "struct<start: long, length: long, period: long>"
    schema = f"doc_id long, n_words long, runs array<{run}>, longest {run}, collapsed_sha256 string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, _read(least, with_text), schema + ", collapsed string" * with_text)


def replayed(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document (by the checksum of its id) with a tail of repeats: from a word on, the words
    that follow it come again and again.  Other texts, and texts without words, stay."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.when(n > 0, F.array_join(again, " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    with_tail = F.get(F.transform(F.array(words), tail), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(with_tail, text)).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """The runs of each document, every tenth one with a tail of repeats, as counts, the
    longest run and checksums; a null text has none, repeated rows each give a row, no rows
    give none."""
    rows = docs.select("doc_id", replayed(F.col("doc_id"), F.col("text")).alias("text"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    longest = F.col("longest")
    return periodic_runs(rows, with_text=False).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[longest[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * longest["length"] / longest["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
