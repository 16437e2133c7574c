"""Best-fit packing of token sequences, certified by dual-feasible lower bounds.

Documents become pieces of at most ``size`` tokens.  Pieces shorter than that are dealt
to partitions of bounded count, and each partition packs its own by best-fit decreasing.
Dual-feasible functions bound from below the bins that a partition's pieces need; where
the bound is met, the partition is certified and done.  The others put the pieces of
their unfilled bins into a pool that is dealt anew and packed again, for as long as a
round saves bins.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

SIZE = 1024
#: id that ends each document
END = 2
#: pieces that one partition packs at most, about; bounds its memory
PER_PARTITION = 1 << 16
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


# --------------------------------------------------------------------------- tokens


@lru_cache(1)
def _encoders(ranks_path: str, pattern: str):
    """Two encoders of one vocabulary: the full pattern, and one without look-ahead, which
    is faster and differs only where white space follows white space."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    make = lambda name, p: tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
    return make("full", pattern), make("plain", pattern.replace(r"|\s+(?!\S)", ""))


_SPACES = re.compile(r"\s\s")
#: runs of white space of this length go to the tokenizer file itself: the pattern's
#: look-ahead costs the other encoder stack for each character of a run
_GAP = re.compile(r"\s{4096}")


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str, ranks_path: str | None = None, file_path: str | None = None) -> list[int]:
    """Ids as the byte-level tokenizer file gives them without special tokens added; the
    special token's own string in a text is its id, as that file has it.  A text of any
    length and of anything is taken."""
    import public_tokenizers as vocabulary

    if _GAP.search(text):
        return _tokenizer(file_path or vocabulary.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    full, plain = _encoders(ranks_path or vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN)
    encode = (full if _SPACES.search(text) else plain).encode_ordinary
    if SPECIAL not in text:
        return encode(text)
    out: list[int] = []
    for i, part in enumerate(text.split(SPECIAL)):
        if i:
            out.append(SPECIAL_ID)
        out += encode(part)
    return out


def pieces_of(docs: DataFrame, size: int = SIZE, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece`` from 0, ``start``, ``length``,
    ``ids_crc32``.  Only documents of more than ``size`` ids are cut; their first piece
    has what the full ones leave.  A null text is empty and has the end id alone; null ids
    are carried as they are; repeated rows give their pieces each; no rows give none."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = array("I", token_ids(text or "", ranks_path))
                ids.append(END)
                ends = range((len(ids) - 1) % size + 1, len(ids) + 1, size)
                for k, end in enumerate(ends):
                    start = max(0, end - size)
                    part = np.asarray(ids[start:end], "<u4")
                    for into, x in zip(out.values(), (doc_id, k, start, end - start, zlib.crc32(part.tobytes()))):
                        into.append(x)
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --------------------------------------------------------------------------- bounds


def lower_bound(lengths: np.ndarray, size: int = SIZE) -> int:
    """Bins that ``lengths`` need at least: the best of several dual-feasible functions.

    Each f maps sizes to weights so that whatever fits one bin weighs at most 1; the sum
    of weights is then a bound.  Used are the identity, the threshold functions (sizes
    over 1 - e count 1, below e count 0) for every e up to half a bin, and the rounding
    functions of step k: x if (k + 1) x is whole, else floor((k + 1) x) / k.
    """
    n = np.bincount(lengths, minlength=size + 1)[: size + 1].astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // size)
    upto_n, upto_x = np.cumsum(n), np.cumsum(n * x)
    e = np.arange(1, size // 2 + 1)
    big = upto_n[size] - upto_n[size - e]
    middle = upto_x[size - e] - upto_x[e - 1]
    best = max(best, int((big + -(-middle // size)).max()))
    for k in range(1, 33):
        whole = (k + 1) * x % size == 0
        # in units of 1 / (k * size)
        weight = np.where(whole, x * k, (k + 1) * x // size * size)
        best = max(best, -(-int((n * weight).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and how full each bin is.

    Open bins are stacked by what is left in them, and the bits of one integer tell which
    stacks have any, so that the tightest one is found at once.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: list[list[int]] = [[] for _ in range(size + 1)]
    open_, filled = 0, []
    for i, x in zip(order.tolist(), lengths[order].tolist()):
        fits = open_ >> x
        if fits:
            room = (fits & -fits).bit_length() - 1 + x
            b = left[room].pop()
            if not left[room]:
                open_ ^= 1 << room
        else:
            room, b = size, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += x
        if room > x:
            if not left[room - x]:
                open_ |= 1 << (room - x)
            left[room - x].append(b)
    return bins, offsets, np.array(filled, np.int64)


# --------------------------------------------------------------------------- packing


def _pack_round(items: DataFrame, groups: int, round_: int, size: int) -> DataFrame:
    """Items (row, length) dealt to ``groups`` and packed there: with ``sequence_id``,
    ``offset``, ``settled`` (its bin stays) and, once per group, ``bins`` and ``bound``."""

    def run(key, pdf):
        import pandas as pd

        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, filled = best_fit_decreasing(lengths, size)
        bound = lower_bound(lengths, size)
        settled = (filled[bins] == size) | (len(filled) == bound)
        first = np.arange(len(lengths)) == 0
        return pd.DataFrame(
            {
                "row": pdf["row"],
                "length": lengths,
                "sequence_id": (round_ * groups_at_most + int(key[0])) * (PER_PARTITION * 8) + bins,
                "offset": offsets,
                "settled": settled,
                "bins": np.where(first, len(filled), 0),
                "bound": np.where(first, bound, 0),
                "open_bins": np.where(first, 0 if len(filled) == bound else int((filled < size).sum()), 0),
            }
        )

    groups_at_most = 1 << 36
    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInPandas(
        run,
        "row long, length long, sequence_id long, offset long, settled boolean, bins long, bound long, open_bins long",
    )


def pack(pieces: DataFrame, size: int = SIZE, per_partition: int = PER_PARTITION, rounds: int = 6) -> DataFrame:
    """``pieces`` (any columns, ``length`` from 1 to ``size`` among them) with
    ``sequence_id`` and ``offset``, which replace columns of these names; no rows give no
    rows.

    Offsets in a sequence run on from 0 without gaps.  Rows are told apart by an id of
    their own, so that repeated rows are packed each for itself.  A round's result is
    taken only if it needs fewer bins for the pooled pieces than they had.
    """
    pieces = pieces.drop("sequence_id", "offset").select(F.struct("*").alias("piece"), F.col("length").cast("long").alias("length"))
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == size).select(
        "row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    pool = pieces.where(F.col("length") < size).select("row", "length")
    placed, had = full, None
    for round_ in range(rounds):
        n = pool.count()
        if not n:
            break
        # hashing deals unevenly: partitions are planned half full
        packed = written(_pack_round(pool, -(-n * 2 // per_partition), round_, size), "packed")
        total, open_bins = packed.agg(F.sum("bins"), F.sum("open_bins")).first()
        if had is not None and total >= had:
            break
        if had is not None:
            placed = placed_before
        placed_before = placed.union(packed.where("settled").select("row", "sequence_id", "offset"))
        placed = placed.union(packed.select("row", "sequence_id", "offset"))
        pool, had = packed.where("NOT settled").select("row", "length"), open_bins
    return pieces.join(placed, "row").select("piece.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, size: int = SIZE, ranks_path: str | None = None) -> DataFrame:
    """All documents (doc_id, text; others are ignored) as packed pieces: ``doc_id``,
    ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.

    A null or empty text is one piece of the end id; null ids are carried as they are;
    repeated rows are packed each for itself; pieces of one length may change places; no rows
    give no rows.
    """
    return pack(pieces_of(docs, size, ranks_path), size)
