"""Helpers that the corpus operators share: word hashes, row batches, repeated keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import BATCH_BYTES, discard, scratch_dir, small_batches, written

__all__ = ["BATCH_BYTES", "connected_components", "discard", "scratch_dir", "small_batches", "written"]

#: bytes that separate words: space, tab, newline, vertical tab, form feed, return
WORD_BREAKS = b" \t\n\x0b\x0c\r"

#: text is hashed in pieces of about this many bytes, so that arrays stay small
PIECE_BYTES = 1 << 20

#: rows that a task takes up at once; what Spark hands over in one batch may be much more
ROWS = 1024

#: a null doc_id stands before all others
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- word hashes

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(WORD_BREAKS)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants); also scatters sums."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(max(n, 1), np.uint64(base), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


class Words:
    """Words of some documents in one buffer: ``start`` and ``end`` are byte offsets in
    ``data``, ``hash`` has 64 bits a word, and document ``k`` has the words
    ``first[k]:first[k + 1]``."""

    def __init__(self, docs: list[bytes]):
        self.data = b"\n".join(docs) + b"\n"
        a = np.frombuffer(self.data, np.uint8)
        gap = _IS_BREAK[a]
        edge = np.empty(len(gap), bool)
        edge[0] = True
        edge[1:] = gap[:-1]
        self.start = np.flatnonzero(~gap & edge)
        edge[0] = True
        self.end = np.flatnonzero(gap & ~edge)
        begins = np.cumsum([0] + [len(d) + 1 for d in docs])
        self.first = np.searchsorted(self.start, begins)
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        at = np.arange(len(a)) - np.repeat(
            np.concatenate(([0], self.start)), np.diff(np.concatenate(([0], self.start, [len(a)])))
        )
        at[gap] = 0
        with np.errstate(over="ignore"):
            value = _BYTE[a] * powers(int(_STEP), int((self.end - self.start).max()) + 1)[at]
            value[gap] = 0
            self.hash = mix(np.add.reduceat(value, self.start))


def pieces(docs: list[bytes], most: int = PIECE_BYTES):
    """Runs ``(from, to)`` of documents of about ``most`` bytes; a longer one stays whole."""
    at = size = 0
    for i, d in enumerate(docs):
        size += len(d)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(docs):
        yield at, len(docs)


def shingle_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` consecutive words; fewer words are one run."""
    k = len(word_hash)
    if not k:
        return word_hash
    size = min(n, k)
    with np.errstate(over="ignore"):
        total = np.zeros(k - size + 1, np.uint64)
        for j, p in enumerate(powers(0xD6E8FEB86659FD93, size)):
            total += word_hash[j : k - size + 1 + j] * p
        return mix(total + np.uint64(size))


# --------------------------------------------------------------------------- row batches


def _lists(batches):
    """Dicts from column name to list of at most ROWS rows, from Arrow batches."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            yield {n: part.column(n).to_pylist() for n in part.schema.names}


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` in plain lists: ``fn`` gets an iterator of dicts from column name
    to list, some rows each, and yields dicts of lists for ``schema``.  Integers
    stay integers beside nulls, which pandas would turn into floats."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    small_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        for out in fn(_lists(batches)):
            yield pa.RecordBatch.from_pydict(out, schema=target)

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn`` on each group of rows with equal keys: it gets a dict from column name to
    list and gives one back for ``schema``.

    Groups are brought together by one shuffle, sorted and streamed, so that a task holds
    one group at a time; callers bound the size of a group by its keys.
    """

    def run(batches):
        last, group, out, size = None, None, None, 0
        for batch in batches:
            n = len(batch[keys[0]])
            key = list(zip(*(batch[k] for k in keys)))
            at = 0
            while at < n:
                to = at + 1
                while to < n and key[to] == key[at]:
                    to += 1
                part = {k: v[at:to] for k, v in batch.items()}
                if group is not None and key[at] == last:
                    for k, v in part.items():
                        group[k] += v
                else:
                    if group is not None:
                        out, size = _add(out, fn(group), size)
                        if size > 10_000:
                            yield out
                            out, size = None, 0
                    last, group = key[at], part
                at = to
        if group is not None:
            out, size = _add(out, fn(group), size)
        if out is not None:
            yield out

    return map_batches(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def _add(out: dict | None, more: dict, size: int) -> tuple[dict, int]:
    size += len(next(iter(more.values())))
    if out is None:
        return {k: list(v) for k, v in more.items()}, size
    for k, v in more.items():
        out[k] += v
    return out, size


def least_labels(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row that links reach."""
    n = len(link)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(link, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


# --------------------------------------------------------------------------- repeated keys

#: keys that one task groups before the shuffle
LOCAL_KEYS = 1 << 18


def repeated_keys(df: DataFrame, emit, fields: list[str], distinct: bool = False) -> DataFrame:
    """The rows, of those that ``emit`` makes of each batch, whose key occurs more than
    once: ``key`` and ``fields``, all long.  ``emit`` yields pairs of an int64 array of
    keys and a list of int64 arrays.  With ``distinct``, equal rows of a task are one.

    Rows are grouped within a task before the shuffle.  A key that occurs once there
    travels to the others like it.  Of one that occurs often there it is known already
    that it repeats: its rows are dealt out evenly, and one bare row tells the other
    tasks.  So a hot key sends one row per task, and no bucket is larger than others.
    """
    names = ["how", "key", *fields]  # how: 0 asks, 1 is known to repeat, 2 tells
    types = lambda columns: ", ".join(f"{n} long" for n in columns)

    def batch_of(columns: list[np.ndarray], of: list[str]):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=of)

    def local(batches):
        held: list[list[np.ndarray]] = []

        def flush():
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            if distinct:
                order = np.lexsort(columns[::-1])
                columns = [x[order] for x in columns]
                new = np.any([x[1:] != x[:-1] for x in columns], axis=0)
                columns = [x[np.append(True, new)] for x in columns]
            key = columns[0]
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            often = np.empty(len(key), bool)
            often[order] = (np.diff(np.append(np.flatnonzero(new), len(key))) > 1)[np.cumsum(new) - 1]
            rows = [often.astype(np.int64), *columns]
            for lo in range(0, len(key), 50_000):
                yield batch_of([x[lo : lo + 50_000] for x in rows], names)
            told = np.unique(key[often])
            yield batch_of([np.full(len(told), 2), told, *[np.zeros(len(told), np.int64)] * len(fields)], names)

        for batch in _lists(batches):
            for key, columns in emit(batch):
                if len(key):
                    held.append([key, *columns])
            if sum(len(x[0]) for x in held) >= LOCAL_KEYS:
                yield from flush()
        if held:
            yield from flush()

    def joined(batches):
        last, pending = None, None  # the key before, and its row if that may yet repeat
        for batch in batches:
            how, *columns = (batch.column(n).to_numpy(zero_copy_only=False) for n in names)
            known = how == 1
            asks = np.flatnonzero(~known)
            take = known.copy()
            if len(asks):
                a, h = columns[0][asks], how[asks]
                same = a[1:] == a[:-1]
                before = np.concatenate(([last is not None and a[0] == last], same))
                if before[0] and pending is not None:
                    yield batch_of(pending, names[1:])
                take[asks] = (before | np.append(same, False)) & (h == 0)
                last = a[-1]
                k = asks[-1]
                if not before[-1] and h[-1] == 0:
                    pending = [x[k : k + 1].copy() for x in columns]
                elif before[-1] or h[-1] == 2:
                    pending = None
            yield batch_of([x[take] for x in columns], names[1:])

    small_batches(df.sparkSession)
    place = F.when(F.col("how") == 1, F.xxhash64(*fields)).otherwise(F.col("key"))
    dealt = df.mapInArrow(local, types(names)).repartition(place).sortWithinPartitions("key")
    return dealt.mapInArrow(joined, types(names[1:]))
