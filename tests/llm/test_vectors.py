"""Whitening, exact search and periodic runs, each against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from loam.llm import covertree, periodic, whitening
from loam.llm.common import mix

EMBEDDINGS = "vec_id long, embedding array<float>, vector string, n int, point int"


def odd_rows(base):
    """Nulls, repeated rows and ids, other lengths, beside ``base`` rows of (id, list)."""
    rows = base + [base[3], base[3], (base[5][0], base[6][1])]
    rows += [(None, base[7][1]), (None, base[7][1]), (900, None), (901, []), (902, [None] * 64), (950, [float("nan")] * 64)]
    return rows + [(903, [float("inf")] * 64), (1000, [1.5, -2.0]), (1050, [1.5, 2.0]), (1051, [1.5, 2.0])]


def vectors(n=200):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(n, 64)) / 8
    base[: n // 3] = base[0]  # a group of copies
    base[n // 3 : n // 2] = base[1] + rng.normal(size=(n // 2 - n // 3, 64)) / 200
    return odd_rows([(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 2) for r in rows], EMBEDDINGS).repartition(3)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening(spark, weights):
    rows = vectors()
    got = {}
    for r in whitening.whiten(frame(spark, rows), weights=weights).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    for size in (64, 2):
        good = [r for r in rows if r[1] and len(r[1]) == size and None not in r[1] and np.isfinite(r[1]).all()]
        x = np.floor(64 * np.array([v for _, v in good])).astype(int) + 1_000_000
        fit = np.unique(x, axis=0) if weights == "one" else x
        n, total = len(fit), fit.sum(axis=0)
        v = (fit - total / n).T @ (fit - total / n) / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        k = min(32, int((e > 1e-9).sum()))
        want = (x - total / n) @ u[:, :k] / np.sqrt(e[:k])
        for c in range(k):
            mine = [r for (i, comp), rs in got.items() if comp == c + 1 for r in rs if (r.n == n)]
            assert len(mine) == len(good)
            key = lambda r: (r[0] is None, r[0] or 0, abs(r[1]))
            a = sorted(((r.vec_id, r.whitened) for r in mine), key=key)
            b = sorted(((i, w) for (i, _), w in zip(good, want[:, c])), key=key)
            assert [i for i, _ in a] == [i for i, _ in b]
            a, b = (np.array([w for _, w in s]) for s in (a, b))
            assert np.allclose(np.abs(a), np.abs(b), atol=1e-8)
            assert all(abs(r.explained - e[c] / np.trace(v)) < 1e-9 and r.identity_error < 1e-9 for r in mine)
        deviation = sorted(((n * x - total) ** 2).sum(axis=1).tolist())
        assert sorted(r.deviation for (i, comp), rs in got.items() if comp == 1 for r in rs if r.n == n) == deviation
    assert whitening.whiten(frame(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0  # no variance


def test_whitening_of_large_numbers(spark):
    rows = [(1, [1e14, 1.0]), (2, [-1e14, 2.0]), (3, [0.0, 3.0]), (4, [1e300, 1.0])]
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], EMBEDDINGS.replace("float", "double"))
    assert whitening.whiten(df).where("deviation IS NOT NULL").count() <= 6
    got = whitening.whiten(df).where("component = 1").collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and {r.n for r in got} == {3}


def top_k_by_hand(rows, k=5, every=50):
    good = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    out = []
    for a, (i, v) in enumerate(good):
        if i is None or i % every:
            continue
        x = np.floor(256 * np.array(v)).astype(int)
        found = [
            (-int(x @ np.floor(256 * np.array(w)).astype(int)), j is None, j or 0)
            for b, (j, w) in enumerate(good)
            if b != a and len(w) == len(v)
        ]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("block, leaf", [(2048, 32), (16, 2)])
def test_cover_tree(monkeypatch, spark, block, leaf):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "CELLS", 5)
    monkeypatch.setattr(covertree, "LEAF", leaf)
    rows = vectors()
    got = covertree.top_k(frame(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == top_k_by_hand(rows)
    assert covertree.top_k(frame(spark, rows).limit(0)).count() == 0


def test_cover_tree_covers_and_prunes(monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 4)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(12, 8))[rng.integers(0, 12, 600)] * 100 + rng.normal(size=(600, 8))).round()
    order, nodes, radii = covertree.cover_tree(x)
    assert sorted(order.tolist()) == list(range(600)) and len(nodes) > 12
    for (lo, hi, c, first, last), r in zip(nodes, radii):
        assert (np.sqrt(((x[order[lo:hi]] - x[order[c]]) ** 2).sum(axis=1)) <= r + 1e-9).all()
        if last > first:
            assert nodes[first, 0] == lo and nodes[last - 1, 1] == hi
    calls = []
    monkeypatch.setattr(covertree, "_products", lambda a, b: calls.append(a.shape[0] * b.shape[0]) or (a @ b.T).astype(np.int64))
    y = x[order].astype(np.int64)
    q, s, score = covertree.search(y, nodes, radii, np.full(600, -np.inf), y, nodes, radii, 6)
    assert sum(calls) < 600 * 600 / 3
    best = np.sort(y @ y.T, axis=1)[:, -6:]
    for i in range(600):
        assert sorted(score[q == i].tolist())[-6:] == best[i].tolist()


def runs_by_hand(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    k, kind = rng.choice([1, 2, 2, 3, 5, 30]), rng.random()
    if kind < 0.3:
        return [rng.randrange(k) for _ in range(rng.randrange(200))]
    if kind < 0.6:
        out = []
        for _ in range(rng.randrange(1, 5)):
            u = [rng.randrange(k) for _ in range(rng.randrange(1, 40))]
            out += u * rng.randrange(1, 6) + u[: rng.randrange(len(u))]
        return out
    if kind < 0.8:
        u = [0]
        while len(u) < 150:
            u = u * rng.randrange(1, 4) + [rng.randrange(2)] * rng.randrange(1, 3)
        return u * rng.randrange(1, 3)
    if kind < 0.9:
        a, b = [0], [0, 1]
        while len(b) < 300:
            a, b = b, b + a
        return b
    return [0, 1] * rng.randrange(1, 40) + [0] + [0, 1] * rng.randrange(1, 40) + [0]


@pytest.mark.parametrize("least", [12, 4])
def test_runs(least):
    rng = random.Random(5)
    for _ in range(150):
        docs = [repetitive(rng) for _ in range(rng.randrange(1, 5))]
        words = np.array([w for d in docs for w in d], np.uint64)
        found = periodic.find_runs(mix(words + np.uint64(9)), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), least)
        at, want = 0, []
        for d in docs:
            want += [(s + at, s + at + n, q) for s, n, q in runs_by_hand(d, least)]
            at += len(d)
        assert list(map(tuple, found.T.tolist())) == want


def test_one_word_fills_a_text():
    found = periodic.find_runs(np.full(300_000, 7, np.uint64), np.zeros(300_000, int))
    assert found.T.tolist() == [[0, 300_000, 1]]


def test_periodic_query(spark):
    rng = random.Random(6)
    texts = [(i, " \n".join(f"w{w}" for w in repetitive(rng))) for i in range(120)]
    texts += [(None, texts[4][1]), (200, None), (201, ""), (202, " \t "), texts[7], texts[7], (203, "x " * 50_000)]
    df = spark.createDataFrame([(*t, 1, "z") for t in texts], "doc_id long, text string, runs int, words string").repartition(3)
    want = []
    for i, text in texts:
        words = (text or "").split()
        h, n = (zlib.crc32(str(i).encode()), len(words)) if i is not None else (1, 0)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = [(0, 50_000, 1)] if i == 203 and h % 10 else runs_by_hand(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (lines, kept)]
        want.append((i, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha))
    out = periodic.digest(df)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(map(str, want))
    assert sum(w[1] for w in want) > 100
    assert periodic.digest(df.limit(0)).count() == 0
    whole = periodic.periodic_runs(df)
    assert whole.where("doc_id = 203").first().collapsed == "x"
