"""Registered queries against their SQL on odd rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loam.operators import frontier, pages, retrieval
from loam.plans import queries


@pytest.fixture
def held(spark, tmp_path):
    """Runs a query and its SQL on small tables; both have to give the same rows, which are returned."""

    con = duckdb.connect()

    def run(name, **tables):
        for table, (rows, types) in tables.items():
            spark.createDataFrame(rows, types).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        return again(name)

    def again(name):
        out = queries.QUERIES[name](spark, str(tmp_path))
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert got == sorted(want, key=repr)
        return got

    run.again = again
    return run


def test_language_of_texts_without_letters(held):
    texts = ["123 !", "", None, " \n", "\u4e2d\u6587", "ab", "the cat and the dog", "the cat \u0436\u0436\u0436", "1 the 2 the 3 cat"]
    got = held("language_guess", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert [r[1] for r in got] == ["unknown"] * 6 + ["en", "unknown", "en"]


PAGES = "page_id long, url string, html string"


def test_references_without_a_semicolon(held):
    pages = [(1, "u", "<h1>A &amp; B&amp</h1>"), (2, "u", "<h1>C&lt;&amp;D &#39;x&#39;</h1><p>&amp x</p>"), (3, "u", "<p>no heading</p>"), (4, "u", "<h1>R&D &x</h1>")]
    assert held("headings_in_sql", pages=(pages, PAGES))[0] == (1, 1, "A & B&amp")


def test_verdicts_of_pages_that_share_a_url(held):
    links = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    pages = [
        (1, "https://a.example.org/x/1", links("/x/2", "/y/3", "/x/2")), (2, "https://a.example.org/x/1", links("/x/4", "/y/3")),
        (3, "https://a.example.org/x/1", None), (4, "https://a.example.org/z/1", links("/z/2", "/y/3")), (5, None, links("/z/2")),
    ]
    assert ("https://a.example.org/x/1", "out_of_scope", 6) in held("link_verdicts", pages=(pages, PAGES))


def test_stream_of_pages_that_share_a_url(held):
    text = lambda k: "".join(f"<p>Thing{i} of page{k + i} differs{i} from{i * k} others.</p>" for i in range(40))
    pages = [(k, "https://a.example.org/x/1", f"<html><body><h1>T</h1>{text(k)}</body></html>") for k in (1, 2)]
    pages += [(3, None, f"<h1>T</h1>{text(3)}"), (4, "https://a.example.org/x/4", "<p>short</p>")]
    assert len(held("stream_ingest", pages=(pages, PAGES))) == 6


VECTORS = "vec_id long, embedding array<float>, label long"


def test_nearest_units_of_equal_and_odd_vectors(held, spark):
    rows = [(i, [float(i % 7) / 3, 0.1 * (i % 3), 1.0], i % 4) for i in range(300)]
    assert len(held("knn_topk", embeddings=(rows, VECTORS))) == 15
    vectors = [[1.0, 2.0], None, [1.0, None], [3.0], [float("nan"), 1.0], [float("inf"), 0.0], [0.5, 0.5], [2.0, 2.0]]
    units = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "unit_id int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (7, None), (9, [2.0])], "query_id int, embedding array<double>")
    for rows in (units, units.repartition(5)):
        found = retrieval.nearest_units(asked, rows, 7, not_self=True).orderBy("query_id", "rank").collect()
        assert [r.unit_id for r in found] == [4, 5, 7, 0, 6, 2, 3, 0, 1, 2, 3, 4, 5, 6, 3, 0, 1, 2, 4, 5, 6]
        assert [r.score for r in found[1:]] == [float("inf"), 4.0, 3.0, 1.0] + [None] * 9 + [6.0] + [None] * 6


def test_widened_hits_take_products(held, spark):
    rows = [(i, [float(i % 7), float(i % 3)], i % 4 if i % 5 else None) for i in range(400)]
    assert len(held("widened_hits", embeddings=(rows, VECTORS))) == 20
    e = spark.createDataFrame(rows, VECTORS)
    q, u = e.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding"), e.selectExpr("vec_id AS unit_id", "embedding")
    # products of matrices, not one pair at a time
    assert "zip_with" not in retrieval.nearest_units(q, u, 5)._jdf.queryExecution().toString()


def test_near_duplicates_without_a_join_of_pairs(held, monkeypatch):
    monkeypatch.setattr(retrieval, "near_duplicate_pairs", None)
    words = "river stone cloud winter market garden window letter planet silver".split()
    text = lambda i: " ".join(words[(i * j) % 10] + "xyz"[(i // 7 + j) % 3] for j in range(1, 3 + i % 9))
    odd = [(900, "a", None), (901, "a", ""), (902, "a", "?!"), (904, "a", "ab"), (905, "b", "Ab."), (906, "b", "AB"), (907, "a", "\U0001f600 \u00c4b")]
    docs = [(i, "ab"[i % 3 == 0], text(i)) for i in range(160)] + odd
    types = "doc_id long, source string, text string"
    turns = [(d // 4, d % 4, t) for d, _, t in docs]
    assert len({r[2] for r in held("near_duplicates", documents=(docs, types))}) > 20
    assert len(held("turn_duplicates", conversations=(turns, "conv_id long, turn int, text string"))) == 166
    monkeypatch.setattr(retrieval, "GROUP_TEXTS", 7)
    held.again("near_duplicates")


def test_near_duplicates_shuffle_no_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "GROUP_TEXTS", 10)
    sc, some = spark.sparkContext._jsc.sc(), random.Random(3)
    texts = ["".join(some.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)) for _ in range(600)]

    def shuffled(n):
        def total():
            sc.listenerBus().waitUntilEmpty()
            executors = sc.statusStore().executorList(False)
            return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

        before = total()
        rows = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts[:n])], "grp string, id long, text string")
        assert retrieval.near_duplicate_classes(rows, "grp", "id").where("class_id = id").count() == n
        return total() - before

    # written once or twice a text, not once for each block that it meets
    assert shuffled(600) < 3 * shuffled(200) * 1.2


def test_near_duplicates_of_large_classes(held, monkeypatch):
    monkeypatch.setattr(retrieval, "GROUP_TEXTS", 4)
    monkeypatch.setattr(retrieval, "FEW_BLOCKS", 1)
    monkeypatch.setattr(retrieval, "GRAM_COLUMNS", 50)
    some, words = random.Random(5), ["".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(60)]
    docs = [(i, "a", " ".join(some.sample(words[: 12 + 12 * (i % 2)], 4 + i % 8))) for i in range(200)]
    classes = [r[2] for r in held("near_duplicates", documents=(docs, "doc_id long, source string, text string"))]
    assert max(classes.count(c) for c in set(classes)) > 8 and len(set(classes)) > 20


def test_robots_are_joined_by_shuffles(spark):
    rules = frontier.robots_rules(spark.createDataFrame([("https://a", 200, "User-agent: *\nDisallow: /x")], "origin string, status int, body string"))
    out = frontier.robots_verdicts(spark.createDataFrame([("https://a", "/x"), ("https://b", "/")], "origin string, path string"), rules)
    assert {tuple(r) for r in out.select("path", "robots_allowed").collect()} == {("/x", False), ("/", False)}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_hydrated_hits_stay_in_many_tasks(held, spark):
    lines = [(i % 30, i % 7) for i in range(200)]
    orders = [(i, i % 11) for i in range(30)]
    tables = {"lineitem": (lines, "l_orderkey long, l_suppkey long"), "orders": (orders, "o_orderkey long, o_custkey long"), "customer": ([(i,) for i in range(11)], "c_custkey long")}
    assert len(held("hydrated_hits", **tables)) > 50
    hits, units = spark.createDataFrame(lines, "unit_id long, q long"), spark.createDataFrame(orders, "unit_id long, document_id long")
    docs = spark.createDataFrame([(1, "u", None)], "document_id long, url string, canonical_url string")
    assert "REPARTITION_BY_NUM" in retrieval.hydrate(hits, units, docs, 9)._jdf.queryExecution().executedPlan().toString()


def test_pages_reach_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, 64 << 20)
    rows = [(i, "<h1>T</h1>" + "<p>a b</p>" * 700) for i in range(5)] + [(9, None)]
    out = pages.flat_blocks(spark.createDataFrame(rows, "page_id long, html string"))
    assert int(spark.conf.get(name)) == 4 << 20
    assert [tuple(r) for r in out.groupBy("page_id").agg(F.max("pos")).orderBy("page_id").collect()] == [(i, 700) for i in range(5)]
