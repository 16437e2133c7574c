"""Small literal tables for the jobs, and the laws they keep."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions import urls as U
from loam.operators import audit, blocks, evaluate, frontier, index, pages, registry, retrieval
from loam.settings import Settings
from loam.sources import datasets, tables
from loam.streaming import jobs


def one(df):
    return df.collect()[0][0]


def column(spark, rows, types, expr):
    return [r[0] for r in spark.createDataFrame(rows, types).select(expr).collect()]


def test_settings_hold_together():
    for bad in ({"rerank_size": 13}, {"evidence_max": 7}, {"chunk_overlap_tokens": 600}, {"chunk_max_tokens": 1600}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_heading_paths(spark):
    flat = [("heading", 1, "A"), ("p", 0, "x"), ("heading", 2, "A"), ("p", 0, "y"), ("heading", 3, "B"), ("p", 0, "z"), ("heading", 2, "C"), ("p", 0, "w"), ("heading", 1, "D"), ("p", 0, "v")]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(flat)], "page_id long, pos int, block_type string, level int, text string")
    got = {r.text: r.heading_path for r in blocks.heading_paths(df).collect()}
    assert got == {"x": ["A"], "y": ["A"], "z": ["A", "B"], "w": ["A", "C"], "v": ["D"]}


def test_units_keep_every_block(spark):
    prose = lambda k, n: f"Block {k} says something. " + "words and more words here. " * n
    rows = [(1, i, "p", prose(i, 40), ["A"], 1) for i in range(8)] + [(1, 8, "code", "y = f(x); " * 500, ["A"], 1), (1, 9, "p", "Home", ["B"], 1), (1, 10, "p", "Short sentence.", ["C"], 1)]
    df = spark.createDataFrame(rows, "page_id long, pos int, block_type string, text string, heading_path array<string>, heading_level int")
    kept, rejects = blocks.units(df)
    units = sorted(kept.collect(), key=lambda u: u.ordinal)
    assert [u.ordinal for u in units] == list(range(len(units)))
    assert all(u.tokens <= 1000 or u.oversized for u in units) and sum(u.oversized for u in units) == 1
    told = "\n\n".join([u.text for u in units] + [r.text for r in rejects.collect()])
    assert all(r[3].strip() in told for r in rows)
    assert {r.reason for r in rejects.collect()} == {"navigation_boilerplate", "below_usefulness_floor"}
    assert not units[0].continued_from_previous and any(u.overlap_tokens > 0 for u in units)


def test_gate_and_metadata(spark):
    rows = [(1, "404 page", "text/html"), (2, "short", "text/html"), (3, "same words again and " * 40, "text/html"), (4, " ".join(f"w{i}" for i in range(90)), None), (5, " ".join(f"w{i}" for i in range(90)), "TEXT/HTML; x"), (6, None, "text/html"), (7, "a", "application/pdf")]
    got = {r.doc_id: r.reject_reason for r in pages.page_gate(spark.createDataFrame(rows, "doc_id long, text string, ct string"), "text", "ct").collect()}
    assert got == {1: "error_page", 2: "too_small", 3: "boilerplate_heavy", 4: "missing_content_type", 5: None, 6: "no_content", 7: "non_html_content_type"}
    page = [(1, "https://x.org/cloud/rest/v3/a-thing/", "<title>How to do</title><link rel='canonical' href='https://c'>")]
    m = pages.page_metadata(spark.createDataFrame(page, "page_id long, url string, html string")).first()
    assert (m.title, m.title_confidence, m.category, m.category_confidence, m.page_type, m.canonical_url) == ("How to do", 0.6, "rest-api", 0.95, "api_reference", "https://c")


@pytest.mark.parametrize(
    "url,reason",
    [
        ("https://a.com/x", None), ("http://127.0.0.1/", "loopback"), ("ftp://a.com", "non_web_scheme"), ("/rel", "not_absolute"),
        ("https://u:p@a.com", "embedded_credentials"), ("https://a.com:8080/", "disallowed_port"), ("https://A.com./p", None),
        ("https://b.com", "not_allowlisted"), ("http://[::1]/", "loopback"), ("http://169.254.169.254/", "cloud_metadata"), ("", "malformed"),
        ("https://localhost/", "not_allowlisted"), ("http://10.1.2.3", "private_range"), ("http://224.0.0.1", "multicast"), ("http://a.com:99999", "malformed"),
    ],
)
def test_admissibility(spark, url, reason):
    assert column(spark, [(url,)], "url string", U.admissibility("url", F.array(F.lit("a.com")))) == [reason]


def test_urls(spark):
    hrefs = {"../b.html#x": "https://a.com/d/b.html", "//h.com/z": "https://h.com/z", "/q": "https://a.com/q", "mailto:x": None, "a\\b": None, "#f": "https://a.com/d/e/f.html", "?p=1": "https://a.com/d/e/f.html?p=1", "./c/": "https://a.com/d/e/c/"}
    got = spark.createDataFrame([(h,) for h in hrefs], "href string").select("href", U.resolved("href", F.lit("https://a.com/d/e/f.html"))).collect()
    assert {r[0]: r[1] for r in got} == hrefs
    scope = [("https://a.com/docs/x", "https://a.com/docs/start", True), ("https://a.com/docs-old/x", "https://a.com/docs/start", False), ("https://b.com/docs/x", "https://a.com/docs/start", False), ("https://a.com/d%6Fcs/x/y", "https://a.com/docs/start", True)]
    assert column(spark, scope, "u string, s string, w boolean", U.in_scope("u", "s") == F.col("w")) == [True] * 4
    assert column(spark, [("java\tscript:x",), ("//evil",), ("/a",), ("HTTPS://x",), ("",)], "u string", U.is_safe_link("u")) == [False, False, True, True, False]


def test_robots_and_frontier(spark):
    body = "User-agent: *\nDisallow: /p\nAllow: /p/a$\nCrawl-delay: 3\n\nUser-agent: Loam-bot\nUser-agent: x\nDisallow: /z*.html # no\nAllow: /z/\nDisallow:\n"
    rob = spark.createDataFrame([("o1", 200, body), ("o2", 404, None), ("o3", 500, None), ("o5", 200, body.replace("Loam-bot", "other"))], "origin string, status int, body string")
    rules = frontier.robots_rules(rob)
    asked = {("o1", "/p"): True, ("o1", "/z/x.html"): False, ("o1", "/zz.html"): False, ("o1", "/z/x"): True, ("o2", "/a"): True, ("o3", "/a"): False, ("o4", "/a"): False, ("o5", "/p/a"): True, ("o5", "/p/ab"): False}
    got = frontier.robots_verdicts(spark.createDataFrame(list(asked), "origin string, path string"), rules).collect()
    assert {(r.origin, r.path): r.robots_allowed for r in got} == asked
    assert {r.origin: r.delay for r in frontier.crawl_delays(rules).collect()}["o5"] == 3.0
    start = "https://a.com/docs/start"
    links = [(start, 0, "b"), (start, 1, "b#x"), (start, 2, "/other"), (start, 3, "mailto:x"), (start, 4, "a")]
    xml = "<urlset><url><loc>https://a.com/docs/a?x=1&amp;y=2</loc></url><url><loc>https://a.com/more.xml</loc></url></urlset>"
    found = frontier.candidates(
        spark.createDataFrame([(start,)], "start_url string"), spark.createDataFrame(links, "start_url string, pos int, href string"),
        frontier.sitemap_urls(spark.createDataFrame([(start, xml)], "start_url string, xml string")),
    )
    judged = frontier.verdicts(found)
    assert {r.verdict: r["count"] for r in judged.groupBy("verdict").count().collect()} == {"admitted": 4, "duplicate": 1, "out_of_scope": 1, "malformed": 1}
    small = Settings(crawl_max_pages=2)
    assert [r.url for r in frontier.frontier(judged, small).orderBy("rank").collect()] == [start, "https://a.com/docs/a"]
    assert {r.verdict: r["count"] for r in frontier.refusals(judged, small).collect()}["capped"] == 2


def test_supersession_and_upsert(spark):
    types = "document_id string, ordinal int, text_fingerprint string"
    old = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 2, "c")], types).withColumn("vector_id", T.vector_id("document_id", "ordinal"))
    new = spark.createDataFrame([("d", 0, "a"), ("d", 1, "x"), ("e", 0, "n")], types)
    plan = {(r.document_id, r.ordinal): (r.action, r.vector_id) for r in registry.supersession_plan(old, new).collect()}
    assert plan == {("d", 0): ("unchanged", "d#0000"), ("d", 1): ("supersede", "d#0001"), ("d", 2): ("orphan", "d#0002"), ("e", 0): ("write", "e#0000")}
    again = registry.supersession_plan(new.withColumn("vector_id", T.vector_id("document_id", "ordinal")), new)
    assert {r.action for r in again.collect()} == {"unchanged"}
    cur, add = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = registry.upsert(cur, add, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, registry.upsert(once, add, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        registry.delete_ids(cur, add.limit(0), "k")


def test_registry_rows(spark):
    docs = spark.createDataFrame([("d1", "processed", None, True), ("d2", "deleted", None, False), ("d3", "processed", None, True)], "document_id string, state string, state_detail string, vectors_live boolean")
    out = spark.createDataFrame([("d1", False, "timeout"), ("d2", True, None)], "document_id string, ok boolean, code string")
    got = {r.document_id: (r.state, r.state_detail, r.vectors_live) for r in registry.page_outcomes(docs, out).collect()}
    assert got == {"d1": ("failed", '{"code":"timeout"}', True), "d2": ("deleted", None, False), "d3": ("processed", None, True)}
    req = spark.createDataFrame([("s1", "j1", 1), ("s1", "j2", 2), ("s2", "j3", 1)], "source_id string, job_id string, requested_at int")
    jobs_ = spark.createDataFrame([("s2", "j0", "running"), ("s1", "j9", "failed")], "source_id string, job_id string, status string")
    assert {r.job_id: (r.admitted, r.running_job) for r in registry.admit_jobs(req, jobs_).collect()} == {"j1": (True, None), "j2": (False, "j1"), "j3": (False, "j0")}
    cur = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string")
    patch = spark.createDataFrame([(1, ["y"], "ignored", None)], "k int, set_fields array<string>, x string, y string")
    assert tuple(registry.patch(cur, patch, "k", ["x", "y"]).first()) == (1, "a", None)
    bad = registry.violations(docs, "document_id", registry.CHECKS["documents"] | {"tombstone_means_deleted": "true"}, {"state": ["state"]})
    assert {(r.rule, r.key) for r in bad.collect()} == {("state", "d1")}
    hist = spark.createDataFrame([("d", 1, "deleted"), ("d", 2, "processed"), ("e", 1, "processed"), ("e", 2, "deleted")], "document_id string, at int, state string")
    assert [r.document_id for r in registry.bad_transitions(hist).collect()] == ["d"]


def test_questions(spark):
    rows = [("q1", "How do I create X and how can I delete Y?", '{"product":" Jira","confidence":{"product":0.9,"category":"0.2"},"category":"root","entities":["a"," "]}'), ("q2", "jira vs confluence", "x"), ("q3", "rotate a token and revoke it", '{"product":"sap","confidence":{"product":7}}')]
    an = retrieval.filter_plan(retrieval.normalise_analysis(spark.createDataFrame(rows, "question_id string, question string, raw_json string")))
    got = {r.question_id: r for r in an.collect()}
    assert (got["q1"].detected_product, got["q1"].detected_category, got["q1"].filter_reason) == ("jira", None, "confident")
    assert (got["q2"].filter_reason, got["q2"].named_products) == ("ambiguous", ["jira", "confluence"])
    assert (got["q3"].detected_product, got["q3"].confidence["product"], got["q3"].filter_reason) == (None, 0.0, "low_confidence")
    q = [(r.question_id, r.query, r.filter_product) for r in retrieval.scoped_filters(retrieval.rewrites(an)).orderBy("question_id", "rewrite").collect()]
    assert q == [
        ("q1", "How do I create X?", "jira"), ("q1", "how can I delete Y?", "jira"), ("q2", "jira vs confluence [scope: jira]", "jira"),
        ("q2", "jira vs confluence [scope: confluence]", "confluence"), ("q3", "rotate a token and revoke it", None),
    ]


def test_knn_in_blocks_is_the_same(spark, monkeypatch):
    units = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(60)], "unit_id int, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "query_id int, embedding array<double>")
    key = lambda df: sorted((r.query_id, r.rank, r.unit_id) for r in df.collect())
    whole = key(retrieval.nearest_units(q, units, 4))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 2)
    assert key(retrieval.nearest_units(q, units, 4)) == whole and len(whole) == 36


def test_evidence(spark):
    far = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota", "kappa lambda mu", "nu xi omicron", "alpha beta gamma."]
    rows = [("q", "alpha question", f"u{i}", i + 1, 0.9 - i / 10, "d0" if i < 3 else f"d{i}", "p1" if i == 4 else "p0", far[i], ["H"], "http://x") for i in range(6)]
    types = "question_id string, question string, unit_id string, pool_rank int, score double, document_id string, product string, text string, heading_path array<string>, source_url string"
    pool = spark.createDataFrame(rows, types)
    rr = retrieval.rerank(pool, score=F.col("score"))
    order = lambda df: [r.unit_id for r in retrieval.select_evidence(df).orderBy("evidence_rank").collect()]
    assert order(rr) == ["u0", "u1", "u3", "u4"]  # a third unit of d0 and a near duplicate are passed over
    assert order(rr.withColumn("required_groups", F.array(F.lit("p1")))) == ["u4", "u0", "u1", "u3"]
    assert order(rr.withColumn("prefer_group", F.lit("p1"))) == ["u4", "u0", "u1"]
    gate = retrieval.evidence_gate(rr, retrieval.select_evidence(rr), Settings(min_rerank_score=0.95)).first()
    assert gate.refused and gate.gate_reason == "BELOW_MIN_RERANK_SCORE"
    none = spark.createDataFrame([], "question_id string, index int, score double")
    assert [r.unit_id for r in retrieval.rerank(pool, none).orderBy("rerank_rank").collect()] == [f"u{i}" for i in range(6)]
    assert retrieval.refusal_leads(rr).count() == 3


def test_claims(spark):
    answer = "How to? [1] The quick brown fox jumps high [2]. [E3] Second claim here is very long indeed. no."
    df = spark.createDataFrame([(answer, ["quick brown foxes jumps high again"])], "a string, q array<string>")
    r = df.select(T.substantive_sentences("a").alias("s"), T.uncited_claims("a").alias("u"), T.faithfulness("a", "q").alias("f")).first()
    assert r.s == ["The quick brown fox jumps high [2]. [E3]", "Second claim here is very long indeed."]
    assert r.u == ["Second claim here is very long indeed."] and r.f == 0.5
    m = audit.resolve_markers(spark.createDataFrame([("x [E2] y [E9] z [E1][E2].", ["a", "b"])], "answer string, served array<string>")).first()
    assert (m.resolved_text, m.cited_ids, m.rejected_markers) == ("x [1] y z [2][1].", ["b", "a"], ["E9"])
    raw = ['{"answer":"x","answerable":true,"citations":[{"evidence_id":"a"}]}', "[1]", '{"answer":1,"answerable":true}', '{"answer":"x","answerable":true,"citations":[{"source_url":"u"}]}', '{"answer":"x","answerable":true,"citations":3}', "no"]
    got = [x.malformed for x in audit.parse_answers(spark.createDataFrame([(x,) for x in raw], "raw_json string")).collect()]
    assert got == [None, "no_json_object", "malformed_answer", "citation_without_id", "malformed_citations", "no_json_object"]


def test_citations(spark):
    cited = spark.createDataFrame([("a", 0, "e1", "u1"), ("a", 1, "e2", ""), ("a", 2, "e3", "bad"), ("a", 3, "nope", "x"), ("a", 4, "e1", "other")], "answer_id string, pos int, evidence_id string, link string")
    served = spark.createDataFrame([("a", f"e{i}", f"u{i}") for i in range(1, 5)], "answer_id string, evidence_id string, source_url string")
    v = audit.validate_citations(cited, served)
    assert {r.evidence_id: r.state for r in v.collect()} == {"e1": "valid", "e2": "repaired", "e3": "repaired", "nope": "rejected"}
    assert tuple(audit.validation_counts(v).first()) == ("a", 1, 1, 2, 1)


def test_events(spark):
    rows = [("ok", i + 1, n) for i, n in enumerate(audit.EVENT_ORDER)] + [("err", 1, "query_received"), ("err", 2, "error"), ("bad", 1, "query_analyzed"), ("two", 1, "error"), ("two", 2, "error"), ("open", 1, "query_received")]
    df = spark.createDataFrame(rows, "request_id string, sequence int, name string")
    assert {r.request_id: r.ok for r in audit.event_order(df).collect()} == {"ok": True, "err": True, "bad": False, "two": False, "open": False}


def test_gate_and_tripwire(spark):
    def result(i, bad):
        return ("run", f"q{i}", *[0.0 if bad else 1.0] * 6, int(bad), int(bad), 9000 if bad else 10, bad, bad, ["a", "b"], "cross_product", False)

    types = "run_id string, question_id string, recall_at_5 double, precision_at_5 double, mrr double, citation_validity double, claim_coverage double, faithfulness double, fabricated_fact_count int, invalid_citation_count int, latency_ms int, refused boolean, error boolean, searched_products array<string>, category string, is_unsupported boolean"
    good = evaluate.run_metrics(spark.createDataFrame([result(i, False) for i in range(4)], types), ["run_id"])
    worse = evaluate.run_metrics(spark.createDataFrame([result(i, i == 0) for i in range(4)], types), ["run_id"])
    assert evaluate.gate_outcome(good, "run_id").first().outcome == "pass"
    failed = {r.gate for r in evaluate.gate(worse, ["run_id"]).collect()}
    assert {"fabricated_fact_count", "invalid_citation_count", "p95_latency_ms", "citation_validity"} <= failed
    gold = spark.createDataFrame([("q1", False), ("q2", True), ("q3", False)], "question_id string, is_unsupported boolean")
    ranked = spark.createDataFrame([("q1", 1, False), ("q1", 2, True), ("q2", 1, True)], "question_id string, place int, good boolean")
    g = {r.question_id: tuple(r)[1:] for r in evaluate.retrieval_grades(gold, ranked, F.col("good")).collect()}
    assert g == {"q1": (1.0, 0.5, 0.5), "q2": (None, None, None), "q3": (0.0, 0.0, 0.0)}
    paths = [(["A", "C"], ["a", "B!", "c"], True), (["C", "A"], ["A", "C"], False), ([], ["A"], False)]
    assert column(spark, paths, "e array<string>, a array<string>, w boolean", T.heading_covers("e", "a") == F.col("w")) == [True] * 3


def test_scrubbing(spark):
    rows = [("x postgres://u:pw@h/db Bearer abcdefghijklmnopqrstu api_key='abcdefghijklmn' ok",)]
    assert column(spark, rows, "t string", T.redact("t")) == ["x [REDACTED]h/db [REDACTED] [REDACTED]' ok"]
    assert column(spark, [("a​b<Script> < c",)], "t string", T.scrub("t")) == ["ab&lt;Script> < c"]
    assert column(spark, [('{"a":{"Reasoning":1},"b":[{"my_thoughts":2}]}',)], "t string", T.reasoning_keys("t")) == [["$.a.Reasoning", "$.b[0].my_thoughts"]]
    assert column(spark, [("So my reasoning is this",)], "t string", T.deliberation_marker("t")) == ["my reasoning is"]
    assert column(spark, [("fn main",)], "t string", T.token_estimate("t", F.lit("code"))) == [7]


def test_datasets(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"manifest_version":"1","sources":[{"name":"a","start_url":"https://x/","allowed_domains":["x"],"max_pages":5,"max_depth":1,"delay_seconds":1,"enabled":true},{"name":"","start_url":"http://y","allowed_domains":[],"max_pages":0,"max_depth":1,"delay_seconds":0}]}')
    rows = datasets.read_manifest(spark, str(tmp_path / "m.json"))
    assert {(r.pos, r.field) for r in datasets.manifest_violations(rows).collect()} == {(1, f) for f in ("name", "start_url", "allowed_domains", "max_pages")}
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x int, y string")
    mark = lambda d: datasets.dataset_fingerprint(d).first()[0]
    assert mark(df) == mark(df.select("y", "x").repartition(3)) != mark(df.distinct())


def test_streams(spark, tmp_path):
    from loam.streaming.runs import run_available

    at = dt.datetime(2026, 1, 1)
    rows = [("r1", i + 1, n, at) for i, n in enumerate(audit.EVENT_ORDER)] + [("r2", 1, "query_received", at), ("r2", 2, "error", at), ("r3", 2, "error", at), ("r3", 1, "query_analyzed", at)]
    spark.createDataFrame(rows, "request_id string, sequence int, name string, ts timestamp").repartition(1).write.parquet(f"{tmp_path}/e")
    schema = spark.read.parquet(f"{tmp_path}/e").schema
    out = run_available(jobs.event_order_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/e")), "order")
    assert {r.request_id: (r.ok, r.ended) for r in out.collect()} == {"r1": (True, True), "r2": (True, True), "r3": (False, True)}


def test_first_seen_by_state(spark, tmp_path):
    from loam.streaming.runs import rocksdb, run_available

    at = lambda hours: dt.datetime(2026, 1, 1) + dt.timedelta(hours=hours)
    schema = "url string, ts timestamp"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).repartition(1).write.mode("append").parquet(f"{tmp_path}/u")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/u")
        with rocksdb(spark):
            return {r.url: r.ts for r in run_available(jobs.first_seen_urls(stream, "2 days", "1 day"), "first-seen-test", ["url"]).collect()}

    assert arrive(("a", at(3)), ("a", at(2)), ("b", at(5)), (None, at(0)), ("c", None)) == {"a": at(2), "b": at(5)}
    # an earlier time counts, a later one does not
    assert arrive(("a", at(1)), ("b", at(9)), ("d", at(1))) == {"a": at(1), "b": at(5), "d": at(1)}
    # long after, the url is new again
    arrive(("z", at(24 * 30)))
    assert arrive(("b", at(24 * 30)))["b"] == at(24 * 30)


def test_requests_that_never_end(spark, tmp_path):
    from loam.streaming.runs import rocksdb, run_closed

    at = dt.datetime(2026, 1, 1)
    names = audit.EVENT_ORDER
    rows = [("done", i + 1, n, at) for i, n in enumerate(names)] + [("open", 1, names[0], at), ("open", 2, names[1], at + dt.timedelta(minutes=2))]
    rows += [("failed", 1, "error", at), ("bad", 1, names[3], at)]
    schema = "request_id string, sequence int, name string, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema(schema).parquet(f"{tmp_path}/e")
    with rocksdb(spark):
        out = run_closed(events, "closed-test", lambda e: jobs.event_order_stream(e, "5 minutes"))
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("bad", False, False), ("done", True, True), ("failed", True, True), ("open", False, False)]


def test_partitions_are_dropped(spark, tmp_path):
    import os

    path = f"{tmp_path}/t"
    rows = spark.range(300).selectExpr("id", "concat('n ', id % 3) AS namespace")
    tables.write_partitioned(rows, path, "namespace")
    kept = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith("parquet") and not d.endswith("1")}
    assert tables.partition_values(spark, path, "namespace") == ["n 0", "n 1", "n 2"]
    assert tables.drop_namespace(spark, path, "n 1") and not tables.drop_namespace(spark, path, "n 1")
    left = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith("parquet")}
    assert left == kept
    read = spark.read.parquet(path)
    assert read.count() == 200 and "PartitionFilters: [isnotnull" in read.where("namespace = 'n 2'")._jdf.queryExecution().toString()


def test_addresses_however_they_are_written(spark):
    import ipaddress

    hosts = ["::1", "0::1", "0:0:0:0:0:0:0:1", "::", "0::0", "::ffff:10.0.0.1", "::ffff:a00:1", "0:0:0:0:0:ffff:7f00:1", "::ffff:8.8.8.8", "fe80::1", "FEBF::9", "ff02::1"]
    hosts += ["fd00:ec2::254", "fd00:0ec2:0::254", "fc00::", "2001:db8::5", "2001:0db8:0:0:0:0:0:5", "2001:4860:4860::8888", "10.0.0.1", "8.8.8.8", "example.com", "a:b", ":::", "1::2::3", "12345::", ":1::2", "1::2:", "1:::2"]
    hosts += ["::ffff:169.254.169.254", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8"]
    got = column(spark, [(h,) for h in hosts], "h string", F.struct(U.ipv6_groups(F.col("h")), U.ip_class("h")))
    for h, (groups, kind) in zip(hosts, got):
        try:
            a = ipaddress.ip_address(h.lower())
        except ValueError:
            assert (groups, kind) == (None, None), h
            continue
        assert groups == (":".join(a.packed.hex()[i : i + 4] for i in range(0, 32, 4)) if a.version == 6 else None), h
        inner = a.ipv4_mapped or a if a.version == 6 else a
        refused = not inner.is_global or inner.is_multicast
        assert (kind is not None) == refused, (h, kind)
    kinds = dict(zip(hosts, (k for _, k in got)))
    assert kinds["::ffff:169.254.169.254"] == kinds["fd00:0ec2:0::254"] == "cloud_metadata" and kinds["::ffff:a00:1"] == "private_range" and kinds["0::1"] == "loopback"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><div><nav><a>Home</a></div><h1>T</h1><p>x</p>", [("heading", 1, "T"), ("p", 0, "x")]),
        ("<body><form><main><h1>T</h1><p>x</p></main><p>mail?</p></form>", [("heading", 1, "T"), ("p", 0, "x")]),
        ("<body><header>Site</header><article><header><h1>T</h1></header><p>x</p></article>", [("heading", 1, "T"), ("p", 0, "x")]),
        ("<body><p>x</p><!-- never closed <p>y</p>", [("p", 0, "x")]),
        ("<body><aside><article><p>teaser</p></article></aside><p>x</p>", [("p", 0, "x")]),
        # headings that the walk skips: the plain walk takes them
        ("<body><form><h2>A</h2><p>x</p><ul><li>1<li>2</ul></form><footer><h2>F</h2></footer>", [("heading", 2, "A"), ("p", 0, "x"), ("list", 0, "1\n2")]),
        ("<body><nav><h2>Menu</h2></nav><p>x</p>", [("p", 0, "x")]),
        ("", []),
        (None, []),
    ],
)
def test_page_blocks(page, want):
    assert pages.page_blocks(page) == want


def test_blocks_in_sql(spark):
    name = pages.register_blocks(spark)
    spark.createDataFrame([(1, "<h1>T</h1><p>a</p>"), (2, None)], "id int, html string").createOrReplaceTempView("some_pages")
    got = spark.sql(f"SELECT id, b.* FROM some_pages, LATERAL {name}(html) b ORDER BY id, pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "heading", 1, "T"), (1, 1, "p", 0, "a")]


def test_scorer_of_batches(spark):
    class Counting:
        """A scorer that has to be set up, and gives longer texts more."""

        def setup(self):
            self.most = 100

        def score(self, questions, texts):
            assert len(questions) == len(texts) <= 2
            return [len(t) / self.most for t in texts]

    texts = ["a" * n for n in (5, 50, 20, 0, 300)] + [None]
    pool = spark.createDataFrame([("q", i + 1, t, "why?", 0.5) for i, t in enumerate(texts)], "question_id string, pool_rank int, text string, question string, score double")
    got = retrieval.rerank(pool.withColumn("s", retrieval.scored_by(Counting(), "question", "text", batch=2)), score=F.col("s")).collect()
    assert [(r.pool_rank, r.rerank_score) for r in sorted(got, key=lambda r: r.rerank_rank)] == [(5, 1.0), (2, 0.5), (3, 0.2), (1, 0.05)]
    words = spark.createDataFrame([("q", 1, "The red cat", "red cats, red dog", 0.1)], pool.schema)
    assert retrieval.rerank(words, scorer=retrieval.LexicalScorer()).first().rerank_score == pytest.approx(1 / 3)


def test_stored_results_meet_their_questions_without_a_shuffle(spark, tmp_path):
    results = spark.createDataFrame([("r", i % 40, float(i)) for i in range(200)], "run_id string, question_id int, mrr double")
    gold = spark.createDataFrame([(i, f"q{i}") for i in range(30)], "question_id int, question string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a = datasets.save_bucketed(results, "some_results", "question_id", f"{tmp_path}/results", 8)
        b = datasets.save_bucketed(gold, "some_gold", "question_id", f"{tmp_path}/gold", 8)
        out = evaluate.results_with_gold(a, b)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 200 and all((r.question is None) == (r.question_id >= 30) for r in rows)


def test_index(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 16)) * 4
    x = centre[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, None), (5001, [])]
    units = spark.createDataFrame(rows, "unit_id long, embedding array<double>")
    made = index.build_index(units, f"{tmp_path}/index", cells=24, sample=500)
    assert made.size.sum() == 3000
    asked = units.where("unit_id % 30 = 0").withColumnRenamed("unit_id", "query_id")
    best = {i: sorted(range(3000), key=lambda j: (-(x[i] @ x[j]), j))[:5] for i in range(0, 3000, 30)}

    def found(**how):
        got = {}
        for r in index.search(made, asked, 5, **how).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.unit_id)
        return got

    assert found(exact=True, probes=2) == best
    some = found(probes=4)
    recall = sum(len(set(some[i]) & set(best[i])) for i in best) / (5 * len(best))
    assert recall >= 0.95
    alone = found(exact=True, not_self=True)
    assert all(i not in v and len(v) == 5 for i, v in alone.items())
    plan = index.cells_read(made, spark, [1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    nothing = index.build_index(units.limit(0), f"{tmp_path}/none")
    assert index.search(nothing, asked, 5).count() == 0 and index.search(made, asked.limit(0), 5).count() == 0


def test_crawl(spark):
    links = [("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("d", "a", 0), ("d", "e", 1), ("e", "f", 0), ("a", "mailto:x", 2), ("a", "https://other.example.com/x", 3), ("b", "d", 1)]
    url = lambda p: p if ":" in p else f"https://h.example.com/d/{p}"
    table = spark.createDataFrame([(url(a), url(b), i) for a, b, i in links], "url string, href string, pos int")
    starts = spark.createDataFrame([(url("a"),), (url("e"),)], "start_url string")
    visited, refused = frontier.crawl(starts, table, depth=3)
    got = {(r.start_url[-1], r.url[-1]): (r.depth, r.parent and r.parent[-1]) for r in visited.collect()}
    assert got == {("a", "a"): (0, None), ("a", "b"): (1, "a"), ("a", "c"): (1, "a"), ("a", "d"): (2, "b"), ("a", "e"): (3, "d"), ("e", "e"): (0, None), ("e", "f"): (1, "e")}
    counts = {(r.start_url[-1], r.verdict, r.depth): r["count"] for r in refused.groupBy("start_url", "verdict", "depth").count().collect()}
    assert counts == {("a", "malformed", 1): 1, ("a", "out_of_scope", 1): 1, ("a", "duplicate", 2): 2, ("a", "duplicate", 3): 1}
    assert frontier.crawl(starts.limit(0), table)[0].count() == 0


def test_ingest_batch(spark):
    body = "<html><body><h1>T</h1>" + "".join(f"<p>Paragraph {i} tells of thing number {i * 7}, and then of {i * 11} others, at length.</p>" for i in range(12)) + "</body></html>"
    batch = spark.createDataFrame([(1, "u1", body), (2, "u2", "<p>tiny"), (3, "u3", body.replace("thing", "stone"))], "page_id long, url string, html string")
    docs = spark.createDataFrame([], "source_id string, url string, fingerprint string")
    stored = spark.createDataFrame([], "document_id string, ordinal int, vector_id string, text_fingerprint string")
    out = jobs.ingest_batch(batch, docs, stored)
    assert {r.page_id: r.reason for r in out["rejects"].collect()} == {2: "too_small"}
    assert {r.action for r in out["plan"].collect()} == {"write"}
    known = out["changes"].select("source_id", "url", "fingerprint")
    again = jobs.ingest_batch(batch, known, stored)
    assert {r.change for r in again["changes"].collect()} == {"unchanged"} and again["units"].count() == 0


def brute_paths(flat):
    """Heading paths by a stack, and the blocks that they stand over."""
    out, stack = [], []
    for pos, kind, level, text in flat:
        if kind != "heading":
            path = []
            for _, t in stack:
                if not path or path[-1] != t:
                    path.append(t)
            out.append((pos, kind, text, path))
        elif " ".join(text.split()):
            level = max(1, min(6, level))
            stack = [h for h in stack if h[0] < level] + [(level, " ".join(text.split()))]
    return out


def brute_units(rows, settings):
    """Units of one page's blocks (pos, kind, text, path) by the rules, block after block."""
    divisor = lambda kind: T.CHARS_PER_TOKEN.get(kind, T.DEFAULT_CHARS_PER_TOKEN)
    size = lambda text, kind: int(len(" ".join(text.split())) / divisor(kind))

    def fits(bs):
        chars = sum(len(" ".join(t.split())) for _, t in bs) + len(bs) - 1
        sent = sum(len(t.strip().encode()) for _, t in bs) + 2 * (len(bs) - 1)
        return int(chars / divisor(bs[0][0])) <= settings.chunk_max_tokens and sent <= settings.send_ceiling

    def tail(bs):
        kept, spent = [], 0
        for kind, t in reversed(bs):
            if kept and spent + size(t, kind) > settings.chunk_overlap_tokens:
                break
            kept, spent = [(kind, t)] + kept, spent + size(t, kind)
        return kept

    def furniture(text):
        lines = [x for x in text.replace("\r", "\n").split("\n") if x.strip()]
        words = len(text.split())
        few = words < settings.navigation_min_words or words / len(lines) < settings.navigation_words_per_line
        return not any(x.rstrip()[-1] in ".!?:;" for x in lines) and few

    sections, rejected, last = [], [], None
    for _, kind, text, path in rows:
        if not text.strip():
            continue
        if furniture(text):
            rejected.append((text, "navigation_boilerplate"))
        elif last is not None and path == last:
            sections[-1][1].append((kind, text.strip()))
        else:
            sections.append((path, [(kind, text.strip())]))
            last = path
    units = []
    for path, bs in sections:
        done, now = [], []
        for b in bs if not fits(bs) else []:
            if not fits([b]):
                done += ([now] if now else []) + [[b]]
                now = []
            elif now and not fits(now + [b]):
                done.append(now)
                carried = tail(now) + [b]
                now = carried if fits(carried) else [b]
            else:
                now = now + [b]
        for bs_ in [bs] if fits(bs) else done + ([now] if now else []):
            text = "\n\n".join(t for _, t in bs_)
            if size(text, bs_[0][0]) < settings.chunk_floor_tokens and fits(bs_):
                rejected.append((text, "below_usefulness_floor"))
            else:
                units.append((path, bs_, text, not fits(bs_)))
    out = []
    for i, (path, bs_, text, big) in enumerate(units):
        near = lambda j: 0 <= j < len(units) and units[j][0] == path and bool({t for _, t in units[j][1]} & {t for _, t in bs_})
        again = {t for _, t in units[i - 1][1]} if i else set()
        overlap = sum(size(t, k) for k, t in bs_ if t in again)
        out.append((i, path, text, sorted({k for k, _ in bs_}), size(text, bs_[0][0]), big, near(i - 1), near(i + 1), overlap))
    return out, sorted(rejected)


def test_units_against_brute_force(spark):
    import random

    rng, pages_ = random.Random(4), {}
    say = lambda k: " ".join(rng.choice("so the small river ran on, past houses. And then; slowly".split()) for _ in range(k))
    for page in range(30):
        flat = []
        for pos in range(rng.randrange(1, 60)):
            if rng.random() < 0.25:
                flat.append((pos, "heading", rng.randrange(1, 8), rng.choice(["A", "B  b", "C", " ", "D"])))
            else:
                kind = rng.choice(["p", "p", "list", "code", "quote", "table"])
                flat.append((pos, kind, 0, rng.choice([say(3), say(30), say(200), say(900) if rng.random() < 0.3 else say(5), "Home", "", "é " * 400 + "."])))
        pages_[page] = flat
    rows = [(p, *b) for p, flat in pages_.items() for b in flat]
    df = spark.createDataFrame(rows, "page_id long, pos int, block_type string, level int, text string").repartition(3)
    paths = blocks.heading_paths(df)
    got = {(r.page_id, r.pos): r.heading_path for r in paths.collect()}
    want = {(p, b[0]): b[3] for p, flat in pages_.items() for b in brute_paths(flat)}
    assert got == want and len({tuple(x) for x in want.values()}) > 10
    for settings in (Settings(), Settings(chunk_max_tokens=300, chunk_min_tokens=200, chunk_overlap_tokens=120, chunk_floor_tokens=20)):
        kept, rejects = blocks.units(paths, "page_id", settings)
        kept, rejects = kept.collect(), rejects.collect()
        for p, flat in pages_.items():
            units, rejected = brute_units(brute_paths(flat), settings)
            mine = sorted((u for u in kept if u.page_id == p), key=lambda u: u.ordinal)
            assert [
                (u.ordinal, u.heading_path, u.text, u.block_types, u.tokens, u.oversized, u.continued_from_previous, u.continues_into_next, u.overlap_tokens)
                for u in mine
            ] == units, p
            assert sorted((r.text, r.reason) for r in rejects if r.page_id == p) == rejected
    assert any(u.oversized for u in kept) and any(u.overlap_tokens for u in kept)


def test_gate_judges_rows(spark):
    rows = [(1, "w " * 300), (1, " ".join(f"x{i}" for i in range(900))), (None, "z " * 300), (2, None), (2, "one two three")]
    got = pages.page_gate(spark.createDataFrame(rows, "id long, text string")).collect()
    assert [r.reject_reason for r in got] == ["boilerplate_heavy", None, "boilerplate_heavy", "no_content", "too_small"]


def test_nearest_ranks(spark):
    import math
    import random

    rng = random.Random(1)
    values = {None: [3.0], "one": [5.0] * 7, "skewed": [rng.random() ** 30 for _ in range(2000)] + [1e6], "few": [1.0, 2.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    want = {k: tuple(sorted(vs)[max(1, math.ceil(p * len(vs))) - 1] for p in shares.values()) for k, vs in values.items()}
    for few in (1_000_000, 1024, 3):
        got = {r.k: tuple(r)[1:] for r in evaluate.nearest_ranks(df, ["k"], "v", shares, few, 8).collect()}
        assert got == want
    assert evaluate.nearest_ranks(df.where("k = 'few'").drop("k"), [], "v", {"p50": 0.5}).collect()[0].p50 == 1.0


def test_nearest_ranks_of_uneven_values(monkeypatch, spark):
    """With an outlier and infinite values, what lies between two cut points is a twentieth of the rows at most."""
    rng = __import__("random").Random(2)
    values = [rng.random() for _ in range(4000)] + [1e12, float("inf"), float("-inf")] + [0.5] * 900
    sizes = []

    def spy(df, name):
        out = written(df, name)
        if name == "hit":
            sizes.extend(r[0] for r in out.where("NOT _exact").select("_n").collect())
        return out

    written = evaluate.written
    monkeypatch.setattr(evaluate, "written", spy)
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    shares = {f"p{i}": i / 20 for i in range(21)}
    got = tuple(evaluate.nearest_ranks(df, ["k"], "v", shares, few=400).first())[1:]
    ordered = sorted(values)
    assert got == tuple(ordered[max(1, -(-len(ordered) * i // 20)) - 1] for i in range(21))
    assert sizes and max(sizes) <= len(values) / 20


def test_near_duplicate_classes(spark):
    base = "the quick brown fox jumps over the lazy dog near the river"
    rows = [(1, "a", base), (2, "a", base), (3, "a", base + " bank"), (4, "b", base), (5, "a", "nothing of that kind at all"), (6, "a", None), (7, "a", ""), (8, "a", ""), (9, None, base), (None, "a", base)]
    got = retrieval.near_duplicate_classes(spark.createDataFrame(rows, "k long, g string, text string"), "g", "k").collect()
    assert {r.k: r.class_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 7: 7, 8: 7}
    assert retrieval.near_duplicate_pairs(spark.createDataFrame(rows, "k long, g string, text string"), "g", "k").count() == 1


def test_counts_and_ties(spark):
    cur = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "b"), (2, "b"), (None, "n"), (3, None)], "k int, v string")
    for rows in (new, new.repartition(3)):
        assert sorted(map(str, registry.upsert(cur, rows, "k").collect())) == sorted(map(str, registry.upsert(registry.upsert(cur, rows, "k"), rows.where("k IS NOT NULL"), "k").collect()))
        assert {r.k: r.v for r in registry.register_new(cur, rows.where("k = 2"), ["k"]).collect()} == {2: "b"}
    assert tuple(registry.upsert_counts(new, "k").first()) == (5, 3)
    assert registry.delete_count(cur, new.union(cur), "k").first().deleted == 1
    sources = spark.createDataFrame([(1, True, "active"), (2, True, "disabled"), (3, True, "error"), (4, True, "active")], "source_id int, enabled boolean, status string")
    done = [(1, 1, "failed", 5, 2), (1, 2, "completed", 5, 1), (2, 3, "completed", 1, 1), (3, 4, "completed_with_errors", 2, 1), (3, 5, "running", None, None)]
    jobs_ = spark.createDataFrame(done, "source_id int, job_id int, status string, indexed int, finished_at int")
    got = {r.source_id: (r.status, r.last_crawl_at) for r in registry.after_crawl(sources, jobs_).collect()}
    assert got == {1: ("error", 2), 2: ("disabled", 1), 3: ("active", 1), 4: ("active", None)}
    assert column(spark, [(True, "odd"), (False, "active"), (True, "error")], "e boolean, s string", registry.source_status(F.col("e"), F.col("s"))) == ["error", "disabled", "error"]


def test_unknown_fields(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"manifest_version":"1","extra":1,"sources":[{"name":"a"},{"name":"b","colour":"red","notes":"x"}]}')
    assert {tuple(r) for r in datasets.unknown_fields(spark, str(tmp_path / "m.json")).collect()} == {(-1, "extra"), (1, "colour")}


def test_redacts_nested_values(spark):
    key = "sk-" + "a" * 24
    df = spark.createDataFrame([({key: [key]}, [[[[[key]]]]], (key, 1)), (None, None, None)], "m map<string,array<string>>, d array<array<array<array<array<string>>>>>, s struct<t:string,n:int>")
    whole = F.struct("*").alias("v")
    rows = df.select(whole)
    got = rows.select(T.redact_value("v", rows.schema["v"].dataType, 5).alias("v")).collect()
    assert got[0].v.asDict(True) == {"m": {"[REDACTED]": ["[REDACTED]"]}, "d": [[[[[key]]]]], "s": {"t": "[REDACTED]", "n": 1}}
    assert got[1].v.asDict(True) == {"m": None, "d": None, "s": None}


def test_ingest_stream_in_versions(spark, tmp_path):
    body = lambda word: "<html><body><h1>T</h1>" + "".join(f"<p>Paragraph {i} tells of {word} number {i * 7}, and then of {i * 11} others, at length.</p>" for i in range(12)) + "</body></html>"
    types = "page_id long, url string, html string"
    root, pages_ = f"{tmp_path}/registry", f"{tmp_path}/pages"

    def arrive(*rows):
        spark.createDataFrame(list(rows), types).write.mode("append").parquet(pages_)
        jobs.ingest_pages(spark.readStream.schema(types).parquet(pages_), root, f"{tmp_path}/state")
        return jobs.latest_version(spark, root)

    assert arrive((1, "u1", body("thing")), (2, "u2", "<p>tiny"), (3, "u3", body("stone")), (9, None, "x")) == 1
    assert arrive((1, "u1", body("thing")), (3, "u3", body("stones"))) == 2
    change = {r.document_id: r.change for r in spark.read.parquet(f"{root}/changes/version=2").collect()}
    assert change == {"1": "unchanged", "3": "supersede"}
    units = jobs.read_snapshot(spark, root, "units", 2).collect()
    assert {u.document_id for u in units} == {"1", "3"} and all("stones" in u.text for u in units if u.document_id == "3")
    spark.createDataFrame([], types).write.parquet(f"{root}/documents/version=3/half")  # a version without its manifest
    assert jobs.latest_version(spark, root) == 2
    # a batch of one changed page has written one bucket of each table, and files that no kept version uses are gone
    for name in ("documents", "units"):
        assert len(glob.glob(f"{root}/{name}/version=2/bucket=*")) == 1
        live = tables.read_manifest(spark, root)[1][name]
        assert sorted(live.values()).count(2) == 1
    assert arrive((4, "u4", body("tree"))) == 3
    assert {r.url for r in jobs.read_snapshot(spark, root, "documents", 3).collect()} == {"u1", "u3", "u4"}
    assert arrive((3, "u3", body("stones again"))) == 4
    assert not glob.glob(f"{root}/_manifest/[12].json") and glob.glob(f"{root}/_manifest/3.json")
    assert {r.url for r in jobs.read_snapshot(spark, root, "documents", 3).collect()} == {"u1", "u3", "u4"}
    units = jobs.read_snapshot(spark, root, "units", 4)
    assert {u.document_id for u in units.collect()} == {"1", "3", "4"} and units.where("document_id = '3' AND NOT contains(text, 'stones again')").count() == 0


def test_grades_in_sql(spark):
    """Claims, coverage and faithfulness by the SQL functions are those of the expressions."""
    from loam.functions import sql

    sql.register(spark)
    answers = ["The token rotates every ninety days by default. [E1] Administrators can change the rotation period in settings! [1] [E2] Nothing else.", "", None, " Too short. ", "Rotation of tokens happens automatically\nwithout any downtime for users. [2]"]
    quotes = [["token rotates every ninety days", "period in settings for administrators"], [], None, ["x"], ["Tokens: rotation happens automatically, users see no downtime"]]
    topics = [["rotation period", "ninety days"], ["x"], None, ["token rotates"], ["downtime"]]
    rows = [(i, a, q, t) for i, (a, q, t) in enumerate(zip(answers, quotes, topics))]
    df = spark.createDataFrame(rows, "i int, a string, q array<string>, t array<string>")
    df.createOrReplaceTempView("some_answers")
    got = spark.sql("SELECT i, loam_claims(a) AS c, loam_claim_coverage(t, a) AS v, loam_faithfulness(a, q) AS f FROM some_answers ORDER BY i").collect()
    want = df.select("i", T.substantive_sentences("a"), T.claim_coverage("t", "a"), T.faithfulness("a", "q")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert got[0].f == 1.0 and len(got[0].c) == 2 and got[4].f == 1.0


def test_listing_by_seek(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(50)], "id int, at int")
    for ascending in (False, True):
        want = [(r.at, r.id) for r in registry.listing(rows, "at", "id", 0, 50, ascending)[0].collect()]
        got, after = [], None
        while page := [(r.at, r.id) for r in registry.listing(rows, "at", "id", 0, 8, ascending, after=after)[0].collect()]:
            got += page
            after = page[-1]
        assert got == want and len(got) == 50


def test_sql_functions(spark):
    from loam.functions import sql

    assert len(sql.register(spark)) == len(sql.register(spark)) == len(sql.FUNCTIONS)
    r = spark.sql("SELECT loam_tokens(' a  b ' || repeat('x', 20)), loam_citation_validity(1, 1, 0), loam_set_jaccard(array('a', 'b'), array('b', 'c')), loam_answer_relevance('the cat', 'a cat'), loam_fingerprint('a  b')").first()
    assert tuple(r)[:4] == (7, 0.5, 1 / 3, 1.0) and r[4] == spark.range(1).select(T.unit_fingerprint(F.lit("a b"))).first()[0]
