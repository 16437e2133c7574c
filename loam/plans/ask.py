"""Registered queries of the ask path: questions, hits, evidence, answers, citations, grades.

Questions, answers and model outputs are derived from rows of the driver's tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, evaluate, retrieval
from ..settings import DEFAULTS
from .base import SQL_CONTENT, big, query, r6, read

_TRIMMED = r"regexp_replace({}, '^[\s\v]+|[\s\v]+$', '', 'g')"
#: lines of an order, numbered without ties
_LINES = """lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n
  FROM lineitem)
"""


def _lines(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return read(spark, d, "lineitem").withColumn("n", F.row_number().over(w))


def _having(rows: DataFrame, **columns: str) -> DataFrame:
    """The rows' expressions under these names."""
    return rows.select(*[F.expr(e).alias(n) for n, e in columns.items()])


# -- questions -------------------------------------------------------------------------


@query("SELECT conv_id, turn, coalesce(length(text) BETWEEN 1 AND 2000, false) AS admitted FROM conversations WHERE role = 'user'")
def question_admission(spark, d):
    asked = read(spark, d, "conversations").where("role = 'user'").withColumnRenamed("text", "question")
    good, bad = retrieval.admit_questions(asked)
    return good.select("conv_id", "turn", F.lit(True).alias("admitted")).union(bad.select("conv_id", "turn", F.lit(False)))


_ASKED = """CASE conv_id % 6 WHEN 0 THEN concat(text, ' In Jira Service Management or Confluence?') WHEN 1 THEN concat('JSM, jira-like Service Desk: ', text)
  WHEN 2 THEN concat(text, ' via REST API of jira') WHEN 3 THEN concat('Confluence confluence JIRA software? ', text)
  WHEN 4 THEN concat('developer docs; api docs ', text) ELSE text END"""
_ALIASES = sorted(retrieval.ALIASES, key=len, reverse=True)


@query(
    f"""WITH q AS (SELECT conv_id, turn, regexp_extract_all(regexp_replace(' ' || lower({_ASKED}) || ' ', '([^\\w-])', '\\1\\1', 'g'),
      '[^\\w-]({'|'.join(a.replace(' ', '  ') for a in _ALIASES)})[^\\w-]', 1) AS a FROM conversations WHERE role = 'user'),
    p AS (SELECT conv_id, turn, list_transform(a, lambda x: MAP {{{', '.join(f"'{a}': '{p}'" for a, p in retrieval.ALIASES.items())}}}[replace(x, '  ', ' ')]) AS p FROM q),
    n AS (SELECT conv_id, turn, list_filter(p, lambda x, i: list_position(p, x) = i) AS p FROM p),
    e AS (SELECT conv_id, turn, p, list_filter(p, lambda x: x IN ('jira', 'confluence', 'jsm')) AS s FROM n),
    f AS (SELECT conv_id, turn, p, CASE WHEN len(s) > 0 THEN s ELSE p END AS s FROM e)
    SELECT conv_id, turn, len(s) >= 2 AS ambiguous, array_to_string(CASE WHEN len(s) >= 2 THEN s ELSE p END, ',') AS products,
      CASE WHEN len(s) >= 2 THEN 'This question mentions ' || array_to_string(s, ' and ') || ', so it was searched across both. The answer may come from only one of them.' END AS note
    FROM f"""
)
def products_in_questions(spark, d):
    asked = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.expr(_ASKED).alias("q"))
    rows = asked.select("conv_id", "turn", retrieval.ambiguity("q").alias("a"))
    return rows.select("conv_id", "turn", "a.ambiguous", F.array_join("a.products", ",").alias("products"), "a.note")


_RAW = """CASE WHEN doc_id % 17 = 0 THEN '{' ELSE concat('{"product":"', CASE doc_id % 5 WHEN 0 THEN ' Jira ' WHEN 1 THEN 'jsm' WHEN 2 THEN 'unknown' WHEN 3 THEN 'trello' ELSE 'CONFLUENCE' END,
  '","category":"', CASE doc_id % 3 WHEN 0 THEN 'REST-API' WHEN 1 THEN 'none' ELSE 'general' END, '","intent":"how_to","entities":[" ', source, ' ","","', lang,
  '"],"confidence":{"product":', CASE WHEN doc_id % 13 < 10 THEN concat('0.', CAST(doc_id % 13 AS STRING)) ELSE '1.7' END,
  ',"category":', CASE WHEN doc_id % 2 = 0 THEN '0.9' ELSE '-1' END, ',"intent":"0.6","entities":0.', CAST(doc_id % 7 AS STRING), '}}') END"""


@query(
    """WITH c AS (SELECT *, doc_id % 17 = 0 AS bad, CASE WHEN doc_id % 17 != 0 AND doc_id % 13 < 10 THEN (doc_id % 13) / 10 ELSE 0 END AS cp,
      doc_id % 17 != 0 AND doc_id % 2 = 0 AS sc, doc_id % 4 = 0 AS amb FROM documents),
    a AS (SELECT *, CASE WHEN cp >= 0.6 THEN CASE doc_id % 5 WHEN 0 THEN 'jira' WHEN 1 THEN 'jsm' WHEN 4 THEN 'confluence' END END AS p,
      CASE WHEN sc THEN CASE doc_id % 3 WHEN 0 THEN 'rest-api' WHEN 2 THEN 'general' END END AS k FROM c)
    SELECT doc_id, p AS detected_product, k AS detected_category, CASE WHEN NOT bad THEN 'how_to' END AS detected_intent,
      CASE WHEN NOT bad AND doc_id % 7 = 6 THEN source || ',' || lang ELSE '' END AS entities, CASE WHEN NOT amb THEN p END AS filter_product,
      CASE WHEN NOT amb THEN k END AS filter_category,
      CASE WHEN amb THEN 'ambiguous' WHEN p IS NOT NULL OR k IS NOT NULL THEN 'confident' ELSE 'low_confidence' END AS filter_reason FROM a"""
)
def analysis_plan(spark, d):
    rows = read(spark, d, "documents").select(
        "doc_id", F.expr(_RAW).alias("raw_json"), F.expr("IF(doc_id % 4 = 0, 'Jira and Confluence?', 'how?')").alias("question")
    )
    plan = retrieval.filter_plan(retrieval.normalise_analysis(rows))
    return plan.select(
        "doc_id", "detected_product", "detected_category", "detected_intent", F.array_join("entities", ",").alias("entities"),
        "filter_product", "filter_category", "filter_reason",
    )


_FIVE = """CASE doc_id % 5 WHEN 0 THEN concat('How to configure ', source, ' and what is ', lang, '?') WHEN 1 THEN concat(source, ' vs. ', lang, '?')
  WHEN 2 THEN concat('Compare jira and confluence for ', source, '?') WHEN 3 THEN concat('Tell me of ', source, ' and ', lang) ELSE concat('  Plain ', lang, '  ') END"""


@query(
    f"""WITH q AS (SELECT *, trim({_FIVE}) AS q FROM documents),
    r AS (SELECT doc_id, 0 AS rewrite, CASE doc_id % 5 WHEN 0 THEN 'How to configure ' || source || '?' WHEN 1 THEN source || '?' WHEN 2 THEN q || ' [scope: jira]' ELSE q END AS query,
        CASE WHEN doc_id % 5 = 2 THEN 'jira' END AS scope FROM q
      UNION ALL SELECT doc_id, 1, CASE doc_id % 5 WHEN 0 THEN 'what is ' || lang || '?' WHEN 1 THEN lang || '?' ELSE q || ' [scope: confluence]' END,
        CASE WHEN doc_id % 5 = 2 THEN 'confluence' END FROM q WHERE doc_id % 5 < 3)
    SELECT doc_id, rewrite::BIGINT AS rewrite, query, scope, CASE WHEN doc_id % 5 = 2 THEN scope ELSE 'jsm' END AS filter_product,
      CASE WHEN doc_id % 5 = 2 THEN 'jira,confluence' ELSE 'jsm' END AS searched FROM r"""
)
def question_rewrites(spark, d):
    raw = """concat('{"product":"jsm","entities":["', source, '","', lang, '"],"confidence":{"product":0.9,"entities":0.9}}')"""
    rows = _having(read(spark, d, "documents"), doc_id="doc_id", question=_FIVE, raw_json=raw)
    out = retrieval.scoped_filters(retrieval.rewrites(retrieval.filter_plan(retrieval.normalise_analysis(rows))))
    return out.select(
        "doc_id", big("rewrite").alias("rewrite"), "query", "scope", "filter_product", F.array_join("searched_products", ",").alias("searched")
    )


# -- hits ------------------------------------------------------------------------------


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, CASE WHEN label % 2 = 0 THEN label END AS f FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, f, u.vec_id AS unit_id, f IS NULL OR (u.label = f AND u.vec_id % 40 = 0) AS fits, list_inner_product(e, u.embedding::DOUBLE[]) AS score
      FROM q JOIN embeddings u ON u.vec_id != query_id),
    a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s WHERE fits),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s),
    w AS (SELECT query_id FROM q LEFT JOIN (SELECT query_id, count(*) AS n FROM a WHERE rank <= 5 GROUP BY 1) USING (query_id) WHERE f IS NOT NULL AND coalesce(n, 0) < 3)
    SELECT query_id, unit_id, rank, false AS widened FROM a WHERE rank <= 5 AND query_id NOT IN (SELECT * FROM w)
    UNION ALL SELECT query_id, unit_id, rank, true FROM b WHERE rank <= 5 AND query_id IN (SELECT * FROM w)"""
)
def widened_hits(spark, d):
    e = read(spark, d, "embeddings")
    wanted = F.when(F.col("label") % 2 == 0, F.col("label")).alias("filter_product")
    plans = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", wanted, F.lit(None).alias("filter_category"))
    tagged = F.when(F.col("vec_id") % 40 == 0, F.col("label")).alias("tag")
    units = e.select(F.col("vec_id").alias("unit_id"), "embedding", tagged)
    filtered, free = (retrieval.nearest_units(plans, units, 5, True, m) for m in (("filter_product", "tag"), None))
    return retrieval.widened(filtered, free, plans).select("query_id", "unit_id", big("rank").alias("rank"), "widened")


@query(
    """WITH h AS (SELECT user_id AS question_id, event_id % 40 AS unit_id, event_id % 3 AS rewrite, event_id % 17 AS rank FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY question_id, unit_id ORDER BY rewrite, rank) AS n FROM h),
    p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rewrite, rank, unit_id) AS pool_rank FROM f WHERE n = 1)
    SELECT question_id, unit_id, rewrite, rank, pool_rank FROM p WHERE pool_rank <= 12"""
)
def candidate_pool(spark, d):
    hits = _having(read(spark, d, "events"), question_id="user_id", unit_id="event_id % 40", rewrite="event_id % 3", rank="event_id % 17")
    return retrieval.candidate_pool(hits).withColumn("pool_rank", big("pool_rank"))


@query(
    """WITH d AS (SELECT c_custkey AS document_id, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'https://a.example/' || c_custkey END AS url,
      CASE WHEN c_custkey % 6 != 0 THEN 'https://c.example/' || c_custkey END AS canonical_url FROM customer)
    SELECT l_suppkey AS question_id, l_orderkey AS unit_id, o_custkey AS document_id, coalesce(nullif(url, ''), canonical_url) AS source_url, count(*) AS n
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN d ON document_id = o_custkey WHERE coalesce(nullif(url, ''), canonical_url) != '' GROUP BY ALL"""
)
def hydrated_hits(spark, d):
    hits = _having(read(spark, d, "lineitem"), question_id="l_suppkey", unit_id="l_orderkey")
    units = _having(read(spark, d, "orders"), unit_id="o_orderkey", document_id="o_custkey")
    docs = _having(
        read(spark, d, "customer"),
        document_id="c_custkey",
        url="CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('https://a.example/', c_custkey) END",
        canonical_url="CASE WHEN c_custkey % 6 != 0 THEN concat('https://c.example/', c_custkey) END",
    )
    # a task's sorts and counts hold some 500,000 hits at most, and the lines' number is in their files' footers
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), hits.count() // 500_000)
    return retrieval.hydrate(hits, units, docs, parts).groupBy("question_id", "unit_id", "document_id", "source_url").agg(F.count("*").alias("n"))


@query(
    """SELECT user_id AS question_id, event_type AS query, count(CASE WHEN event_id % 4 != 0 THEN event_id END) AS returned, coalesce(max(value), 0.0) AS top_score
    FROM events GROUP BY 1, 2"""
)
def executed_queries(spark, d):
    hits = _having(
        read(spark, d, "events"), question_id="user_id", query="event_type", unit_id="IF(event_id % 4 != 0, event_id, NULL)", score="value"
    )
    return retrieval.executed_queries(hits)


_SQL_RERANKED = f"""WITH {_LINES},
p AS (SELECT l_orderkey AS question_id, n AS pool_rank, l_partkey AS unit_id, l_suppkey, l_discount * 5 AS score FROM lines WHERE l_partkey % 5 != 0),
i AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pool_rank) - 1 AS idx FROM p),
s AS (SELECT l_orderkey AS question_id, n - 1 + CASE WHEN l_partkey % 7 = 0 THEN 90 ELSE 0 END AS idx, l_tax * 20 - 0.2 AS s FROM lines WHERE l_orderkey % 3 != 0),
j AS (SELECT i.*, s, bool_or(s IS NOT NULL) OVER (PARTITION BY question_id) AS scored FROM i LEFT JOIN s USING (question_id, idx)),
h AS (SELECT *, greatest(0.0, least(1.0, coalesce(s, score))) AS rerank_score FROM j WHERE s IS NOT NULL OR NOT scored),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN scored THEN rerank_score END DESC NULLS LAST, idx) AS rerank_rank FROM h),
r AS (SELECT * FROM k WHERE rerank_rank <= 6)
"""


def _reranked(spark, d) -> DataFrame:
    """Lines of orders as candidates; scores of some places are missing, some lie out of range."""
    lines = _lines(spark, d)
    pool = _having(
        lines, question_id="l_orderkey", pool_rank="n", unit_id="l_partkey", l_suppkey="l_suppkey", score="l_discount * 5",
        text="IF(l_partkey % 5 = 0, '  ', 'x')",
    )
    scores = _having(
        lines.where("l_orderkey % 3 != 0"), question_id="l_orderkey", index="n - 1 + IF(l_partkey % 7 = 0, 90, 0)", score="l_tax * 20 - 0.2"
    )
    return retrieval.rerank(pool, scores)


@query(_SQL_RERANKED + "SELECT question_id, unit_id, pool_rank, round(rerank_score, 6) AS rerank_score, rerank_rank FROM r")
def rerank_by_scores(spark, d):
    return _reranked(spark, d).select(
        "question_id", "unit_id", big("pool_rank").alias("pool_rank"), r6("rerank_score").alias("rerank_score"), big("rerank_rank").alias("rerank_rank")
    )


@query(
    _SQL_RERANKED
    + """, b AS (SELECT *, max(rerank_score) OVER (PARTITION BY question_id) AS best FROM r),
    l AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, rerank_rank) AS lead_rank FROM b
      WHERE rerank_score >= best * 0.25 AND l_suppkey % 4 != 0)
    SELECT question_id, unit_id, rerank_rank, lead_rank FROM l WHERE lead_rank <= 3"""
)
def refusal_leads(spark, d):
    url = F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("https://s.example/"), "l_suppkey")).otherwise("")
    leads = retrieval.refusal_leads(_reranked(spark, d).withColumn("source_url", url))
    return leads.select("question_id", "unit_id", big("rerank_rank").alias("rerank_rank"), big("lead_rank").alias("lead_rank"))


@query(
    _SQL_RERANKED
    + """, g AS (SELECT question_id, max(rerank_score) AS best, min(CASE WHEN pool_rank % 2 = 0 THEN rerank_score END) AS weak FROM r GROUP BY 1)
    SELECT question_id, best < 0.4 OR weak IS NULL OR weak < 0.3 AS refused,
      CASE WHEN best < 0.4 THEN 'BELOW_MIN_RERANK_SCORE' WHEN weak IS NULL OR weak < 0.3 THEN 'BELOW_MIN_EVIDENCE_SCORE' END AS gate_reason,
      round(best, 6) AS best_score, round(coalesce(weak, best), 6) AS weakest_selected FROM g"""
)
def evidence_gate(spark, d):
    rows = _reranked(spark, d)
    floors = replace(DEFAULTS, min_rerank_score=0.4, min_evidence_score=0.3)
    g = retrieval.evidence_gate(rows, rows.where("pool_rank % 2 = 0"), floors)
    return g.withColumn("best_score", r6("best_score")).withColumn("weakest_selected", r6("weakest_selected"))


_SQL_EVIDENCE = r"""WITH RECURSIVE t AS (SELECT conv_id AS q, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pool_rank
  FROM conversations WHERE length(text) > 0),
i AS (SELECT *, (length(text) % 10) / 10.0::DOUBLE AS s, row_number() OVER (PARTITION BY q ORDER BY pool_rank) AS idx FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, idx) AS r FROM i),
n AS (SELECT *, trim(regexp_replace(lower(text), '[^\pL\pN_]+', ' ', 'g')) AS norm FROM k WHERE r <= 6),
c AS (SELECT q, pool_rank AS unit, role AS doc, CASE WHEN length(norm) >= 3 THEN list_distinct(list_transform(range(1, length(norm) - 1), lambda j: substring(norm, j, 3))) ELSE [norm] END AS grams,
  row_number() OVER (PARTITION BY q ORDER BY 0.8 * s + 0.2 * CASE WHEN role = 'user' THEN 0.5 ELSE 0 END DESC, r, pool_rank) AS k FROM n),
f AS (SELECT DISTINCT q, 0::BIGINT AS k, []::STRUCT(u BIGINT, d VARCHAR, g VARCHAR[])[] AS taken FROM c
  UNION ALL SELECT f.q, c.k, CASE WHEN len(taken) < 6 AND len(list_filter(taken, lambda x: x.d = c.doc)) < 2
    AND len(list_filter(taken, lambda x: len(list_intersect(x.g, c.grams)) / (len(x.g) + len(c.grams) - len(list_intersect(x.g, c.grams))) > 0.6)) = 0
    THEN list_append(taken, {'u': c.unit, 'd': c.doc, 'g': c.grams}) ELSE taken END FROM f JOIN c ON c.q = f.q AND c.k = f.k + 1),
l AS (SELECT q, arg_max(taken, k) AS taken FROM f GROUP BY 1)
SELECT q AS conv_id, unnest(list_transform(taken, lambda x: x.u)) AS unit, unnest(range(1, len(taken) + 1)) AS evidence_rank FROM l
"""


@query(_SQL_EVIDENCE)
def evidence_selection(spark, d):
    """Turns of a conversation as candidates, those of one role as units of one document."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pool = read(spark, d, "conversations").where("length(text) > 0").withColumn("pool_rank", F.row_number().over(w))
    pool = pool.select(
        F.col("conv_id").alias("question_id"), "pool_rank", F.col("pool_rank").alias("unit_id"), F.col("role").alias("document_id"),
        F.lit(None).cast("string").alias("product"), F.array("role").alias("heading_path"), F.lit("about user?").alias("question"), "text", F.lit(0.0).alias("score"),
    )
    ranked = retrieval.rerank(pool, score=F.length("text") % 10 / 10)
    out = retrieval.select_evidence(ranked)
    return out.select(F.col("question_id").alias("conv_id"), big("unit_id").alias("unit"), big("evidence_rank").alias("evidence_rank"))


@query(
    r"""SELECT conv_id, sha256(string_agg('[E' || (turn + 1) || '] ' || role || ' > part' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS prompt
    FROM conversations GROUP BY 1"""
)
def evidence_prompts(spark, d):
    rows = read(spark, d, "conversations").select(
        F.col("conv_id").alias("question_id"), (F.col("turn") + 1).alias("evidence_rank"), F.array("role", F.lit("part")).alias("heading_path"), "text"
    )
    return retrieval.evidence_prompt(rows).select(F.col("question_id").alias("conv_id"), F.sha2("prompt", 256).alias("prompt"))


# -- answers and citations -------------------------------------------------------------

_ANSWERS = (
    ('{"answer":"a","answerable":true,"citations":[{"evidence_id":"e1"}]}', None),
    ("not json", "no_json_object"),
    ("[1]", "no_json_object"),
    ('{"answer":1,"answerable":true}', "malformed_answer"),
    ('{"answer":"a","answerable":"yes"}', "malformed_answer"),
    ('{"answer":"a","answerable":true,"citations":{}}', "malformed_citations"),
    ('{"answer":"a","answerable":true,"citations":[null]}', "non_object_citation"),
    ('{"answer":"a","answerable":true,"citations":[{"source_url":"u"}]}', "citation_without_id"),
    ('{"answer":"a","answerable":false}', None),
)


@query(
    "SELECT doc_id, CASE doc_id % 9 "
    + " ".join(f"WHEN {k} THEN {repr(r) if r else 'NULL'}" for k, (_, r) in enumerate(_ANSWERS))
    + " END AS malformed, CASE WHEN doc_id % 9 IN (0, 8) THEN 'a' END AS answer FROM documents"
)
def parsed_answers(spark, d):
    raw = F.element_at(F.array(*[F.lit(a) for a, _ in _ANSWERS]), (F.col("doc_id") % 9 + 1).cast("int"))
    return audit.parse_answers(read(spark, d, "documents").select("doc_id", raw.alias("raw_json"))).select("doc_id", "malformed", "parsed.answer")


_MARKED = """concat('See [E', doc_id % 5, '] and [E', doc_id % 3 + 1, '][E', doc_id % 7 + 1, ']  [E1].')"""
_SQL_LINK = "CASE WHEN {0} BETWEEN 1 AND m THEN '[' || list_position(cited, 'u' || {0}) || ']' ELSE '' END"


@query(
    f"""WITH n AS (SELECT doc_id, doc_id % 4 + 1 AS m, [doc_id % 5, doc_id % 3 + 1, doc_id % 7 + 1, 1] AS n FROM documents),
    k AS (SELECT *, list_transform(list_filter(n, lambda x: x BETWEEN 1 AND m), lambda x: 'u' || x) AS k FROM n),
    c AS (SELECT *, list_filter(k, lambda x, i: list_position(k, x) = i) AS cited FROM k)
    SELECT doc_id, array_to_string(cited, ',') AS cited, array_to_string(list_transform(list_filter(n, lambda x: NOT x BETWEEN 1 AND m), lambda x: 'E' || x), ',') AS rejected,
      trim(regexp_replace('See ' || {_SQL_LINK.format('n[1]')} || ' and ' || {_SQL_LINK.format('n[2]')} || {_SQL_LINK.format('n[3]')} || '  ' || {_SQL_LINK.format('1')} || '.', ' {{2,}}', ' ', 'g')) AS resolved,
      CASE WHEN len(cited) > 0 THEN 'per_claim' WHEN doc_id % 2 = 0 THEN 'list' ELSE 'none' END AS granularity FROM c"""
)
def marker_resolution(spark, d):
    served = F.slice(F.array(*[F.lit(f"u{k}") for k in range(1, 5)]), F.lit(1), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = read(spark, d, "documents").select("doc_id", F.expr(_MARKED).alias("answer"), served.alias("served"))
    out = audit.resolve_markers(rows)
    named = audit.all_cited("cited_ids", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("u9"))).otherwise(F.array().cast("array<string>")))
    return out.select(
        "doc_id", F.array_join("cited_ids", ",").alias("cited"), F.array_join("rejected_markers", ",").alias("rejected"),
        F.col("resolved_text").alias("resolved"), audit.granularity("cited_ids", named).alias("granularity"),
    )


_LINK = "CASE l_suppkey % 4 WHEN 1 THEN '' WHEN 2 THEN concat('https://x.example/', l_partkey % 6) WHEN 3 THEN 'https://other.example' END"
_SQL_CITED = f"""WITH {_LINES},
c AS (SELECT l_orderkey AS answer_id, n AS pos, 'e' || (l_partkey % 6) AS evidence_id, {_LINK} AS link FROM lines),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, evidence_id ORDER BY pos) AS first FROM c) WHERE first = 1),
s AS (SELECT o_orderkey AS answer_id, unnest(range(o_orderkey % 5 + 1)) AS k FROM orders),
v AS (SELECT f.answer_id, f.evidence_id, pos, CASE WHEN k IS NOT NULL THEN 'https://x.example/' || k END AS source_url,
  CASE WHEN k IS NULL THEN 'rejected' WHEN coalesce(link, '') = '' OR link != 'https://x.example/' || k THEN 'repaired' ELSE 'valid' END AS state,
  CASE WHEN k IS NULL THEN NULL WHEN coalesce(link, '') = '' THEN 'no link given' WHEN link != 'https://x.example/' || k THEN 'link replaced' END AS note
  FROM f LEFT JOIN s ON s.answer_id = f.answer_id AND 'e' || k = evidence_id)
"""


def _validated(spark, d) -> DataFrame:
    cited = _having(_lines(spark, d), answer_id="l_orderkey", pos="n", evidence_id="concat('e', l_partkey % 6)", link=_LINK)
    served = read(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.expr("explode(sequence(0, o_orderkey % 5))").alias("k"))
    served = _having(served, answer_id="answer_id", evidence_id="concat('e', k)", source_url="concat('https://x.example/', k)")
    return audit.validate_citations(cited, served)


@query(_SQL_CITED + "SELECT answer_id, evidence_id, pos, source_url, state, note FROM v")
def citation_states(spark, d):
    return _validated(spark, d).select("answer_id", "evidence_id", big("pos").alias("pos"), "source_url", "state", "note")


@query(
    _SQL_CITED
    + """, n AS (SELECT answer_id, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'repaired') AS repaired, count(*) FILTER (state = 'rejected') AS rejected FROM v GROUP BY 1)
    SELECT answer_id, valid, rejected AS stripped, repaired, rejected, CASE WHEN valid + rejected > 0 THEN round(valid / (valid + 2 * rejected), 6) END AS citation_validity,
      2 * rejected AS invalid_citation_count FROM n"""
)
def citation_counts(spark, d):
    counts = audit.validation_counts(_validated(spark, d))
    grades = evaluate.citation_grades(counts.withColumnRenamed("answer_id", "question_id")).withColumnRenamed("question_id", "answer_id")
    return counts.join(grades, "answer_id").select(
        *counts.columns, r6("citation_validity").alias("citation_validity"), big("invalid_citation_count").alias("invalid_citation_count")
    )


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey % 7 = 0 AS refused, CASE WHEN o_custkey % 4 != 3 THEN o_custkey % 4 END AS n_evidence,
      CASE WHEN o_custkey % 5 != 0 THEN o_custkey % 5 != 1 END AS answerable, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%' AS supported,
      o_custkey % 11 = 0 AS silent, o_custkey % 13 = 0 AS uncited FROM orders),
    r AS (SELECT o_orderkey, CASE WHEN refused OR coalesce(n_evidence, 0) = 0 OR NOT coalesce(answerable, false) THEN 'INSUFFICIENT_EVIDENCE'
      WHEN NOT supported THEN 'VERIFICATION_FAILED' WHEN silent THEN 'INSUFFICIENT_EVIDENCE' WHEN uncited THEN 'VERIFICATION_FAILED' END AS reason FROM o)
    SELECT o_orderkey, CASE WHEN reason IS NULL THEN 'answered' ELSE 'refused' END AS outcome, reason AS refusal_reason FROM r"""
)
def answer_outcomes(spark, d):
    rows = _having(
        read(spark, d, "orders"),
        o_orderkey="o_orderkey",
        refused="o_custkey % 7 = 0",
        n_evidence="IF(o_custkey % 4 != 3, o_custkey % 4, NULL)",
        answerable="IF(o_custkey % 5 != 0, o_custkey % 5 != 1, NULL)",
        verdict="CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%' THEN 'SUPPORTED' WHEN o_orderpriority LIKE '2%' THEN 'supported' WHEN o_orderpriority LIKE '4%' THEN 'PARTIAL' END",
        granularity="IF(o_custkey % 11 = 0, 'none', 'per_claim')",
        n_uncited="IF(o_custkey % 13 = 0, 2, 0)",
    )
    return audit.outcomes(rows).select("o_orderkey", "outcome", "refusal_reason")


_CITATIONS = {"answer_id": "l_orderkey", "rank": "n", "product": "nullif(l_returnflag, 'R')", "source_url": "concat('s', l_suppkey % 3)"}
_SQL_CITATIONS = f"WITH {_LINES}, c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _CITATIONS.items())} FROM lines)"


@query(_SQL_CITATIONS + "SELECT answer_id, coalesce(product, 'unclassified') AS product, string_agg(source_url, ',' ORDER BY rank) AS sources FROM c GROUP BY 1, 2")
def citation_groups(spark, d):
    groups = audit.citation_groups(_having(_lines(spark, d), **_CITATIONS))
    return groups.select("answer_id", "product", F.array_join("sources", ",").alias("sources"))


@query(
    _SQL_CITATIONS
    + """, s AS (SELECT answer_id, list_sort(list(DISTINCT source_url)) AS u, coalesce(list_sort(list(DISTINCT product) FILTER (product IS NOT NULL)), []) AS p FROM c GROUP BY 1)
    SELECT answer_id, array_to_string(u, ',') AS pages, array_to_string(p, ',') AS products,
      len(u) || ' page' || CASE WHEN len(u) = 1 THEN '' ELSE 's' END || ' from ' || len(p) || ' product' || CASE WHEN len(p) = 1 THEN '' ELSE 's' END AS summary FROM s"""
)
def source_summaries(spark, d):
    s = audit.source_summary(_having(_lines(spark, d), **_CITATIONS))
    return s.select("answer_id", F.array_join("pages", ",").alias("pages"), F.array_join("products", ",").alias("products"), "summary")


_STORED = {
    "log_id": "l_orderkey", "rank": "n - 1", "quote": "CASE WHEN l_partkey % 9 != 0 THEN l_returnflag ELSE '' END",
    "validation_state": "CASE l_suppkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'stripped' WHEN 2 THEN 'repaired' WHEN 3 THEN 'valid' END",
    "retrieval_score": "l_discount * 12", "rerank_score": "CASE WHEN l_linenumber % 2 = 0 THEN l_tax END",
}


@query(
    f"""WITH {_LINES}, c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _STORED.items())} FROM lines)
    SELECT log_id, rank, coalesce(rank > 0 AND validation_state IN ('valid', 'repaired', 'stripped') AND quote != '' AND coalesce(retrieval_score BETWEEN 0 AND 1, true)
      AND coalesce(rerank_score BETWEEN 0 AND 1, true), false) AS kept FROM c"""
)
def audit_append(spark, d):
    """Citations that the log takes, and those set aside."""
    citations = _having(_lines(spark, d), **_STORED)
    _, kept, aside = audit.audit_rows(citations.select("log_id"), citations)
    rows = kept.withColumn("kept", F.lit(True)).union(aside.withColumn("kept", F.lit(False)))
    return rows.select("log_id", big("rank").alias("rank"), "kept")


_SQL_HEAD = _TRIMMED.format("left(text, 200)")


@query(
    rf"""SELECT doc_id, {_SQL_HEAD} AS quote, CASE WHEN doc_id % 2 = 0 THEN 'E' || doc_id % 3 END AS code,
    CASE doc_id % 4 WHEN 0 THEN 'chain of thought' WHEN 1 THEN 'internal monologue' END AS deliberation,
    CASE doc_id % 3 WHEN 0 THEN '$.a.reasoning,$.a.steps[1].Thoughts' WHEN 1 THEN '' ELSE '$.reflection' END AS reasoning, 5::BIGINT AS n_segments,
    ['SUPPORTED', 'UNSUPPORTED', 'PARTIAL', 'UNSUPPORTED'][doc_id % 4 + 1] AS verdict FROM documents"""
)
def answer_details(spark, d):
    """Quotes, state codes, exposed deliberation, reasoning keys, segments and verdicts."""
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % n + 1).cast("int"))
    said = pick(4, "My CHAIN of thought, and internal monologue", "An Internal Monologue", "Nothing", "chains of thoughts")
    payload = pick(
        3,
        '{"a": {"reasoning": "x", "steps": [{"n": 1}, {"Thoughts": ["y"]}]}}',
        '{"a": "say \\"thought\\": no", "b": ["reasoning:", "{\\"reflection\\": 1}"]}',
        '{"reflection": {"why": [1, 2]}, "text": "a }"}',
    )
    answer = F.concat(F.lit("A [1] b[22] "), F.lit("c[3]"))
    detail = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("E"), F.col("doc_id") % 3).alias("code"))))
    return read(spark, d, "documents").select(
        "doc_id", T.evidence_quote("text").alias("quote"), T.state_code(detail).alias("code"), T.deliberation_marker(said).alias("deliberation"),
        F.array_join(T.reasoning_keys(payload), ",").alias("reasoning"), (big(F.size(T.answer_segments(answer))) - 1).alias("n_segments"),
        T.verdict(pick(4, "SUPPORTED", "UNSUPPORTED", "PARTIAL", "maybe")).alias("verdict"),
    )


# -- grades ----------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT user_id AS question_id, event_id AS id, CASE WHEN event_id % 5 != 0 THEN event_id % 9 END AS rank FROM events WHERE event_type != 'error'),
    o AS (SELECT user_id AS question_id, event_id AS id, CASE WHEN event_id % 7 != 0 THEN event_id % 5 END AS rank FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0),
    u AS (SELECT * FROM o UNION ALL SELECT * FROM r WHERE question_id NOT IN (SELECT question_id FROM o))
    SELECT question_id, id, rank, row_number() OVER (PARTITION BY question_id ORDER BY rank NULLS LAST, id) AS place FROM u"""
)
def ranked_for_grading(spark, d):
    e = read(spark, d, "events")
    retrieved = _having(e.where("event_type != 'error'"), question_id="user_id", id="event_id", rank="IF(event_id % 5 != 0, event_id % 9, NULL)")
    over = _having(
        e.where("event_type = 'purchase' AND user_id % 2 = 0"), question_id="user_id", id="event_id", rank="IF(event_id % 7 != 0, event_id % 5, NULL)"
    )
    return evaluate.ranked_candidates(retrieved, over).withColumn("place", big("place"))


_WANTED = "CASE doc_id % 4 WHEN 0 THEN array(source) WHEN 1 THEN array(upper(lang), 'PART - 3') WHEN 2 THEN array('part 1', source) ELSE array() END"


@query(
    """SELECT doc_id, (doc_id % 2 = 1 OR doc_id % 3 = 0) AND CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN doc_id % 5 = 3 WHEN 2 THEN false ELSE true END AS covers,
    CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN doc_id % 5 = 3 ELSE false END AS path_covered FROM documents"""
)
def heading_grades(spark, d):
    rows = _having(
        read(spark, d, "documents"),
        doc_id="doc_id",
        heading_path="array('Intro', concat(source, '!'), lang, concat('Part ', doc_id % 5))",
        product="IF(doc_id % 3 = 0, 'Jira!', 'jsm')",
        want_product="IF(doc_id % 2 = 0, 'jira', NULL)",
        want_heading_path=_WANTED,
    )
    return rows.select("doc_id", evaluate.topic_hit().alias("covers"), T.heading_covers("want_heading_path", "heading_path").alias("path_covered"))


@query(
    f"""WITH t AS (SELECT doc_id, {SQL_CONTENT.format("text")} AS a, [{SQL_CONTENT.format("lang || ' ' || source")}, {SQL_CONTENT.format("left(text, 12)")}, ['zebra'], []] AS topics FROM documents)
    SELECT doc_id, len(list_filter(topics, lambda x: len(x) > 0 AND list_has_all(a, x))) / 4.0::DOUBLE AS claim_coverage FROM t"""
)
def topic_coverage(spark, d):
    topics = F.array(F.concat_ws(" ", "lang", "source"), F.substring("text", 1, 12), F.lit("zebra"), F.lit("of the"))
    return read(spark, d, "documents").select("doc_id", T.claim_coverage(topics, "text").alias("claim_coverage"))
