"""The text and grading helpers as SQL functions, for those who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as T


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_STRIPPED = r"regexp_replace({}, r'(?U)^\s+|\s+$', '')"
_CLAIM_WORDS = f"filter(regexp_extract_all(lower({{}}), '[a-z0-9]+', 0), w -> w NOT IN ({_quoted(T.CLAIM_STOP_WORDS)}))"
_CONTENT = f"filter(split(lower({{}}), '[^a-z0-9]+'), x -> x != '' AND x NOT IN ({_quoted(T.CONTENT_STOP_WORDS)}))"
_LEAD = rf"r'^((?:{T.MARKER}(?U:\s*))+)'"
_REST = _STRIPPED.format(f"regexp_replace(part, {_LEAD}, '')")
_LEADING = f"regexp_extract_all(regexp_extract(part, {_LEAD}, 1), r'{T.MARKER}', 0)"
_MOVED = (
    f"CASE WHEN size({_LEADING}) > 0 AND size(done) > 0 THEN transform(done, (s, i) ->"
    f" CASE WHEN i = size(done) - 1 THEN concat(s, ' ', array_join({_LEADING}, ' ')) ELSE s END) ELSE done END"
)
_PARTS = "split(" + r"regexp_replace({}, r'(?U)([.!?])\s+', concat('$1', chr(1)))".format(_STRIPPED.format("answer")) + ", chr(1))"
_CLAIMS = (
    f"aggregate(filter(transform({_PARTS}, p -> {_STRIPPED.format('p')}), p -> p != ''), CAST(array() AS ARRAY<STRING>), (done, part) ->"
    f" CASE WHEN size({_CLAIM_WORDS.format(_REST)}) >= 4 THEN concat({_MOVED}, array({_REST})) ELSE {_MOVED} END)"
)
_GROUNDED = (
    f"size({_CONTENT.format('c')}) > 0 AND size(array_intersect({_CONTENT.format('c')}, seen)) / size(array_distinct({_CONTENT.format('c')})) >= 1 / 3D"
    f" AND size(filter(array_intersect({_CONTENT.format('c')}, seen), w -> length(w) >= 5)) >= 2"
)

#: name with parameters, result type and body; later ones may use earlier ones
FUNCTIONS = (
    ("loam_collapsed(t STRING)", "STRING", r"trim(regexp_replace(t, r'(?U)\s+', ' '))"),
    ("loam_fingerprint(t STRING)", "STRING", "sha2(loam_collapsed(t), 256)"),
    ("loam_tokens(t STRING)", "INT", f"CAST(floor(length(loam_collapsed(t)) / {T.DEFAULT_CHARS_PER_TOKEN}D) AS INT)"),
    ("loam_bytes(t STRING)", "INT", "octet_length(t)"),
    (
        "loam_content_tokens(t STRING)",
        "ARRAY<STRING>",
        f"filter(split(lower(t), '[^a-z0-9]+'), x -> x != '' AND x NOT IN ({_quoted(T.CONTENT_STOP_WORDS)}))",
    ),
    (
        "loam_answer_relevance(question STRING, answer STRING)",
        "DOUBLE",
        "CASE WHEN size(loam_content_tokens(question)) > 0 THEN size(array_intersect(loam_content_tokens(question), loam_content_tokens(answer)))"
        " / size(array_distinct(loam_content_tokens(question))) END",
    ),
    ("loam_claims(answer STRING)", "ARRAY<STRING>", _CLAIMS),
    (
        "loam_claim_coverage(topics ARRAY<STRING>, answer STRING)",
        "DOUBLE",
        f"CASE WHEN size(topics) > 0 THEN size(filter(topics, t -> size({_CONTENT.format('t')}) > 0 AND size(array_except({_CONTENT.format('t')}, {_CONTENT.format('answer')})) = 0)) / size(topics) END",
    ),
    (
        "loam_grounded(claims ARRAY<STRING>, seen ARRAY<STRING>)",
        "DOUBLE",
        f"CASE WHEN size(claims) > 0 THEN CASE WHEN coalesce(size(seen), 0) <= 0 THEN 0 ELSE size(filter(claims, c -> {_GROUNDED})) END / size(claims) END",
    ),
    (
        "loam_faithfulness(answer STRING, quotes ARRAY<STRING>)",
        "DOUBLE",
        f"loam_grounded(loam_claims(answer), array_distinct(flatten(transform(quotes, q -> {_CONTENT.format('q')}))))",
    ),
    (
        "loam_citation_validity(valid BIGINT, stripped BIGINT, rejected BIGINT)",
        "DOUBLE",
        "CASE WHEN valid + stripped + rejected > 0 THEN valid / (valid + stripped + rejected) END",
    ),
    (
        "loam_set_jaccard(a ARRAY<STRING>, b ARRAY<STRING>)",
        "DOUBLE",
        "size(array_intersect(a, b)) / size(array_union(a, b))",
    ),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session, replacing older ones; their names."""
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [s.split("(")[0] for s, *_ in FUNCTIONS]
