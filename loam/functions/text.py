"""Column expressions over text: hashes, sizes, tokens, sentences, scrubbing.

Everything here is a Catalyst expression, so that it runs inside the scan's stage.
White space means Python's, hence ``(?U)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..settings import DEFAULTS, Settings

# Word lists, markers and divisors that results depend on.
CONTENT_STOP_WORDS = "a an the is are and or of to in for so by on it be as".split()
CLAIM_STOP_WORDS = (
    "a an and are as at be but by for from has have in is it its of on or that the this to was were which will with"
).split()
LANGUAGE_STOP_WORDS = (
    "the a an and or of to in on for with is are was were by at from as it its this that be you your we our they their"
).split()
ERROR_MARKERS = (
    "page not found",
    "this page isn't available",
    "access denied",
    "forbidden",
    "we can't find",
    "404",
    "an error occurred",
    "temporarily unavailable",
)
CHARS_PER_TOKEN = {"code": 0.93, "list": 2.95, "p": 3.17, "quote": 3.17, "heading": 3.17, "table": 2.54}
DEFAULT_CHARS_PER_TOKEN = 3.17
MIN_CONTENT_CHARS = 200
MAX_TOP_GRAM_SHARE = 0.08
MARKER = r"\[E?\d+\]"
#: shapes of credentials, tried in this order
SECRET_SHAPES = (
    r"gsk_[A-Za-z0-9]{20,}",
    r"pcsk_[A-Za-z0-9]{20,}",
    r"sk-[A-Za-z0-9]{20,}",
    r"AIza[A-Za-z0-9_-]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@]+:[^\s@]+@",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}",
    r"(?i)(authorization|x-api-key|api[-_]?key)([\"']?\s*[:=]\s*[\"']?)([A-Za-z0-9._~+/=-]{12,})",
)
CREDENTIAL_IN_URL = r"(\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@]+:)([^\s@]+)(@)"
REDACTED = "[REDACTED]"
LEAK_MARKERS = (
    "chain of thought",
    "chain-of-thought",
    "let me think step by step",
    "my reasoning is",
    "internal monologue",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _words(items) -> Column:
    return F.array(*[F.lit(w) for w in items])


def let(value: Column, then) -> Column:
    """``then(value)``, the value being computed once though a lambda uses it often."""
    return F.transform(F.array(value), then)[0]


def collapsed(text: Column | str) -> Column:
    """White-space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


# -- H1, H2, H3 ------------------------------------------------------------------------


def chunking_signature(settings: Settings = DEFAULTS, version: str = "1") -> str:
    """A short tag of everything that decides how units are built."""
    import hashlib

    parts = (
        version,
        settings.chunk_min_tokens,
        settings.chunk_max_tokens,
        settings.chunk_overlap_tokens,
        settings.chunk_floor_tokens,
        settings.drop_navigation,
        settings.navigation_min_words,
        settings.navigation_words_per_line,
    )
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]


def unit_fingerprint(text: Column | str) -> Column:
    return F.sha2(collapsed(text), 256)


def content_fingerprint(text: Column | str, settings: Settings = DEFAULTS) -> Column:
    """A page's hash changes with its text and with the chunking policy."""
    return F.sha2(F.concat(F.lit(chunking_signature(settings)), F.char(F.lit(0)), collapsed(text)), 256)


def token_estimate(text: Column | str, block_type: Column | str | None = None) -> Column:
    """Tokens that a text has at least, by the density of its block type."""
    divisor = F.lit(DEFAULT_CHARS_PER_TOKEN)
    if block_type is not None:
        table = F.create_map(*[F.lit(x) for pair in CHARS_PER_TOKEN.items() for x in pair])
        divisor = F.coalesce(F.try_element_at(table, _c(block_type)), divisor)
    return F.floor(F.length(collapsed(text)) / divisor).cast("int")


def byte_size(text: Column | str) -> Column:
    return F.octet_length(_c(text))


def over_byte_limit(text: Column | str, settings: Settings = DEFAULTS) -> Column:
    return byte_size(text) > settings.vector_bytes


# -- B1, B2, B3 ------------------------------------------------------------------------


def content_type_reason(content_type: Column | str) -> Column:
    media = F.lower(F.trim(F.split(_c(content_type), ";")[0]))
    return F.when(_c(content_type).isNull(), "missing_content_type").when(
        ~media.isin("text/html", "application/xhtml+xml"), "non_html_content_type"
    )


def is_error_page(text: Column | str) -> Column:
    head = F.lower(F.substring(stripped(text), 1, 400))
    return reduce(lambda a, b: a | b, [F.contains(head, F.lit(m)) for m in ERROR_MARKERS])


def is_too_small(text: Column | str) -> Column:
    return F.length(stripped(text)) < MIN_CONTENT_CHARS


# -- B11 -------------------------------------------------------------------------------


def language_guess(text: Column | str) -> Column:
    """Struct of language and confidence, from the share of ASCII letters and of stop
    words among the first 300 words of over two letters."""
    text = _c(text)
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), 0), lambda w: F.length(w) > 2)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    # null without letters, where a division would end the query
    ascii_share = let(letters, lambda n: F.when(n > 0, F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / n))
    result = lambda lang, c: F.struct(F.lit(lang).alias("language"), F.lit(c).alias("confidence"))

    def shares(sample: Column) -> Column:
        hits = F.size(F.filter(sample, lambda w: F.lower(w).isin(LANGUAGE_STOP_WORDS)))
        return F.struct(F.size(sample).alias("n"), F.when(F.size(sample) > 0, hits / F.size(sample)).alias("stop"), ascii_share.alias("ascii"))

    def decided(s: Column) -> Column:
        return (
            F.when((s["n"] > 0) & (s["ascii"] > 0.9) & (s["stop"] >= 0.08), result("en", 0.95))
            .when((s["n"] > 0) & (s["ascii"] > 0.7) & (s["stop"] >= 0.03), result("en", 0.6))
            .otherwise(result("unknown", 0.3))
        )

    return let(let(F.slice(words, 1, 300), shares), decided)


# -- H4 to H14 -------------------------------------------------------------------------


def content_tokens(text: Column | str) -> Column:
    parts = F.split(F.lower(_c(text)), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(CONTENT_STOP_WORDS))


def normal_form(text: Column | str) -> Column:
    return F.array_join(content_tokens(text), " ")


def _heading(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def heading_covers(expected: Column | str, actual: Column | str) -> Column:
    """The expected path occurs in the actual one, in order, gaps allowed."""
    part = lambda path: F.filter(F.transform(_c(path), _heading), lambda h: h != "")

    def covers(want: Column) -> Column:
        got = F.aggregate(part(actual), F.lit(0), lambda i, a: F.when(F.get(want, i) == a, i + 1).otherwise(i))
        return (F.size(want) > 0) & (got == F.size(want))

    return F.coalesce(let(part(expected), covers), F.lit(False))


def unit_covers(product: Column, heading_path: Column, want_product: Column, want_path: Column) -> Column:
    """The unit is of the product, if one is wanted, and its path covers the one wanted;
    the category does not matter."""
    same = want_product.isNull() | F.coalesce(normal_form(product) == normal_form(want_product), F.lit(False))
    return same & ((F.coalesce(F.size(want_path), F.lit(0)) <= 0) | heading_covers(want_path, heading_path))


def topic_covered(topic: Column, text_tokens: Column) -> Column:
    tokens = content_tokens(topic)
    return (F.size(tokens) > 0) & (F.size(F.array_except(tokens, text_tokens)) == 0)


def claim_coverage(topics: Column | str, answer: Column | str) -> Column:
    topics = _c(topics)
    covered = let(content_tokens(answer), lambda tokens: F.size(F.filter(topics, lambda t: topic_covered(t, tokens))))
    return F.when(F.size(topics) > 0, covered / F.size(topics))


def _claim_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: ~w.isin(CLAIM_STOP_WORDS))


def substantive_sentences(answer: Column | str) -> Column:
    """Sentences with at least four content words.  Markers that lead a sentence belong
    to the one before it."""
    ended = F.regexp_replace(stripped(answer), r"(?U)([.!?])\s+", "$1\x01")
    parts = F.filter(F.transform(F.split(ended, "\x01"), stripped), lambda s: s != "")
    lead = rf"^((?:{MARKER}(?U:\s*))+)"

    def step(done: Column, part: Column) -> Column:
        leading = F.regexp_extract_all(F.regexp_extract(part, lead, 1), F.lit(MARKER), 0)
        rest = stripped(F.regexp_replace(part, lead, ""))
        n = F.size(done)
        moved = F.when(
            (F.size(leading) > 0) & (n > 0),
            F.transform(
                done, lambda s, i: F.when(i == n - 1, F.concat(s, F.lit(" "), F.array_join(leading, " "))).otherwise(s)
            ),
        ).otherwise(done)
        return F.when(F.size(_claim_words(rest)) >= 4, F.concat(moved, F.array(rest))).otherwise(moved)

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def uncited_claims(answer: Column | str) -> Column:
    return F.filter(substantive_sentences(answer), lambda s: ~s.rlike(MARKER))


def fabricated_count(answer: Column | str) -> Column:
    return F.size(uncited_claims(answer))


def citation_completeness(answer: Column | str) -> Column:
    claims = substantive_sentences(answer)
    marked = F.size(F.filter(claims, lambda s: s.rlike(MARKER)))
    return F.when(F.size(claims) > 0, marked / F.size(claims)).otherwise(0.0)


def faithfulness(answer: Column | str, quotes: Column | str) -> Column:
    """The share of claims grounded in the quotes: a third of the claim's words occur in
    them, two at least of five letters or more."""
    claims = substantive_sentences(answer)
    seen = F.array_distinct(F.flatten(F.transform(_c(quotes), content_tokens)))

    def grounded(claim: Column, seen: Column) -> Column:
        tokens = F.array_distinct(content_tokens(claim))
        shared = F.array_intersect(tokens, seen)
        long = F.size(F.filter(shared, lambda w: F.length(w) >= 5))
        return (F.size(tokens) > 0) & (F.size(shared) / F.size(tokens) >= 1 / 3) & (long >= 2)

    def share(c: Column) -> Column:
        n = F.when(F.coalesce(F.size(c["seen"]), F.lit(0)) <= 0, 0).otherwise(
            F.size(F.filter(c["claims"], lambda x: grounded(x, c["seen"])))
        )
        return F.when(F.size(c["claims"]) > 0, n / F.size(c["claims"]))

    return let(F.struct(claims.alias("claims"), seen.alias("seen")), share)


def answer_relevance(question: Column | str, answer: Column | str) -> Column:
    asked = F.array_distinct(content_tokens(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, content_tokens(answer))) / F.size(asked))


def citation_validity(valid: Column, stripped_: Column, rejected: Column) -> Column:
    total = valid + stripped_ + rejected
    return F.when(total > 0, valid / total)


def heading_relevance(query: Column | str, heading_path: Column | str) -> Column:
    """Share of the query's terms that occur in the heading path."""

    def terms(text: Column) -> Column:
        parts = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,!?\"'()]+|[.,!?\"'()]+$", "")))
        return F.array_distinct(F.filter(parts, lambda w: w != ""))

    asked, path = terms(_c(query)), F.flatten(F.transform(_c(heading_path), terms))
    return F.when(F.size(asked) > 0, F.coalesce(F.size(F.array_intersect(asked, path)), F.lit(0)) / F.size(asked)).otherwise(0.0)


# -- G4, C15 ---------------------------------------------------------------------------


def trigrams(text: Column | str) -> Column:
    def of(s: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))
        return F.when(F.length(s) >= 3, F.array_distinct(parts)).otherwise(F.array(s))

    return let(trigram_text(text), of)


def trigram_text(text: Column | str) -> Column:
    """What trigrams are taken from: words in lower case, a space between them."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"(?U)\W+", " "))


def set_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


# -- H21, H22, H26, H28, H34 -----------------------------------------------------------


def redact(text: Column | str) -> Column:
    """Credentials replaced; of a connection string only the password goes first.  A text
    in which no shape occurs is left alone after one look."""
    text = _c(text)
    out = F.regexp_replace(text, CREDENTIAL_IN_URL, rf"$1{REDACTED}$3")
    out = reduce(lambda t, p: F.regexp_replace(t, p, REDACTED), SECRET_SHAPES, out)
    some = "|".join(f"(?:{p})" for p in (CREDENTIAL_IN_URL, *SECRET_SHAPES))
    return F.when(text.rlike(some), out).otherwise(text)


def redact_value(value: Column | str, kind: DataType, depth: int = 4) -> Column:
    """Every string in a nested value redacted, down to ``depth`` levels of structs, arrays
    and maps; what lies deeper, and what is no text, stays as it is."""
    value = _c(value)
    if isinstance(kind, StringType):
        return redact(value)
    if depth <= 0:
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redact_value(x, kind.elementType, depth - 1))
    if isinstance(kind, MapType):
        keys = F.transform_keys(value, lambda k, _: redact_value(k, kind.keyType, depth - 1))
        return F.transform_values(keys, lambda _, v: redact_value(v, kind.valueType, depth - 1))
    if isinstance(kind, StructType):
        fields = [redact_value(value[f.name], f.dataType, depth - 1).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def scrub(text: Column | str) -> Column:
    """Invisible characters go; an active tag's bracket is escaped."""
    seen = F.regexp_replace(F.coalesce(_c(text), F.lit("")), "[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]", "")
    return F.regexp_replace(seen, r"(?i)<(script|style|iframe|object|embed|form)\b", "&lt;$1")


def scrub_controls(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def verdict(value: Column | str) -> Column:
    return F.when(_c(value).isin("SUPPORTED", "UNSUPPORTED", "PARTIAL"), _c(value)).otherwise("UNSUPPORTED")


def reasoning_keys(payload: Column | str, depth: int = 8) -> Column:
    """Paths, like ``$.a[1].thought``, of the keys of a JSON text that name a reasoning
    channel, down to ``depth`` levels below the root.

    One fold over the text's brackets, commas and strings; a string is a key only if a
    colon follows it, so that what a value says is never taken for one.
    """
    tokens = F.regexp_extract_all(_c(payload), F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?|[{}\[\],]'), 0)
    pattern = "(?i)reasoning|thought|chain_of_thought|deliberation|reflection|scratchpad"
    start = F.struct(
        F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("at"), F.lit("$").alias("next"),
        F.array().cast("array<string>").alias("found"),
    )

    def step(s: Column, t: Column) -> Column:
        def state(path: Column = s["path"], at: Column = s["at"], then: Column = s["next"], found: Column = s["found"]) -> Column:
            return F.struct(path.alias("path"), at.alias("at"), then.alias("next"), found.alias("found"))

        top = F.get(s["at"], F.size(s["at"]) - 1)  # the place in an array, -1 in an object
        own = F.when(top >= 0, F.concat(F.lit("["), top.cast("string"), F.lit("]"))).otherwise(s["next"])
        less = lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))
        name = F.concat(F.lit("."), F.regexp_replace(t, r'^"|"\s*:$', ""))
        named = name.rlike(pattern) & (F.size(s["path"]) <= depth + 1)
        found = F.when(named, F.concat(s["found"], F.array(F.concat(F.array_join(s["path"], ""), name)))).otherwise(s["found"])
        return (
            F.when(t.isin("{", "["), state(F.concat(s["path"], F.array(own)), F.concat(s["at"], F.array(F.when(t == "[", 0).otherwise(-1)))))
            .when(t.isin("}", "]"), state(less(s["path"]), less(s["at"])))
            .when((t == ",") & (top >= 0), state(at=F.concat(less(s["at"]), F.array(top + 1))))
            .when(F.endswith(t, F.lit(":")), state(then=name, found=found))
            .otherwise(s)
        )

    return F.aggregate(tokens, start, step, lambda s: s["found"])


def deliberation_marker(text: Column | str) -> Column:
    """The first phrase that shows exposed deliberation, or null."""
    return F.get(F.filter(_words(LEAK_MARKERS), lambda m: F.contains(F.lower(_c(text)), m)), F.lit(0))


# -- H19, H23, H29, H30, H32 -----------------------------------------------------------


def inner_text(html: Column) -> Column:
    """A fragment without tags, its commonest character references decoded."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return collapsed(text)


def page_title(html: Column | str, url: Column | str) -> Column:
    """Struct of title and confidence: first h1, then title, then the URL's last part."""
    html = _c(html)
    none_if_empty = lambda c: F.when(c != "", c)
    h1 = none_if_empty(inner_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)))
    title = none_if_empty(inner_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))
    path = F.regexp_replace(F.regexp_replace(_c(url), "[?#].*$", ""), "^[a-z]+://[^/]*", "")
    slug = F.trim(F.regexp_replace(F.regexp_extract(path, "([^/]*)/*$", 1), "[-_]+", " "))
    as_ = lambda t, c: F.struct(t.alias("title"), F.lit(c).alias("confidence"))
    return F.when(h1.isNotNull(), as_(h1, 0.95)).when(title.isNotNull(), as_(title, 0.6)).otherwise(as_(slug, 0.3))


def canonical_url(html: Column | str, url: Column | str) -> Column:
    found = F.trim(
        F.regexp_extract(_c(html), r"""(?i)<link\s+[^>]*rel=["'][^>]*canonical[^>]*href=["']([^"']+)""", 1)
    )
    return F.when(found != "", found).otherwise(_c(url))


def vector_id(document_id: Column | str, ordinal: Column | str) -> Column:
    return F.format_string("%s#%04d", _c(document_id), _c(ordinal))


def display_heading(path: Column | str) -> Column:
    return F.array_join(_c(path), " > ")


def evidence_quote(text: Column | str) -> Column:
    return stripped(F.substring(_c(text), 1, 200))


def state_code(detail: Column | str) -> Column:
    return F.get_json_object(_c(detail), "$.code")


def answer_segments(answer: Column | str) -> Column:
    """The answer cut at its ``[n]`` links: text pieces and links, in order."""
    marked = F.regexp_replace(_c(answer), r"(\[\d+\])", "\x01$1\x01")
    pieces = F.filter(F.split(marked, "\x01"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            p.alias("text"), F.when(p.rlike(r"^\[\d+\]$"), F.regexp_extract(p, r"\d+", 0).cast("int")).alias("rank")
        ),
    )


# -- H31 -------------------------------------------------------------------------------


def latency_ms(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds from one timestamp to another; null if either is."""
    return F.floor((F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / 1000).cast("long")


def iso_text(at: Column | str) -> Column:
    """A timestamp (in a UTC session) as ISO text, with microseconds only where it has any."""
    at = _c(at)
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    part = F.when(micros != 0, F.format_string(".%06d", micros)).otherwise("")
    return F.when(at.isNotNull(), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00")))
