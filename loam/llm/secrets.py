"""Secret scan with multipart credential linking.

Strong candidates (``assign``, ``access``, ``hex``) are always reported.  Weak ones, an
identifier, an opaque token or an endpoint, are common in clean text; each is reported
only when complementary parts stand within ``reach`` code points of it in the same
scope, a stretch of text without a blank line.  Parts are found in one pass over whole
texts; the linking is an interval join on (document, scope, cell).  A cell is ``reach``
long and the spans of a kind do not overlap, so a part meets a bounded number of others.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

#: strong kinds first, in the order in which spans with one start are listed
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
ROLE = {
    "assign": "secret",
    "access": "id",
    "hex": "secret",
    "ident": "id",
    "opaque": "secret",
    "endpoint": "endpoint",
}

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
# a run of at least the least length is the same as a whole run that is long enough
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_IDENT = re.compile(
    r"""(?:user(?:name|_?id)?|login|account|client_?id|(?:access_?)?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""",
    re.ASCII | re.IGNORECASE,
)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_ENDPOINT = re.compile(
    r"\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+"
    r"|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b"
)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")

_SPANS = "array<struct<start:long,kind:int,end:long,scope:long>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the strong candidates, sorted."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that touch no strong one."""
    found = [(m.start(), 3, m.end()) for m in _IDENT.finditer(text)]
    for m in _OPAQUE.finditer(text):
        s = m[0]
        if re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s):
            found.append((m.start(), 4, m.end()))
    found += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    if not found or not base:
        return sorted(found)
    starts = [b[0] for b in base]
    ends = np.maximum.accumulate([b[2] for b in base])  # of what starts no later

    def free(s: tuple[int, int, int]) -> bool:
        k = int(np.searchsorted(starts, s[2])) - 1  # the last that starts before s ends
        return k < 0 or ends[k] <= s[0]

    return sorted(filter(free, found))


def _scan(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        strong, weak = [], []
        for text in batch["text"]:
            text = text or ""
            b = base_spans(text)
            w = weak_spans(text, b)
            breaks = [m.start() for m in _BLANK.finditer(text)] if w else []
            for spans, into in ((b, strong), (w, weak)):
                into.append(
                    [{"start": s, "kind": k, "end": e, "scope": bisect.bisect_left(breaks, s)} for s, k, e in spans]
                )
        yield {"doc_id": batch["doc_id"], "strong": strong, "weak": weak}


def scan_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) to one row per row of it:
    ``doc_id``, ``strong`` and ``linked``, sorted arrays of (start, kind, end, scope) in
    code points, ``kind`` counting in KINDS.

    A weak identifier is linked by a secret within reach, a weak secret by an
    identifier, an endpoint only by both.  Null and empty texts give empty arrays; a
    null doc_id is kept; repeated rows are scanned and linked each for itself; no rows
    give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = f"doc_id long, strong {_SPANS}, weak {_SPANS}"
    # row ids are fixed once the table is written
    found = map_batches(rows, _scan, schema).withColumn("row", F.monotonically_increasing_id())
    found = written(found, "secrets")
    role = F.element_at(
        F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("part.kind") + 1
    )
    parts = (
        found.where(F.size("weak") > 0)
        .select("row", F.explode(F.concat("strong", "weak")).alias("part"))
        .withColumn("role", role)
    )
    cells = lambda low, high: F.explode(
        F.sequence(F.floor(low / reach).cast("long"), F.floor(high / reach).cast("long"))
    )
    start, end, scope = F.col("part.start"), F.col("part.end"), F.col("part.scope")
    weak = parts.where(F.col("part.kind") >= 3).select(
        "row", "part", "role", scope.alias("scope"), cells(start - reach, end + reach).alias("cell")
    )
    other = parts.select(
        "row",
        scope.alias("scope"),
        cells(start, end).alias("cell"),
        F.col("role").alias("role2"),
        start.alias("start2"),
        end.alias("end2"),
    )
    near = (F.col("role") != F.col("role2")) & (F.col("start2") - end <= reach) & (start - F.col("end2") <= reach)
    linked = (
        weak.join(other, ["row", "scope", "cell"])
        .where(near)
        .groupBy("row", "part", "role")
        .agg(F.max(F.col("role2") == "id").alias("id"), F.max(F.col("role2") == "secret").alias("secret"))
        .where(
            F.when(F.col("role") == "id", F.col("secret"))
            .when(F.col("role") == "secret", F.col("id"))
            .otherwise(F.col("id") & F.col("secret"))
        )
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("part")).alias("linked"))
    )
    none = F.array().cast(_SPANS)
    return found.join(linked, "row", "left").select(
        "doc_id", "strong", F.coalesce("linked", none).alias("linked")
    )


def listed(spans: str) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of each row's spans.  A null text counts as empty and has none;
    repeated rows give a row each; no rows give none."""
    found = scan_secrets(docs)
    count = lambda k: F.size(F.filter("strong", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed("strong"), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("strong", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
