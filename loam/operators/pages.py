"""Pages: scan, gate, metadata, links, and flat blocks (corpus build, first half)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..settings import DEFAULTS, Settings
from ..storage import small_batches


def scan_pages(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pages with ``fetch_outcome``: ok, failed (5xx, 429), http_error, or too_large by the
    byte cap.  A missing ``status`` column counts as 200."""
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    return pages.withColumn(
        "fetch_outcome",
        F.when((status >= 500) | (status == 429), "failed")
        .when(~status.between(200, 299), "http_error")
        .when(F.octet_length("html") > settings.page_max_bytes, "too_large")
        .otherwise("ok"),
    )


def top_gram_share(text: Column | str, n: int = 4) -> Column:
    """How many of a text's word n-grams are its commonest one, as a share; null without an
    n-gram.  Each row's grams are hashed and counted in its Arrow batch; nothing is shuffled."""
    words = F.lower(T.collapsed(text))

    @F.pandas_udf("double")
    def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scale = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
        for texts in batches:
            out = np.full(len(texts), np.nan)
            for i, t in enumerate(texts):
                w = [] if t is None else t.split(" ")
                if len(w) >= n:
                    h = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    grams = np.sort(sum((h[j : len(h) - n + 1 + j] ^ (h[j : len(h) - n + 1 + j] >> np.uint64(32))) * scale[j] for j in range(n)))
                    ends = np.flatnonzero(np.append(grams[1:] != grams[:-1], True))
                    out[i] = np.diff(ends, prepend=-1).max() / len(grams)
            yield pd.Series(out)

    return share(words)


def page_gate(docs: DataFrame, text: str = "text", content_type: str | None = None) -> DataFrame:
    """``docs`` with ``reject_reason``: the first of content type, no text, error page, too
    small, boilerplate; null if the page is kept.  Every row is judged by itself."""
    first = T.content_type_reason(content_type) if content_type else F.lit(None).cast("string")
    reason = F.coalesce(
        first,
        F.when(T.stripped(F.coalesce(F.col(text), F.lit(""))) == "", "no_content"),
        F.when(T.is_error_page(text), "error_page"),
        F.when(T.is_too_small(text), "too_small"),
        F.when(top_gram_share(text) >= T.MAX_TOP_GRAM_SHARE, "boilerplate_heavy"),
    )
    return docs.withColumn("reject_reason", reason)


def page_metadata(pages: DataFrame, text: Column | None = None) -> DataFrame:
    """One metadata row per page, each guess with its confidence."""
    body = text if text is not None else T.inner_text(F.col("html"))
    title = T.page_title("html", "url")
    return (
        pages.withColumn("_title", title)
        .withColumn("_language", T.language_guess(body))
        .select(
            "page_id",
            F.col("_title.title").alias("title"),
            F.col("_title.confidence").alias("title_confidence"),
            *_pair(U.product_of("url"), "product"),
            *_pair(U.category_of("url"), "category"),
            *_pair(U.page_type_of(F.col("_title.title"), "url"), "page_type"),
            F.col("_language.language").alias("language"),
            F.col("_language.confidence").alias("language_confidence"),
            T.canonical_url("html", "url").alias("canonical_url"),
        )
    )


def _pair(value: Column, name: str) -> tuple[Column, Column]:
    return value[name].alias(name), value["confidence"].alias(f"{name}_confidence")


def links(pages: DataFrame) -> DataFrame:
    """``page_id``, ``pos`` and ``href`` of all anchors."""
    return pages.select("page_id", F.posexplode(U.page_links("html")).alias("pos", "href"))


# --------------------------------------------------------------------------- blocks

# What is no part of a page's blocks, and what is none of the plain walk's.
_SKIPPED = {"nav", "header", "footer", "aside", "script", "style", "noscript", "form", "template"}
_SKIPPED_PLAINLY = {"nav", "header", "footer", "aside", "script", "style", "noscript"}
#: what holds others; an open one ends with the element around it
_HOLDERS = {"div", "section", "article", "main", "body"}
_KIND = {"p": "p", "pre": "code", "table": "table", "blockquote": "quote", "ul": "list", "ol": "list"}
_HEADINGS = {f"h{i}": i for i in range(1, 7)}


class _Blocks(HTMLParser):
    """A page as a flat run of (kind, level, text); hierarchy is made later, in SQL.

    What is skipped ends with its own end or that of the element around it.  The head of an
    article is part of it, and an article or main part inside a form, menu or page head is not
    skipped with that.  The plain walk (``plain``) takes every heading and block that does
    not stand in its fewer skipped elements.
    """

    def __init__(self, plain: bool = False):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, str]] = []
        self.plain = plain
        #: open holders and skipped elements, and whether each is skipped
        self.path: list[tuple[str, bool]] = []
        self.where: dict[str, list[int]] = {}
        self.kind: str | None = None
        self.level, self.depth, self.text = 0, 0, []
        self.title = False

    @property
    def skip(self) -> bool:
        return bool(self.path) and self.path[-1][1]

    def _open(self, tag: str) -> None:
        skip = self.skip
        if tag in (_SKIPPED_PLAINLY if self.plain else _SKIPPED):
            head = tag == "header" and not self.plain and (self.where.get("article") or self.where.get("main"))
            skip = skip or not head
        elif tag in ("article", "main") and skip and not self.plain:
            skip = any(self.where.get(t) for t in _SKIPPED - {"form", "nav", "header"})
        self.where.setdefault(tag, []).append(len(self.path))
        self.path.append((tag, skip))

    def _end(self, tag: str) -> None:
        if self.where.get(tag):
            at = self.where[tag][-1]
            for t, _ in self.path[at:]:
                self.where[t].pop()
            del self.path[at:]

    def flush(self) -> None:
        joined = "".join(self.text)
        if self.kind == "code":
            text = joined.strip("\n")
        else:
            text = "\n".join(x for x in (" ".join(line.split()) for line in joined.split("\n")) if x)
        if text.strip():
            self.rows.append((self.kind or "p", self.level, text))
        self.kind, self.level, self.depth, self.text = None, 0, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED | _HOLDERS:
            if tag in _HOLDERS and not self.skip and self.kind in (None, "p"):
                self.flush()
            self._open(tag)
        if self.skip or tag in _SKIPPED:
            return
        if tag == "title":
            self.title = True
        elif tag in _HEADINGS or tag in _KIND:
            if self.kind in ("list", "table", "quote") and tag not in _HEADINGS:
                self.depth += tag in ("ul", "ol", "table", "blockquote")
                self.text.append("\n")
                return
            self.flush()
            self.kind, self.level = (_KIND.get(tag) or "heading"), _HEADINGS.get(tag, 0)
            self.depth = 1
        elif tag in ("li", "tr", "br", "dt", "dd"):
            self.text.append("\n")
        elif tag in ("td", "th"):
            self.text.append(" ")

    def handle_endtag(self, tag):
        was = self.skip
        if tag in _SKIPPED | _HOLDERS:
            self._end(tag)
        if was or self.skip or tag in _SKIPPED:
            return
        if tag == "title":
            self.title = False
        elif tag in _HEADINGS or tag in ("p", "pre"):
            if self.kind not in ("list", "table", "quote"):
                self.flush()
        elif tag in ("ul", "ol", "table", "blockquote"):
            self.depth -= 1
            if self.depth <= 0:
                self.flush()
        elif tag in _HOLDERS and self.kind in (None, "p"):
            self.flush()

    def handle_data(self, data):
        if not self.skip and not self.title:
            self.text.append(data)


def _walk(html: str | None, plain: bool = False) -> list[tuple[str, int, str]]:
    parser = _Blocks(plain)
    parser.feed(html or "")
    if parser.rawdata.startswith("<!--"):  # a comment that is not closed runs to the end
        parser.rawdata = ""
    parser.close()
    parser.flush()
    return parser.rows


_ANY_HEADING = re.compile(r"<h[1-6][\s>]", re.I)


#: the start of a character reference that no semicolon ends
_UNENDED = re.compile(r"&(?=#?\w+(?![\w;]))")


def page_blocks(html: str | None, ended: bool = False) -> list[tuple[str, int, str]]:
    """Blocks of one page: (block_type, level, text).  A page with headings of which the walk finds
    none is walked plainly instead.  With ``ended`` only character references that end with a
    semicolon are decoded, as ``inner_text`` has it."""
    if ended and html:
        html = _UNENDED.sub("&amp;", html)
    rows = _walk(html)
    if html and _ANY_HEADING.search(html) and all(kind != "heading" for kind, *_ in rows):
        plain = _walk(html, plain=True)
        return plain if any(kind == "heading" for kind, *_ in plain) else rows
    return rows


#: blocks that a task hands back at once
BLOCK_ROWS = 1000
BLOCKS = "pos int, block_type string, level int, text string"


def flat_blocks(pages: DataFrame) -> DataFrame:
    """``page_id``, ``pos``, ``block_type`` (heading, p, list, table, code, quote), ``level``
    and ``text`` of every block of every page, in page order.

    The tokeniser of the standard library runs one page at a time in batches of few bytes, and
    BLOCK_ROWS blocks, or one page's, are handed back at once.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for page_id, html in zip(*batch.columns):
                page_id = page_id.as_py()
                rows += [(page_id, i, *row) for i, row in enumerate(page_blocks(html.as_py()))]
                if len(rows) >= BLOCK_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["page_id", "pos", "block_type", "level", "text"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    return pages.select("page_id", "html").mapInArrow(run, f"page_id long, {BLOCKS}")


def register_blocks(spark: SparkSession, name: str = "loam_blocks", ended: bool = False) -> str:
    """Register the table function ``name``(html), for LATERAL joins in SQL: a row (pos, block_type, level,
    text) for each block of a page, as ``page_blocks`` has them."""

    class Blocks:
        def eval(self, html):
            for i, row in enumerate(page_blocks(html, ended)):
                yield (i, *row)

    spark.udtf.register(name, F.udtf(Blocks, returnType=BLOCKS))
    return name
