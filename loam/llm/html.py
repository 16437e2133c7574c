"""Main-text extraction by tree scoring.

A page becomes a light tree.  Paragraphs give points, for being there, for length and
for commas, to their ancestors, less by distance and by link density.  If the container
with most points stands in an ``article`` or ``main``, all of that is kept; else the
container is kept together with the siblings of it and of its ancestors that are content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: never part of a text
_DROPPED = frozenset(
    "script style head title nav header footer aside form noscript template svg iframe object canvas audio video"
    " button select textarea input dialog menu".split()
)
_BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6"
    " hgroup hr html li main ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: an opening tag of the second set ends an open element of the first, inside the third
_ENDS = (
    (frozenset({"p"}), _BLOCK | _DROPPED - {"button", "script", "svg"}, frozenset({"td", "th", "table"})),
    (frozenset({"li"}), frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"td", "th"}), frozenset({"td", "th", "tr", "tbody", "tfoot"}), frozenset({"table"})),
    (frozenset({"tr"}), frozenset({"tr", "tbody", "tfoot"}), frozenset({"table"})),
)
#: words in class, id or role that mark what is not the article
_ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation"
    " menu breadcrumb breadcrumbs sidebar aside complementary footer contentinfo header masthead cookie cookies consent"
    " gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related"
    " recommended comment comments commentlist disqus respond reply replies toolbar pagination pager widget search"
    " skip copyright hidden sidenav topnav".split()
)
_COMMENT = frozenset("comment comments commentlist disqus respond reply replies".split())
#: words that may stand beside those: a name like alert-level or social-history marks nothing
_BESIDE = frozenset(
    "area articles bar block bottom box button buttons container content discussion form global google group inner item"
    " items left link links list main message msg outer page panel post posts primary reader readers right row section"
    " site slot stories text thread top unit user users wrap wrapper".split()
)
#: a name that ends so marks comments, whatever stands before, but for words that say where they are
_COMMENTS_LAST = frozenset("comments commentlist disqus replies".split())
_SAYS_WHERE = frozenset("has have with no without show hide".split())
_MARKED = ("article", "main")
_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"})
_WORDS = re.compile(r"[a-z]{2,}|[A-Z][a-z]+|[A-Z]{2,}")


def _words(name: str) -> list[str]:
    """The words of a class, id or role; two that are one known word, like side-bar, count as that."""
    out: list[str] = []
    for w in _WORDS.findall(name):
        if out and out[-1] + w.lower() in _ASIDE:
            out[-1] += w.lower()
        else:
            out.append(w.lower())
    return out


def _names(words: list[str], kinds: frozenset) -> bool:
    """Whether a whole name, like ``ad-box``, says one of the kinds."""
    return not kinds.isdisjoint(words) and _ASIDE.union(_BESIDE).issuperset(words)


def _names_comments(words: list[str]) -> bool:
    return _names(words, _COMMENT) or words[-1:] != [] and words[-1] in _COMMENTS_LAST and words[0] not in _SAYS_WHERE


@lru_cache(1 << 14)
def _marks(name: str, inside: bool) -> tuple[bool, bool]:
    """Whether a name marks what is not the article, and whether it marks comments.  The head
    of an article is part of it, that of the page is not."""
    words = _words(name)
    comment = _names_comments(words)
    kinds = _ASIDE - {"header", "masthead"} if inside else _ASIDE
    return comment or _names(words, kinds) or words in (["page", "header"], ["site", "header"]), comment


_PARAGRAPH = frozenset({"p", "pre", "blockquote", "li", "td", "dd", "div", "section", "article", "main", "body"})
_OWN_POINTS = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 5.0, "ul": -3.0, "ol": -3.0, "table": -3.0}


class Node:
    __slots__ = (
        "tag", "aside", "comment", "hidden", "parent", "children", "points", "far", "holds_main", "inside", "left_out",
    )

    def __init__(self, tag: str, attrs: list, parent: "Node | None"):
        self.tag, self.parent, self.children = tag, parent, []
        self.aside = self.comment = self.hidden = self.holds_main = self.left_out = False
        self.inside = parent is not None and (parent.inside or parent.tag in _MARKED)
        self.points: float | None = None
        self.far = 0.0  # points from paragraphs so far below that all above share them alike
        for k, v in attrs:
            if k in ("class", "id", "role"):
                for name in (v or "").split():
                    aside, comment = _marks(name, self.inside)
                    self.aside |= aside
                    self.comment |= comment
            elif k == "hidden" or k == "aria-hidden" and v == "true":
                self.hidden = True
            elif k == "style" and re.search(r"display\s*:\s*none", v or "", re.I):
                self.hidden = True


class _Builder(HTMLParser):
    """``path`` holds the open elements and ``where`` the places in it of each tag's, so that
    what an element closes is found at once however deep a page is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", [], None)
        self.path = [self.root]
        self.where: dict[str, list[int]] = {}
        self.nodes = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        for ended, by, inside in _ENDS:
            if tag in by:
                self._close(ended, inside)
        at = self.path[-1]
        node = Node(tag, attrs, at)
        at.children.append(node)
        self.nodes.append(node)
        if tag in _MARKED and not node.comment:
            up = at
            while up is not None and not up.holds_main:
                up.holds_main = True
                up = up.parent
        if tag not in _VOID:
            self.where.setdefault(tag, []).append(len(self.path))
            self.path.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # only void elements close themselves in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body"):
            self._close((tag,), frozenset() if tag in _BLOCK or tag in _DROPPED else _BLOCK)

    def handle_data(self, data: str) -> None:
        self.path[-1].children.append(data)

    def _last(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def _close(self, tags, inside) -> None:
        place = self._last(tags)
        if place and place > self._last(inside):
            for node in self.path[place:]:
                self.where[node.tag].pop()
            del self.path[place:]


def _kept(node: Node) -> bool:
    if node.tag in _DROPPED and not (node.tag == "header" and node.inside or node.tag == "form" and node.holds_main):
        return False
    if node.hidden or node.left_out:
        return False
    if node.comment:
        return node.tag == "body"
    return not node.aside or node.tag == "body" or node.tag in _MARKED or node.holds_main


def _walk(top: Node) -> Iterator[tuple[Node | str, bool]]:
    """Kept nodes and strings below ``top`` in page order; a node comes again, with
    True, after what it holds."""
    stack: list = [(top, False)]
    while stack:
        node, after = stack.pop()
        yield node, after
        if not after and not isinstance(node, str):
            stack.append((node, True))
            stack += [(c, False) for c in reversed(node.children) if isinstance(c, str) or _kept(c)]


def _give(node: Node, points: float) -> None:
    if node.points is None:
        node.points = _OWN_POINTS.get(node.tag, 0.0)
    node.points += points


def _score(root: Node, nodes: list[Node]) -> None:
    """Give points to containers; ``points`` stays None where no paragraph is below.  The
    nearest four levels get theirs at once, what all above get is handed up once for
    each node (``nodes`` in page order)."""
    open_: list[list] = []  # of paragraph candidates: node, characters, in links, commas
    link = 0
    for node, after in _walk(root):
        if isinstance(node, str):
            if open_ and (n := len(" ".join(node.split()))):
                open_[-1][1] += n
                open_[-1][2] += n if link else 0
                open_[-1][3] += node.count(",") + node.count("、") + node.count("،")
        elif node.tag == "a":
            link += -1 if after else 1
        elif node.tag in _PARAGRAPH:
            if not after:
                open_.append([node, 0, 0, 0])
                continue
            _, size, linked, commas = open_.pop()
            if not size:
                continue
            points = (1 + commas + min(size / 100, 3)) * (1 - linked / size)
            # text of its own makes a container a paragraph of itself
            up, level = (node.parent if node.tag in ("p", "pre", "blockquote", "li", "td", "dd") else node), 0
            while up is not None and level < 4:
                _give(up, points / (1, 2, 6, 9)[level])
                up, level = up.parent, level + 1
            if up is not None:
                if up.points is None:
                    _give(up, 0.0)
                up.far += points
    for node in reversed(nodes):
        if node.points is not None:
            node.points += node.far / 12
            if node.parent is not None:
                if node.parent.points is None:
                    _give(node.parent, 0.0)
                node.parent.far += node.far


def _blocks(top: Node) -> list[str]:
    out, run = [], []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    for node, after in _walk(top):
        if isinstance(node, str):
            run.append(node)
        elif node.tag in _BLOCK:
            flush()
        elif node.tag in ("br", "td", "th"):
            run.append(" ")
    flush()
    return out


def _sizes(top: Node) -> tuple[int, int]:
    """Characters below ``top``, and those of them in links."""
    size = linked = depth = 0
    for node, after in _walk(top):
        if isinstance(node, str):
            n = len(" ".join(node.split()))
            size += n
            linked += n if depth else 0
        elif node.tag == "a":
            depth += -1 if after else 1
    return size, linked


def _is_content(node: Node, best: Node, marked: bool, beside: bool) -> bool:
    """Whether a sibling of the best container (``beside``) or of one of its ancestors
    belongs to the text.  ``marked``: an article or main stands around the container."""
    if marked:  # other articles, and headings of the main part
        same = node.tag == "article" and (node.points or 0) >= 0.2 * best.points
        return same or node.inside and node.tag in _HEADINGS
    if node.tag not in _BLOCK:
        return True
    size, linked = _sizes(node)
    if 2 * linked > size:
        return False
    return beside or node.tag in _HEADINGS or (node.points or 0) >= max(3.0, 0.05 * best.points)


def main_text(html: str | None) -> str:
    """The main text of a page: blocks joined by two newlines; empty if there is none.

    Of what an article or main holds, only the kinds that the contract names are left
    out, by their tag or by a class, id or role that as a whole names one; the head of an
    article (its title) is part of it.  Without such an element, blocks beside the best
    container stay unless more than half of their text is in links; blocks further out
    have to be headings or to score as well.
    """
    builder = _Builder()
    builder.feed(html or "")
    if builder.rawdata.startswith("<!--"):  # a comment that is not closed runs to the end
        builder.rawdata = ""
    builder.close()
    root = builder.root
    _score(root, builder.nodes)
    best = None
    for node, after in _walk(root):
        if not after and not isinstance(node, str) and node.points is not None:
            if best is None or node.points > best.points:
                best = node
    if best is None:
        return "\n\n".join(_blocks(root))
    top = best
    while top is not None and top.tag not in _MARKED:
        top = top.parent
    marked = top is not None
    node = top if marked else best
    beside = True
    while node.parent is not None and node.tag not in ("main", "body"):
        for other in node.parent.children:
            if other is not node and not isinstance(other, str) and _kept(other):
                other.left_out = not _is_content(other, best, marked, beside)
        node, beside = node.parent, False
    return "\n\n".join(_blocks(node))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html; others are ignored) to ``page_id``, ``url``,
    ``text`` and ``n_chars`` (code points), one row per row.

    Null and empty pages, and pages that hold no text, give an empty text; ids and urls
    are carried as they are; no rows give no rows.  Pages are cut nowhere.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
