"""Embeddings, conversations, pages, components and the pipeline."""

import hashlib

import numpy as np
import pytest

from loam.llm import chat, html, lattice
from loam.llm.common import connected_components


@pytest.mark.parametrize("chunk", [1024, 7])
def test_lattice(monkeypatch, spark, chunk):
    monkeypatch.setattr(lattice, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 64))
    vectors = [(i, (base[i % 40] + 0.012 * rng.normal(size=64) * (i >= 40) * np.linalg.norm(base[i % 40]) / 1.5), i % 3 if i < 160 else i % 3) for i in range(160)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 40 % 3) for i, v, _ in vectors]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(5)]  # equal vectors
    rows += [rows[3]]  # a repeated row
    rows += [(300, None, 1), (301, [0.0] * 64, 1), (302, [None] * 64, 1), (303, [float("nan")] * 64, 1), (304, rows[0][1], None), (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, rows[0][1], 2 - rows[0][2])]
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, node string, cell int").repartition(3)
    out = lattice.near_duplicate_vectors(df).collect()
    assert len(out) == len(rows)
    good = [k for k, (i, v, l) in enumerate(rows) if v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    link = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            u, v = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and rows[a][2] == rows[b][2] and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                link[a].add(b)
    low = {k: rows[k][0] for k in link}
    for _ in rows:
        low = {k: min([low[k], *(low[j] for j in link[k])]) for k in link}
    want = sorted((rows[k][0], len(link[k]), low[k], rows[k][0] == low[k]) for k in link)
    assert sorted(map(tuple, out)) == want
    assert sum(w[1] for w in want) > 300
    assert lattice.near_duplicate_vectors(df.limit(0)).count() == 0


def test_e8():
    near = lattice.minimal_vectors()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(1), 2)
    x = np.random.default_rng(1).normal(size=(500, 8)) * 3
    p = lattice.nearest_e8(x)
    d = ((x - p) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()  # the covering radius
    for v in near:
        assert (d <= ((x - p - v) ** 2).sum(1) + 1e-9).all()


def conversations():
    nasty = ["<|im_end|>", "<\\|im_end|>", "<<|", "a\n<|im_start|>user\nx<|im_end|>\n", "\\", "", None, "é" * 50_000]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 0, "assistant", "first"), (3, 0, "assistant", "first")]
    rows += [(None, 1, "user", "n"), (4, None, None, "x"), (4, 1, "ro\nle<|\\n", "y"), (5, 0, "user", "q"), (5, 1, "user", "r")]
    return rows


def test_chat(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segments string").repartition(4)
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows = rows + [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == conv))
        said = "".join(f"{role}\n{x}\n" for *_, role, x in turns)
        learnt = "".join(x for *_, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_chars == len(learnt) and r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert {c: r.complete for c, r in got.items()} == {-1: True, 1: True, 2: True, 3: False, None: False, 4: False, 5: False}
    formatted = chat.format_conversations(df)
    assert sorted(map(str, chat.read_back(formatted).collect())) == sorted(map(str, (got[k] for k in got if k != -1)))
    assert chat.digest(df.limit(0)).count() == 1


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/x">Home</a></ul></nav>
<div class="cookie-notice">We use cookies, many, many of them.</div><div class="wrap with-sidebar"><article><h1>The &amp; title</h1>
<p>First, with <b>bold</b>ness &lt;here&gt;.<br>Second&nbsp;line<p>Unclosed <i>one<ul><li>item a<li>item <b>b</b></ul><script>var x="</p>";</script>
<div class="share">Share!</div><pre>code   here</pre><table><tr><td>a<td>b<tr><td>c</table></article>
<aside>Side</aside><section id="comments"><article class="comment"><p>I, a reader, disagree, with, all, of, this.</p></article></section></div>
<div class="ad">Buy, buy, buy</div><form><p>Mail?</p></form><footer><p>&copy; me</p></footer>"""


@pytest.mark.parametrize("name", ["reader-comments", "user-comments", "comment-thread", "discussion-comments", "related-articles", "google-ads", "side-bar", "sidenav", "page-header", "readerComments"])
def test_html_drops(name):
    body = "<p>Some real text, with commas, that is long enough to be a paragraph of an article.</p>" * 4
    gone = f'<div class="{name}"><p>Gone, really, gone.</p></div>'
    text = "\n\n".join(["Some real text, with commas, that is long enough to be a paragraph of an article."] * 4)
    assert html.main_text(f"<body><article>{body}{gone}</article></body>") == text
    assert html.main_text(f"<body><div id=c>{body}{gone}</div></body>") == text


@pytest.mark.parametrize("name", ["has-comments", "social-history", "article-body", "alert-level"])
def test_html_keeps(name):
    assert "stays" in html.main_text(f'<body><article><p>Text, and more.</p><div class="{name}"><p>This stays, really.</p></div></article></body>')


@pytest.mark.parametrize("page, end", [("<div>" * 200_000 + "deep", "deep"), ("<div><p>text, more" * 20_000, "text, more"), ("<p>" * 100_000 + "x", "x"), ("<b>" * 50_000 + "</i>" * 50_000 + "y", "y"), ("<table><tr><td>" * 20_000 + "z", "z"), ("<ul><li>" * 20_000 + "w", "w")])
def test_html_is_linear_in_depth(page, end):
    import time

    began = time.process_time()
    assert html.main_text(page).endswith(end)
    assert time.process_time() - began < 20


def test_html(spark):
    want = "The & title\n\nFirst, with boldness <here>. Second line\n\nUnclosed one\n\nitem a\n\nitem b\n\ncode here\n\na b\n\nc"
    assert html.main_text(PAGE) == want
    plain = "<body><div id=menu><p>Menu, a, b</p></div><div><p>" + "Some prose, and more. " * 20 + "</p><p>End.</p></div><div><a href=x>l</a></div>"
    assert html.main_text(plain) == ("Some prose, and more. " * 20).strip() + "\n\nEnd."
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>x", "x"), (1, "u", PAGE, "x"), (5, "u", "<div>" * 3000 + "deep", "x"), (6, "u", "<p>" + "w " * 200_000, "x"), (7, "u", "<nav>only</nav><!-- c", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == want and by[2] == by[3] == by[7] == "" and by[None] == "x" and by[5] == "deep" and len(by[6]) == 399_999
    assert html.extract_pages(df.limit(0)).count() == 0


LONG = "Some prose, and more of it, said at length. " * 12
KEPT = [  # pages, and the blocks that are their article
    (f"<main><section><p>{LONG}</p></section><section><p>Short.</p></section></main>", [LONG, "Short."]),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p></article>", ["Title", LONG]),
    (f"<body><div><p>{LONG}</p></div><div>More</div><blockquote>Said</blockquote><ul><li>item</ul><pre>code</pre>", [LONG, "More", "Said", "item", "code"]),
    (f"<body><h1>Head</h1><div><p>{LONG}</p></div><h3>Sub</h3><ul><li>one<li>two</ul>", ["Head", LONG, "Sub", "one", "two"]),
    (f'<article><div class="alert-level">High</div><p>{LONG}</p><p class="social-history">Past</p><section id="search-results"><p>Found</p></section></article>', ["High", LONG, "Past", "Found"]),
    (f'<body><div id=content><section>{"".join(f"<p>{LONG}</p>" for _ in range(3))}</section><section><h2>End</h2><p>One short line.</p></section></div>', [LONG, LONG, LONG, "End", "One short line."]),
    (f'<article><p>{LONG}</p><div class="ad-box">Buy</div><div class="share-buttons">Share</div><p>End</p></article>', [LONG, "End"]),
    (f'<article><p>{LONG}</p><div class="related-posts"><p>Other</p></div><section class="comments"><p>I agree</p></section></article>', [LONG]),
    (f'<article><p>{LONG}</p></article><div id="comments"><article class="comment"><p>{LONG * 3}</p></article></div>', [LONG]),
    (f'<header><h1>Site</h1></header><main><h1>Title</h1><article><p>{LONG}</p></article></main><footer>Foot</footer>', ["Title", LONG]),
    (f'<body><h1>Site</h1><article><h1>Title</h1><p>{LONG}</p></article>', ["Title", LONG]),
    (f'<body><div class="site-header">Site</div><div class="wrapper"><p>{LONG}</p><p>End</p></div><div class="page-footer">Foot</div>', [LONG, "End"]),
    (f'<body><div><div><p>{LONG}</p></div></div><div><p><a href=x>a link, long enough to count as one</a></p></div>', [LONG]),
    (f'<body><form id=all><article><p>{LONG}</p><form><p>Mail?</p></form><p>End</p></article></form>', [LONG, "End"]),
    (f'<article><p>{LONG}</p><aside>Side</aside><figure><img src=x><figcaption>A figure</figcaption></figure></article>', [LONG, "A figure"]),
    (f'<article><p>{LONG}</p><dl><dt>Term<dd>Meaning</dl><details><summary>Sum</summary>More</details></article>', [LONG, "Term", "Meaning", "Sum", "More"]),
    (f'<article class="post hidden-gems"><p>{LONG}</p><p hidden>Not seen</p><p style="display: none">Nor this</p></article>', [LONG]),
    (f'<div class="with-sidebar"><div class="text"><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p><p>{LONG}</p></div></div>', [LONG]),
    (f'<article><p>{LONG}</p><ul>{"".join(f"<li><a href={k}>source {k}</a>" for k in range(3))}</ul></article>', [LONG, "source 0", "source 1", "source 2"]),
    (f'<article><p>{LONG}</p></article><article><p>{LONG}</p></article>', [LONG, LONG]),
    (f'<article>Bare text <b>bold</b> and <a href=x>link</a><br>next<p>{LONG}</article>', ["Bare text bold and link next", LONG]),
    (f'<article><p>a &lt;b&gt; &#233; &eacute; &amp;amp;</p><p>{LONG}</p><script>"<p>no</p>"</script><style>p{{}}</style><!-- no --></article>', ["a <b> é é &amp;", LONG]),
    (f'<body role=main><p>{LONG}</p><div role="navigation">Menu</div><p>End</p>', [LONG, "End"]),
    ("<article><p>ok</p></article>", ["ok"]),
    (f'<article><table><tr><th>k<th>v<tr><td>a<td>b</table><p>{LONG}</p><div class="cookie-notice">Cookies</div></article>', ["k v", "a b", LONG]),
]


@pytest.mark.parametrize("page,blocks", KEPT)
def test_html_keeps_the_article(page, blocks):
    assert html.main_text(page) == "\n\n".join(" ".join(b.split()) for b in blocks)


def test_html_against_the_marked_article(spark):
    """Over the whole table: what stands between the article's tags, read by patterns alone."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) > 100
    for r in rows:
        inner = re.search(r"(?s)<article[^>]*>(.*?)</article>", r.html)[1]
        inner = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", inner)
        blocks = re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|section|blockquote|pre)\b[^>]*>", inner)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b), r.page_id


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(i, j) for i, j in rng.integers(200, 400, (120, 2)).tolist()]
    edges += [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in range(70):
        for a, b in edges:
            if a is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    import random

    import corpus_pipeline as p

    rng = random.Random(1)
    some = [a + b for a in "ba ce di fo gu na re to vi zu".split() for b in "l m nt r s st".split()]
    say = lambda n: " ".join(rng.choice(some) for _ in range(n)) + "."
    texts = {i: say(60) for i in range(200)}
    for i in range(0, 200, 8):
        texts[i] = " ".join(w + rng.choice(["***", "$$$"]) for w in texts[i].split())  # junk
    texts[11] = texts[3]  # a copy
    texts[13] = " ".join("zz" if k == 20 else w for k, w in enumerate(texts[5].split()))  # a near copy
    item = say(30)
    texts[15] += "\n" + item  # a leak
    texts[17] = None
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if i % 8 == 0 else 1, 0) for i in texts]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    junk = {i for i in range(0, 200, 8)}
    assert junk.isdisjoint(kept[0]) and len(kept[0]) >= 173
    assert kept[0] - kept[1] == {11}
    assert kept[1] - kept[2] == {13}
    assert kept[2] - kept[3] == {15}
    out = p.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == kept[3]


def test_pipeline_keeps_one_of_a_group(spark):
    import corpus_pipeline as p

    say = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, say(1), "a"), (1, say(1), "b"), (1, say(1), "a")]  # repeated rows
    rows += [(2, say(2), "a"), (2, say(2) + " more", "a"), (3, say(2), "a")]  # one id, two near texts
    rows += [(None, say(4), "a"), (None, say(4), "a"), (None, say(5), "a")]  # null ids only
    rows += [(6, say(6), "a"), (None, say(6), "a"), (7, say(7), "a"), (7, say(8), "a")]
    rows += [(9, None, "a"), (9, None, "a"), (9, "", "a")]  # in no group
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted(map(tuple, p.ngram_jaccard(spark, df, "").collect()), key=str)
    two = [r for r in got if r[0] == 2]
    assert len(two) == 1 and two[0] in rows
    want = [rows[0], rows[6], rows[8], rows[9], *rows[11:]]
    assert sorted((r for r in got if r[0] != 2), key=str) == sorted(want, key=str)


def test_pipeline_stages_take_any_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, clashing columns and no rows."""
    import corpus_pipeline as p

    types = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, score string, predicted int, kept string"
    good = lambda i: " ".join(f"w{i}x{k}" for k in range(9)) + "\n" + " ".join(f"v{i}y{k}" for k in range(9))
    rows = [(i, good(i), "en", None, 80, "r", i, "s", 1, None) for i in range(12)]
    rows += [rows[0], rows[0], (None, good(77), None, "s", None, None, None, None, None, "k"), (None, None, None, None, None, None, None, None, None, None), (13, "", "en", "s", 0, "r", 1, "s", 0, "k")]
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words of an item that stand in no document at all here"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = spark.createDataFrame(rows, types).repartition(3)
    for name, stage in p.STAGES:
        out = stage(spark, whole, str(tmp_path))
        got = out.collect()
        assert stage(spark, whole.limit(0), str(tmp_path)).count() == 0, name
        if name != p.STAGES[-1][0]:
            assert out.columns == whole.columns
        ids = [r.doc_id for r in got]
        lost = {"n-gram Jaccard join": 2}.get(name, 0)  # of three equal rows one stays
        if name != "best-fit packing":
            assert len(ids) == len(rows) - lost, name
        assert {*range(12), None, 13} == set(ids), name
