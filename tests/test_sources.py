"""Small cases of source formats and shelves with known answers."""

from pyspark.sql import functions as F

from quillstack.operators import markdown, page_blocks, shelf


def test_markdown_blocks(spark):
    text = "# Title #\n\nfirst\nsecond\n\n> quoted\nlazy\n\n- one\n\n- two\n---\n```py\ncode\n\n  more\n```\n![alt](https://x/y.png)\nend"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = [tuple(r)[1:] for r in markdown.markdown_blocks(docs).orderBy("doc_id", "idx").collect()]
    assert rows == [
        (0, "heading", 1, "Title"),
        (1, "paragraph", None, "first second"),
        (2, "quote", None, "quoted lazy"),
        (3, "list", None, "one\ntwo"),
        (4, "code", None, "code\n\n  more"),
        (5, "figure", None, "alt"),
        (6, "paragraph", None, "end"),
    ]


HTML = """<html><body><div><p>menu</p></div><article><h2>A &amp; B</h2><p>One <b>bold</b> <i>text</i></p><p></p><nav role="navigation"><p>skip</p></nav>
<pre>x  y</pre><img src="https://a/b.png" alt="pic"><img src="data:1"><table><tr><td>t</td></tr></table><script>no()</script></article></body></html>"""


def test_page_blocks(spark):
    pages = spark.createDataFrame([(1, HTML), (2, "<body><p>only</p></body>"), (3, ""), (4, None)], "page_id long, html string")
    nodes = page_blocks.page_nodes(pages)
    rows = [tuple(r) for r in page_blocks.page_blocks(nodes).orderBy("page_id", "idx").collect()]
    assert rows == [
        (1, 0, "heading", 2, "A & B"),
        (1, 1, "paragraph", None, "One bold text"),
        (1, 2, "code-block", None, "x  y"),
        (1, 3, "figure", None, "pic"),
        (1, 4, "unsupported", None, "img"),
        (1, 5, "unsupported", None, "table"),
        (2, 0, "paragraph", None, "only"),
    ]
    runs = page_blocks.inline_runs(nodes).filter("page_id = 1").orderBy("leaf", "run").collect()
    assert [(r.marks, r.text) for r in runs if r.text[0] in "Obt "] == [("", "One "), ("strong", "bold"), ("", " "), ("em", "text"), ("", "t")]


def test_runs_keep_inner_spaces_and_link_targets(spark):
    html = '<article><p> \n<b> </b>a <b>b</b> c<br>d <a href="https://x.org/1">l<i>1</i></a><a href="mailto:m@x.org">m</a> <a href="javascript:no()">plain</a>\u00a0 <em> </em></p></article>'
    nodes = page_blocks.page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = [(r.marks, r.href, r.text) for r in page_blocks.inline_runs(nodes).orderBy("leaf", "run").collect()]
    assert got == [
        ("", "", "a "), ("strong", "", "b"), ("", "", " c d "), ("link", "https://x.org/1", "l"), ("link,em", "https://x.org/1", "1"), ("link", "mailto:m@x.org", "m"), ("", "", " plain "),
    ]


def test_content_goes_selector_by_selector(spark):
    first = lambda html: [r.text for r in page_blocks.page_blocks(page_blocks.page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))).collect()]
    # An article inside another root, and one root behind another.
    assert first('<div id="content"><p>outer</p><article><p>inner</p></article></div>') == ["inner"]
    assert first('<div id="content"><p>c</p></div><div id="readability-page-1"><p>r</p></div>') == ["r"]
    # Only the first of each counts: a blank one leaves the place to the next selector.
    assert first('<article> </article><article><p>second</p></article><main><p>m</p></main>') == ["m"]
    assert first('<div role="main"><p>x</p></div><p>y</p>') == ["x"]
    assert first("<article></article><p>all</p>") == ["all"]


def test_href(spark):
    hrefs = ["a/../b%20c.html#x", "../../d.html", "./e+f", "bad%zz", None]
    rows = spark.createDataFrame([(h,) for h in hrefs], "h string").select(shelf.normalized_href(F.col("h")).alias("n")).collect()
    assert [r.n for r in rows] == ["b c.html", "d.html", "e+f", "bad%zz", None]
    nested = spark.createDataFrame([("text/a.html", "OEBPS"), ("../b.html", "OEBPS/nav"), ("../../../c.html", "x"), ("d.html", ""), ("e.html", None)], "h string, b string")
    rows = nested.select(shelf.normalized_href(F.col("h"), F.col("b")).alias("n")).collect()
    assert [r.n for r in rows] == ["OEBPS/text/a.html", "OEBPS/b.html", "c.html", "d.html", "e.html"]


def test_contents_of_a_nested_package(spark):
    toc = spark.createDataFrame([(1, 0, "One", "../text/a.html#x", "OEBPS/nav")], "book int, ord int, label string, href string, base string")
    manifest = spark.createDataFrame([(1, "i1", "text/a.html", "OEBPS")], "book int, item string, href string, base string")
    spine = spark.createDataFrame([(1, "i1", 4)], "book int, item string, pos int")
    assert [(r.label, r.pos) for r in shelf.toc_targets(toc, manifest, spine).collect()] == [("One", 4)]


def test_empty_ranges_block_nothing(spark):
    new = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("b", 2, 3)], "k string, s long, e long")
    old = spark.createDataFrame([("a", 4, 6), ("b", 2, 2), ("b", 3, 4)], "k string, s long, e long")
    assert [tuple(r) for r in shelf.disjoint(new, old, "k", "s", "e").collect()] == [("b", 2, 3)]


def test_quotes_lists_and_footnotes(spark):
    html = (
        "<article><blockquote>Bare <em>words</em></blockquote><blockquote><p>In p</p>loose</blockquote><ul><p>beside</p><li>no block</li><li><p>One</p><p>Two</p></li></ul>"
        '<ol start="4"><li><blockquote><p>Deep</p></blockquote></li></ol><div><sup class="reference">[a]</sup><sup class="footnote">7</sup><sup class="footnote"></sup></div><p>Text<sup class="reference">1</sup></p>'
        '<div class="references"><ol><li>First <b>note</b></li><li> </li><li><p>Third</p></li></ol></div></article><section id="notes"><ol><li>Fourth</li></ol></section><ol><li>none</li></ol>'
    )
    nodes = page_blocks.page_nodes(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"))
    got = [("/".join(b.kind for b in r.boxes), r.kind, r.text, r.footnote_id) for r in page_blocks.page_block_tree(nodes).orderBy("idx").collect()]
    assert got == [
        ("", "paragraph", "Bare words", None),
        ("blockquote", "paragraph", "In p", None),
        ("bulleted-list/item", "paragraph", "One", None),
        ("bulleted-list/item", "paragraph", "Two", None),
        ("numbered-list/item/blockquote", "paragraph", "Deep", None),
        ("", "footnote-reference", "[a]", "fn-1"),
        ("", "footnote-reference", "7", "fn-7"),
        ("", "footnote-reference", "[3]", "fn-3"),
        ("", "paragraph", "Text1", None),
        ("numbered-list/item", "paragraph", "Third", None),
    ]
    starts = {b.start for r in page_blocks.page_block_tree(nodes).collect() for b in r.boxes if b.kind == "numbered-list"}
    assert starts == {4, 1}
    bodies = sorted(tuple(r) for r in page_blocks.footnote_bodies(nodes).collect())
    assert bodies == [(1, "fn-1", "First note"), (1, "fn-3", "Third"), (1, "fn-4", "Fourth")]
    assert page_blocks.footnote_bodies(nodes, most=1).count() == 1
