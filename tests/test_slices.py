"""Slices, outline headings, contents lists and front matter against plain Python and stated results."""

import random

from pyspark.sql import functions as F

from quillstack.operators import slices


def test_runs_cut_at_highlights(spark):
    runs = [("ab́c", "strong"), ("", "em"), ("defg", None)]
    blocks = spark.createDataFrame([(1, 0, 10, runs), (1, 1, 18, [("", "")]), (2, 0, 0, [("xy", "")]), (3, 0, None, None)], "k int, idx int, start long, runs array<struct<text string, marks string>>")
    marks = spark.createDataFrame([(1, "a", 5, 11), (1, "b", 12, 14), (1, "c", 13, 15), (1, "d", 12, 12), (4, "e", 0, 9), (None, "f", 0, 9)], "k int, id string, start long, `end` long")
    got = sorted(slices.highlighted_runs(blocks, marks, "k").collect(), key=lambda r: (r.k, r.idx, r.start))
    assert [(r.k, r.slice, r.start, r.len, r.highlight, r.marks, r.text) for r in got] == [
        (1, 0, 10, 1, "a", "strong", "a"),
        (1, 1, 11, 1, None, "strong", "b́"),
        (1, 2, 12, 1, "b", "strong", "c"),
        (1, 3, 13, 1, "b", None, "d"),
        (1, 4, 14, 1, "c", None, "e"),
        (1, 5, 15, 2, None, None, "fg"),
        (2, 0, 0, 2, None, "", "xy"),
    ]


def test_overlapping_equals_all_pairs(spark):
    rng = random.Random(3)
    make = lambda n: [(rng.randrange(3), i, s, s + rng.choice((0, 1, 7, 500))) for i, s in enumerate(rng.randrange(900) for _ in range(n))]
    a, b = make(60), make(50)
    df = [spark.createDataFrame(rows, "k int, id int, start long, `end` long") for rows in (a, b)]
    got = [(r.id, r.r_id) for r in slices.overlapping(*df, "k", cell=64).collect()]
    want = [(x[1], y[1]) for x in a for y in b if x[0] == y[0] and max(x[3], x[2] + 1) > y[2] and x[2] < max(y[3], y[2] + 1)]
    assert sorted(got) == sorted(want) and want


def test_sliced_blocks(spark):
    leaves = [(1, "0.0", "paragraph", 0, 10), (1, "0.1", "figure", 11, 15), (1, "0.2", "paragraph", 16, 16), (1, "0.3", "paragraph", 17, 30)]
    df = spark.createDataFrame([(*x, 0, 30) for x in leaves], "k int, path string, kind string, start long, `end` long, top_start long, top_end long")
    ranges = spark.createDataFrame([(1, 0, 4, 12), (1, 1, 12, 16), (1, 2, 15, 20), (1, 3, 0, 30), (2, 0, 0, 9)], "k int, range int, start long, `end` long")
    got = {(r.range, r.path): (r.start, r.end) for r in slices.sliced_blocks(df, ranges, "k").collect()}
    assert got == {
        (0, "0.0"): (4, 10), (0, "0.1"): (11, 15), (1, "0.1"): (11, 15), (2, "0.2"): (16, 16), (2, "0.3"): (17, 20),
        (3, "0.0"): (0, 10), (3, "0.1"): (11, 15), (3, "0.2"): (16, 16), (3, "0.3"): (17, 30),
    }


def _outline(paragraphs, targets):
    done = {}
    for _, y, level in sorted(targets, key=lambda t: t[0]):
        rest = [p for p in sorted(paragraphs) if p[0] not in done]
        if not rest:
            continue
        near = min(rest, key=lambda p: (abs(p[1] - y), p[0])) if y is not None else None
        if y is None:
            done[rest[0][0]] = level
        elif abs(near[1] - y) <= 1.5 * near[2]:
            done[near[0]] = level
        elif y >= max(p[1] for p in rest):
            done[rest[0][0]] = level
    return done


def test_outline_headings_equal_a_plain_loop(spark):
    rng = random.Random(5)
    paragraphs, targets = [], []
    for page in range(40):
        paragraphs += [(page, i, float(rng.randrange(0, 60, 4)), rng.choice((2.0, 4.0))) for i in range(rng.randrange(6))]
        targets += [(page, i, rng.choice((None, float(rng.randrange(70)))), rng.randrange(1, 4)) for i in range(rng.randrange(7))]
    p = spark.createDataFrame(paragraphs, "page int, pos int, y double, delta double")
    t = spark.createDataFrame(targets, "page int, ord int, y double, level int")
    got = {(r.page, r.pos): r.level for r in slices.outline_headings(p, t, "page").collect()}
    want = {(g, pos): level for g in range(40) for pos, level in _outline([x[1:] for x in paragraphs if x[0] == g], [x[1:] for x in targets if x[0] == g]).items()}
    assert got == want and want
    assert slices.outline_headings(p.limit(0), t, "page").count() == 0


def test_contents_of_both_kinds(spark):
    nav = '<ul><li><a href="x">no</a></li></ul><nav><h2>In</h2><ol><li><a href="a.xhtml">One <b>two</b></a><ol><li><a href="a.xhtml#s">Deep</a></li></ol></li><li><a>no target</a></li><li><span>Part</span><ol><li><a href="b.xhtml"> &amp; B </a></li></ol></li></ol></nav>'
    ncx = '<navMap><navPoint id="1"><navLabel><text>One</text></navLabel><content src="a.html"/><navPoint><navLabel><text>Sub</text></navLabel><content src="a.html#x"/></navPoint></navPoint><navPoint><navLabel><text> </text></navLabel><content src="b.html"/></navPoint></navMap>'
    df = spark.createDataFrame([(1, nav), (2, ncx), (3, None), (4, "")], "id int, doc string")
    got = sorted(tuple(r) for r in slices.contents_entries(df, "id", "doc").collect())
    assert got == [(1, 0, "One two", "a.xhtml", 1), (1, 1, "Deep", "a.xhtml#s", 2), (1, 2, "& B", "b.xhtml", 2), (2, 0, "One", "a.html", 1), (2, 1, "Sub", "a.html#x", 2)]


def test_front_matter(spark):
    texts = [
        "---\ntitle: A: b\nauthor: 'x'\n---\nbody", "---\r\ntitle: Plain # c\r\ndate: 2024-01-02\r\n---", "---\ntitle: [a]\nauthor: true\ndate: 12\n---\n\n# H\n---\n", "---\n---\nx", "no\n---\ntitle: t\n---\n",
        "---\ntitle: open", '---\ntitle: "#1 \\"q\\""\nauthor: ""\n---\n', None, "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", slices.front_matter(F.col("t")).alias("m"))
    got = {r.i: tuple(r.m) for r in df.collect()}
    assert got == {
        0: (None, "x", None, "body"),
        1: ("Plain", None, "2024-01-02", ""),
        2: (None, None, None, "\n# H\n---\n"),
        3: (None, None, None, "x"),
        4: (None, None, None, "no\n---\ntitle: t\n---\n"),
        5: (None, None, None, "---\ntitle: open"),
        6: ('#1 "q"', None, None, ""),
        7: (None, None, None, None),
        8: (None, None, None, ""),
    }
