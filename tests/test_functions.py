import random

from pyspark.sql import functions as F

from quillstack.functions import text as fn
from quillstack.operators import anchors, library, pagination


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).head().y


def test_urls(spark):
    assert _one(spark, "HTTPS://Www.Example.com:443/a/b_c.html?b=2&utm_source=q&a=1#top", fn.clean_url) == "https://www.example.com/a/b_c.html?a=1&b=2"
    assert _one(spark, "http://example.com/a/b_c.html?x=1", fn.url_slug) == "example-com-a-b-c-html"
    assert _one(spark, "http://example.com/" + "a" * 90, fn.url_slug).startswith("u-")


def test_entry_names(spark):
    for name, safe in {"a/b.txt": True, "../a": False, "a/../../b": False, "/a": False, "a/../b": True, "C:x": False, "a\\b": False, "a/nul.txt": False, "..%2F..%2Fa": False, ".": False}.items():
        assert _one(spark, name, fn.safe_entry_name) is safe, name


def test_markdown_lines(spark):
    for line, want in {"# a": "\\# a", "**b": "\\*\\*b", "12. c": "12\\. c", "plain": "plain", "": ""}.items():
        assert _one(spark, line, fn.escape_markdown_line) == want


def test_addresses(spark):
    for ip, private in {"10.1.2.3": True, "172.32.0.1": False, "::ffff:192.168.0.1": True, "8.8.8.8": False, "300.1.1.1": False, "": False}.items():
        assert _one(spark, ip, fn.is_private_v4) is private


def test_addresses_of_both_kinds(spark):
    for ip, private in {"::1": True, "0:0:0:0:0:0:0:1": True, "fc00::1": True, "fd12:3::": True, "fe80::1": True, "fec0::1": False, "ff02::1": True, "2001:db8::1": False, "::ffff:7f00:1": True, "::ffff:808:808": False, "10.0.0.1": True, "": False, "0:0:0:0:0:ffff:a00:1": True, "0:0:0:0:0:ffff:10.0.0.1": True, "::FFFF:10.0.0.1": True, "0:0:0:0:0:ffff:808:808": False, "::ffff:0:a00:1": False, "1::2::3": False, "fe80::1%eth0": True, "1:2:3:4:5:6:7": False, "2001:db8:0:0:0:ffff:a00:1": False}.items():
        assert _one(spark, ip, fn.is_private_address) is private, ip


def test_graphemes(spark):
    for text, want in {"": [], "abc": ["a", "b", "c"], "e\u0301x": ["e\u0301", "x"], "a\r\nb": ["a", "\r\n", "b"], "\U0001f468\u200d\U0001f469z": ["\U0001f468\u200d\U0001f469", "z"]}.items():
        assert _one(spark, text, fn.graphemes) == want and _one(spark, text, fn.grapheme_count) == len(want)


def test_resolving_quotes(spark):
    rows = [
        ("abcabc xyz", "", "xyz", "", "confident", 7),
        ("abcabc xyz", "", "abc", "", "ambiguous", None),
        ("abcabc xyz", "abc", "abc", " xy", "confident", 3),
        ("aaaa", "", "aa", "", "ambiguous", None),
        ("xe\u0301 e", "", "e", "", "confident", 3),
        ("one TWO three", "one ", "two", " three", "confident", 4),
        ("one two three", "", "four", "", "orphan", None),
        ("", "a", "b", "c", "orphan", None),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, text string, prefix string, exact string, suffix string")
    got = {r.i: (r.status, r["at"]) for r in anchors.resolve(df).collect()}
    assert got == {i: r[4:] for i, r in enumerate(rows)}


def test_nearest_rank(spark):
    random.seed(3)
    rows = [(k, random.randint(0, 6) * 1.0) for k in range(4) for _ in range(random.randint(1, 30))]
    got = {r.k: r.p for r in library.nearest_rank(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", 0.95).collect()}
    for k in range(4):
        own = sorted(v for g, v in rows if g == k)
        assert got[k] == own[min(len(own) - 1, int(0.95 * len(own)))]


def test_pages_tile_documents_within_their_height(spark):
    rows = [(g, [(i, 1 + (7 * i + g) % 23, 20.0, 10.0, 15.0, i % 5 != 0 or (7 * i + g) % 23 < 5) for i in range(30)]) for g in range(6)]
    df = spark.createDataFrame(rows, "g long, b array<struct<idx:int,lines:int,line_height:double,margin_before:double,margin_after:double,splits:boolean>>")
    got = pagination.paginate(df, "g", "b", 400.0).collect()
    for g, own in rows:
        mine = sorted((r.idx, r.from_line, r.to_line, r.page) for r in got if r.g == g and r.page >= 0)
        if not mine:
            assert [r.reason for r in got if r.g == g] == ["oversized-atomic-block"]
            continue
        assert {i: [(a, b) for j, a, b, _ in mine if j == i] for i, *_ in own}.keys() == {i for i, *_ in mine}
        for i, lines, *_, splits in own:
            cuts = [(a, b) for j, a, b, _ in mine if j == i]
            assert [a for a, _ in cuts] + [lines] == [0] + [b for _, b in cuts]
            assert len(cuts) == 1 or (splits and all(b - a >= 2 for a, b in cuts))
        for page in {p for *_, p in mine}:
            assert sum(b - a for _, a, b, p in mine if p == page) * 20.0 <= 400.0
    tall = spark.createDataFrame([(1, [(0, 30, 20.0, 0.0, 0.0, False)]), (2, []), (3, None)], df.schema)
    assert {(r.g, r.page, r.reason) for r in pagination.paginate(tall, "g", "b", 400.0).collect()} == {(1, -1, "oversized-atomic-block")}


def test_blocks_have_running_offsets(spark):
    from quillstack.operators.blocks import offset_blocks

    texts = ["\n".join(f" l {i}\t{'x' * (i % 7)} " if i % 3 else "\u00a0 " for i in range(n)) for n in (0, 1, 2, 64, 65, 200)] + [None, "\n\n"]
    got = {}
    for r in offset_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.idx, r.text, r.len, r.start))
    for i, t in enumerate(texts):
        want, at = [], 0
        for line in (" ".join(x.split()) for x in (t or "").split("\n")):
            if line:
                want.append((len(want), line, len(line), at))
                at += len(line) + 1
        assert sorted(got.get(i, [])) == want


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_previous_positions_come_from_ranges(spark, sf_dir):
    from quillstack.operators.blocks import with_previous
    from quillstack.plans.queries import modal_line_gap

    positions = [-9, -4, -4, 0, 3, 4, 4, 11, 40, 41, 99]
    rows = [(g, p) for g in ("a", "b", None) for p in positions[len(g or "") :]] + [("a", None)]
    got = with_previous(spark.createDataFrame(rows, "g string, p long"), "g", "p", 4).collect()
    want = [(g, p, q) for g in ("a", "b", None) for p, q in zip(positions[len(g or "") :], [None, *positions[len(g or "") :]])]
    assert sorted(map(tuple, got), key=repr) == sorted([*want, ("a", None, None)], key=repr)
    assert "_range" in modal_line_gap(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
