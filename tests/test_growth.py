"""Steps that go through their input once, and spread it, so that their work grows with the rows."""

import duckdb
from pyspark.sql import functions as F

from quillstack import registry
from quillstack.operators import assembly, headings, markdown_tree, offsets, page_blocks, pagination, portability, sanitize, shelf, slices


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_pages_are_assembled_in_one_pass(spark):
    items = spark.range(3).selectExpr("1 page", "id", "0D x", "-id * 100D y", "5D width", "12D size", "'f' family", "'a' text")
    df = assembly.assembled(items, ["page"], F.lit(12.0))
    assert _plan(df).count("Range (") == 1
    assert sorted((r.block, r.kind, r.page_top, r.y) for r in df.collect()) == [(0, "paragraph", True, 12.0), (1, assembly.NON_TEXT, False, -50.0), (2, "paragraph", False, -88.0), (3, assembly.NON_TEXT, False, -150.0), (4, "paragraph", False, -188.0)]


def test_headings_compose_documents_once_and_by_many_tasks(spark, sf_dir):
    df = registry.QUERIES["promoted_headings"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 2 and "Join" not in plan
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bodies_counted_by_page_equal_those_of_the_items(spark):
    rows = [(d, p, 10 * p + i, 0.0, -20.0 * i, 9.0, s, "f", t) for d in range(3) for p in range(2) for i, (s, t) in enumerate(((12.0, "a"), (9.0, "bb" * d), (9.004, ""), (0.0, "c" * 9 * (d == 2))))]
    items = spark.createDataFrame(rows, "doc int, page int, id long, x double, y double, width double, size double, family string, text string")
    want = {r.doc: r.body for r in headings.body_size(items, "doc").collect()}
    got = headings.with_bodies(assembly.assembled(items, ["doc", "page"], F.lit(12.0), "doc"), "doc")
    plain = assembly.assembled(items, ["doc", "page"], F.lit(12.0))
    assert {(r.doc, r.body) for r in got.collect()} == set(want.items()) and len(set(want.values())) == 3 - (want[0] == want[1])
    assert sorted(map(str, got.drop("body").collect())) == sorted(map(str, plain.collect()))


def _small_pages(spark):
    return spark.range(200, numPartitions=1).selectExpr("id page_id", "concat('<article><p>', id, '</p><script>x</script></article>') html")


def test_pages_are_read_once_and_by_many_tasks(spark):
    """A small file is one task's, and pages of it take long to read."""
    nodes = page_blocks.page_nodes(_small_pages(spark), attributes=True)
    assert nodes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (sanitize.sanitized(nodes), page_blocks.page_block_tree(nodes), page_blocks.inline_runs(nodes), page_blocks.footnote_bodies(nodes)):
        assert _plan(df).count("MapInArrow") == 1
    assert sorted((r.page_id, r.html, r.dropped) for r in sanitize.sanitized(nodes).collect())[7] == (7, "<p>7</p>", 1)


def test_markdown_is_read_by_many_tasks(spark):
    docs = spark.range(200, numPartitions=1).selectExpr("id doc_id", "concat('# ', id, '\\n\\n', repeat('a\\n\\n', 200)) text")
    rows = markdown_tree.markdown_tree(docs)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("idx").alias("last")).filter("n = 201 and last = 200").count() == 200


def test_maps_have_a_segment_only_where_something_changes(spark):
    docs = spark.createDataFrame([(1, ["one two  three four five", "six seven"])], "k int, runs array<string>")
    rows = offsets.raw_to_normalized(docs, "k", "runs").orderBy("lo").collect()
    # Up to the first of two spaces, the second one, the rest of the run, the run that is set off by a space, and the end.
    assert [(r.lo, r.hi, r.to, r.num) for r in rows] == [(0, 8, 0, 1), (8, 9, 8, 0), (9, 24, 8, 1), (24, 33, 24, 1), (33, None, 33, 0)]


def test_maps_are_turned_and_joined_with_one_exchange_a_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    docs = spark.createDataFrame([(1, ["a  b"], "a  b")], "k int, runs array<string>, t string")
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    try:
        units, norm = offsets.clusters_to_units(docs, "k", "t"), offsets.raw_to_normalized(docs, "k", "runs")
        assert dealt(offsets.inverse(norm, "k")) == dealt(norm)
        assert dealt(offsets.joined(offsets.inverse(units, "k"), norm, "k")) <= dealt(units) + dealt(norm) + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_maps_are_dealt_once_for_all_their_uses(spark, sf_dir):
    plan = registry.QUERIES["offset_maps"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 5 and plan.count("ENSURE_REQUIREMENTS") <= 3


def test_lines_of_one_price_give_the_same_paragraphs_in_any_order_of_the_rows(spark, tmp_path):
    rows = [(o, n, 5.0, float(q), "R", s) for o in range(20) for n, (q, s) in enumerate(((50, "A"), (10, "B"), (40, "C"), (1, "D")))]
    found = []
    for name, own in (("a", rows), ("b", rows[::-1]), ("c", sorted(rows, key=lambda r: r[3]))):
        spark.createDataFrame(own, "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        found.append(sorted(tuple(r) for r in registry.QUERIES["line_paragraphs"](spark, f"{tmp_path}/{name}").collect()))
    assert found[0] == found[1] == found[2] and found[0]


_LINES = "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_returnflag string, l_linestatus string"


def test_lines_of_one_price_and_number_give_the_same_paragraphs_in_any_order_of_the_rows(spark, tmp_path):
    rows = [(o, 1, 5.0, float(q), "R", s) for o in range(20) for q, s in ((50, "A"), (10, "B"), (40, "C"), (1, "D"))]
    found = []
    for name, own in (("a", rows), ("b", rows[::-1]), ("c", sorted(rows, key=lambda r: r[3]))):
        spark.createDataFrame(own, _LINES).coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        found.append(sorted(tuple(r) for r in registry.QUERIES["line_paragraphs"](spark, f"{tmp_path}/{name}").collect()))
    assert found[0] == found[1] == found[2] and found[0]


def test_lines_without_price_quantity_or_text_are_put_as_the_sql_puts_them(spark, tmp_path):
    rows = [(1, 1, None, 9.0, "R", "A"), (1, 2, 5.0, 30.0, "R", "B"), (1, 3, 7.0, 50.0, "N", "C"), (2, 1, 3.0, 1.0, None, "A"), (2, 2, 4.0, None, "R", "B"), (2, 3, 6.0, 40.0, "R", "C"), (3, 1, 1.0, 2.0, "R", None), (None, 1, 2.0, 3.0, "A", "A")]
    spark.createDataFrame(rows, _LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = duckdb.execute(registry.ORACLE_SQL["line_paragraphs"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, registry.QUERIES["line_paragraphs"](spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_conflicts_are_counted_without_sorting_them_all(spark):
    rows = spark.range(1000, numPartitions=4).selectExpr("'note-id' kind", "(id * 7) % 1000 ord", "cast((id * 7) % 1000 as string) id")
    df = portability.conflict_summary([rows, rows.limit(0), spark.sql("select 'book' kind, -2L ord, '-2' id")])
    assert "WindowGroupLimit" not in _plan(df) and "Sort [" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.place, r.kind, r.n, r.sample) for r in df.collect()) == [(0, "book", 1, "-2"), (4, "note-id", 1000, "0,1,2,3,4")]


def test_lines_are_dealt_to_as_many_tasks_as_there_may_be(spark):
    df = shelf.line_runs(spark.range(500).selectExpr("id % 50 line", "id x", "1L w"), ["line"], "x", "w", 40)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.run, r.n) for r in df.collect()} == {(i, 1) for i in range(10)}


def test_cut_runs_travel_as_texts(spark):
    """A row for each cluster, or an array of them, is many times the text."""
    text = "ab" * 40
    lines = spark.createDataFrame([(1, 0, 0, [(text, "strong"), ("", "x"), ("é" * 10, "")])], "k int, idx int, start long, runs array<struct<text:string,marks:string>>")
    marked = spark.createDataFrame([(1, 7, 70, 85)], "k int, id int, start long, end long")
    df = slices.highlighted_runs(lines, marked, "k")
    assert "flat#" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.slice, r.start, r.len, r.highlight, r.marks, r.text) for r in df.collect())
    assert got == [(0, 0, 70, None, "strong", text[:70]), (1, 70, 10, 7, "strong", text[70:]), (1, 80, 5, 7, "", "é" * 5), (2, 85, 5, None, "", "é" * 5)]


def test_repair_packs_once(spark):
    docs = spark.range(5).selectExpr("id k", "array(named_struct('idx', 0, 'lines', 3, 'line_height', 20D, 'margin_before', 0D, 'margin_after', 0D, 'splits', true)) m", "array(named_struct('idx', 0, 'lines', 4, 'line_height', 20D, 'margin_before', 0D, 'margin_after', 0D, 'splits', true)) t")
    pages = pagination.paginate(docs, "k", "m", 60.0)
    df = pagination.repaired(pages, docs, "k", "t", 60.0)
    assert _plan(df).count("MapInArrow") <= 2  # the packing of what overflows, for its rows and its failures
    assert sorted((r.k, r.page, r.from_line, r.to_line) for r in df.filter("k = 3").collect()) == [(3, 0, 0, 2), (3, 1, 2, 4)]
