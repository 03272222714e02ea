"""Repairing pages from the first overflow on gives what packing everything again gives."""

import random

from pyspark.sql import functions as F

from quillstack.operators import pagination as P

SCHEMA = "k int, thought array<struct<idx:int,lines:int,line_height:double,margin_before:double,margin_after:double,splits:boolean>>, found array<struct<idx:int,lines:int,line_height:double,margin_before:double,margin_after:double,splits:boolean>>"


def _doc(rng, k):
    thought = [(i, rng.randrange(1, 14), rng.choice((20.0, 24.0)), rng.choice((0.0, 12.0)), rng.choice((0.0, 16.0)), rng.random() < 0.8) for i in range(rng.randrange(1, 30))]
    grows = rng.choice((0.0, 0.1, 0.5))
    found = [(i, n + (rng.randrange(1, 6) if rng.random() < grows else 0), h, b, a, s) for i, n, h, b, a, s in thought]
    return k, thought, found


def test_repair_equals_packing_again(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([_doc(rng, k) for k in range(300)], SCHEMA).repartition(3).cache()
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    first = P.paginate(docs, "k", "thought", 400.0, reserve=60.0).cache()
    got = rows(P.repaired(first, docs, "k", "found", 400.0, reserve=60.0, tolerance=0.5))
    # A document that could not be paged at first is not paged by a repair either.
    unpaged = {r[0] for r in first.collect() if r[1] < 0}
    now = P.remeasured(first, docs, "k", "found")
    over = {r.k for r in P.page_fill(now, "k").collect() if r.height > (340.5 if r.page == 0 else 400.5)}
    everything = rows(P.paginate(docs, "k", "found", 400.0, reserve=60.0))
    stay = [tuple(r) for r in now.select(*first.columns).collect() if r.k not in over]
    want = sorted([r for r in everything if r[0] in over] + stay, key=repr)
    assert [r for r in got if r[0] not in unpaged] == want
    assert {r for r in got if r[0] in unpaged} == {r for r in rows(first) if r[0] in unpaged}
    assert len({r[0] for r in set(want) - set(rows(first))}) > 50


def test_only_what_follows_is_packed_again(spark):
    block = lambda i, n: (i, n, 20.0, 0.0, 0.0, True)
    docs = spark.createDataFrame([(1, [block(0, 20), block(1, 10), block(2, 10)], [block(0, 20), block(1, 12), block(2, 10)]), (2, [block(0, 5)], [block(0, 5)]), (3, [block(0, 5)], [block(0, 5000)])], SCHEMA)
    first = P.paginate(docs, "k", "thought", 400.0)
    now = P.remeasured(first, docs, "k", "found")
    assert sorted((r.k, r.page, r.height) for r in P.page_fill(now, "k").collect()) == [(1, 0, 400.0), (1, 1, 440.0), (2, 0, 100.0), (3, 0, 100000.0)]
    got = sorted(tuple(r) for r in P.repaired(first, docs, "k", "found", 400.0).collect() if r.k != 3)
    assert got == [(1, 0, 0, 0, 20, ""), (1, 1, 1, 0, 12, ""), (1, 1, 2, 0, 8, ""), (1, 2, 2, 8, 10, ""), (2, 0, 0, 0, 5, "")]
    assert [tuple(r) for r in P.repaired(first, docs, "k", "found", 400.0).collect() if r.k == 3] == [(3, -1, None, None, None, "too-many-pages")] or P.MOST_PAGES * 20 >= 5000
