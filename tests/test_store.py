"""A change of several tables is there as a whole or not at all, whichever step its writer dies at."""

import pytest
from pyspark.sql import functions as F

from quillstack.operators import portability
from quillstack.sources.store import Conflict, Store


class Killed(Exception):
    pass


def _content(store):
    return {name: sorted(tuple(r) for r in df.collect()) for name, df in store.tables().items()}


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, v string")


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "library"))
    store.apply({"articles": _rows(spark, (1, "a")), "notes": _rows(spark, (7, "n")), "settings": _rows(spark, (0, "light"))})
    return store


OLD = {"articles": [(1, "a")], "notes": [(7, "n")], "settings": [(0, "light")]}
NEW = {"articles": [(1, "a"), (2, "b")], "notes": [(7, "n"), (8, "m")], "settings": [(0, "light")]}


def _change(spark, store):
    now = store.tables()
    return {"articles": now["articles"].unionByName(_rows(spark, (2, "b"))), "notes": now["notes"].unionByName(_rows(spark, (8, "m")))}


@pytest.mark.parametrize("step", ["staged articles", "staged notes", "drafted", "committed"])
def test_a_reader_never_sees_a_mix(spark, store, step):
    def dies(done):
        assert _content(store) == (NEW if done == "committed" else OLD)
        if done == step:
            raise Killed

    with pytest.raises(Killed):
        store.apply(_change(spark, store), after=dies)
    assert _content(store) == (NEW if step == "committed" else OLD)
    gone = store.recover()
    assert _content(store) == (NEW if step == "committed" else OLD)
    assert len(gone) == {"staged articles": 1, "staged notes": 1, "drafted": 2, "committed": 0}[step]
    if step != "committed":
        assert store.apply(_change(spark, store)) == 2
    assert _content(store) == NEW and store.state()[0] == 2


def test_a_failing_table_leaves_the_others(spark, store):
    broken = _rows(spark, (9, "x")).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.apply({"articles": _rows(spark, (5, "z")), "notes": broken})
    assert _content(store) == OLD


def test_the_second_of_two_writers_fails(spark, store):
    def other_is_faster(done):
        if done == "drafted":
            Store(spark, store.root).apply({"notes": _rows(spark, (3, "c"))})

    with pytest.raises(Conflict):
        store.apply(_change(spark, store), after=other_is_faster)
    assert _content(store) == OLD | {"notes": [(3, "c")]}
    with pytest.raises(Conflict):
        store.apply(_change(spark, store), base=1)
    assert store.apply(_change(spark, store), base=2) == 3


def test_planned_rows(spark):
    stored = spark.createDataFrame([(1, 1, "old"), (2, 1, "keep"), (3, 1, "skip")], "a int, r int, v string")
    planned = spark.createDataFrame([(1, 1, "new", "replace"), (3, 1, "no", "skip"), (4, 1, "added", "add"), (9, 2, "both", "mint")], "a int, r int, v string, action string")
    assert sorted(tuple(r) for r in portability.after_import(stored, planned, ["a", "r"]).collect()) == [(1, 1, "new"), (2, 1, "keep"), (3, 1, "skip"), (4, 1, "added"), (9, 2, "both")]
