"""Stages of the pipeline over awkward tables: each keeps the columns of its input, and crashes on none."""

import corpus_pipeline as P
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = " ".join(f"word{i} and" for i in range(60)) + "."


@pytest.fixture
def labels(spark, tmp_path):
    """A folder with a table of labels, which the first stage reads."""
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def _through(spark, docs, folder):
    seen = []
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if i < len(P.STAGES) - 1:
            assert out.columns == docs.columns
            place = f"{folder}/stage{i}"
            out.write.parquet(place)
            docs = out = spark.read.parquet(place)
        seen.append(out)
    return seen


def test_an_empty_table_goes_through(spark, labels):
    assert [df.count() for df in _through(spark, spark.createDataFrame([], SCHEMA), labels)] == [0] * 5


def test_nulls_repeated_ids_and_clashing_columns(spark, labels):
    rows = [(1, GOOD, "en", "a", 9), (2, GOOD, "en", "a", 9), (2, GOOD + " other words at the end", None, None, None), (None, GOOD.replace("word", "term"), "en", "b", 1), (4, None, "en", "b", 0), (5, "", None, "c", 0), (6, "short", "en", "c", 5)]
    rows += [(i, GOOD.replace("word", f"w{i}x"), "de", "b", 5) for i in range(10, 30)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as kept", "1 as q", "true as base_failed", "7 as size", "'y' as id").repartition(3)
    first, near, cut, mixed, encoded = _through(spark, docs, labels)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert not ids(first) & {4, 5, 6} and {1, 2, 10} <= ids(first)
    assert 1 in ids(near) and 2 not in ids(near) and None in ids(near) and set(range(10, 30)) <= ids(near)
    assert {(r.id, r.size) for r in near.collect()} == {("y", 7)}
    assert ids(cut) == ids(near) and ids(mixed) <= ids(cut) and ids(encoded) == ids(mixed)
    assert all(r.n_chars == len(r.text) for r in mixed.collect())
