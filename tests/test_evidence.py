"""Every kind of problem, told once, and nothing where all is well."""

from quillstack.operators.evidence import problems

M = "file string, sha256 string, expected string"
R = M + ", verdict string, agreement double, anchor boolean, ord int"
A, B = "a" * 64, "b" * 64


def _told(spark, manifest, results):
    return sorted((tuple(r) for r in problems(spark.createDataFrame(manifest, M), spark.createDataFrame(results, R), "ord").collect()), key=repr)


def test_problems(spark):
    good = [("f1", A, "single-column", "admitted", 0.9, True, 0), ("f2", A, "scanned", "refused:pdf-scanned", None, None, 1), ("f3", A, "multi-column", "refused:pdf-multi-column", None, None, 2), ("f4", B, "borderline", "admitted", 1.0, True, 3)]
    manifest = [r[:3] for r in good]
    assert _told(spark, manifest, good) == []
    # Of two results of a file the last counts.
    assert _told(spark, manifest, [*good, ("f1", B, "scanned", "admitted", 0.0, False, -1)]) == []
    bad = [("f1", B, "borderline", "refused:pdf-scanned", None, None, 0), ("f2", A, "scanned", "admitted", 0.89, False, 1), ("f4", B, "borderline", "admitted", None, True, 3), ("g", A, "scanned", "admitted", 1.0, True, 4)]
    assert _told(spark, manifest, bad) == sorted([
        ("f1", "sha256"), ("f1", "expected-class"), ("f1", "classification"), ("f2", "classification"), ("f2", "low-agreement"), ("f2", "no-anchor"),
        ("f3", "no-result"), ("f4", "no-agreement"), ("g", "ghost"),
    ], key=repr)
    assert _told(spark, manifest, []) == [(None, "empty")]


def test_rows_without_their_form(spark):
    bad = [("f1", "A" * 64, "odd", "maybe", 1.5, True, 0), ("", A, "scanned", "refused:pdf-scanned", None, None, 1)]
    want = [("", "result-file"), ("f1", "manifest-class"), ("f1", "manifest-sha256"), ("f1", "result-agreement"), ("f1", "result-class"), ("f1", "result-sha256"), ("f1", "result-verdict"), (None, "manifest-file")]
    assert _told(spark, [("f1", None, None), (None, A, "scanned")], bad) == sorted(want, key=repr)
