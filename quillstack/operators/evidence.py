"""What is wrong with recorded results: constraints on a manifest and its evidence as rows of problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each class of document should come out as, and the agreement that an admitted one needs.
EXPECTED = {"single-column": "admitted", "borderline": "admitted", "scanned": "refused:pdf-scanned", "multi-column": "refused:pdf-multi-column"}
LEAST_AGREEMENT = 0.9
# Forms of a checksum and of a verdict.
CHECKSUM, VERDICT = "^[0-9a-f]{64}$", "^(admitted|refused:[a-z-]+)$"


def _told(rows: DataFrame, file: Column, rules: dict[str, Column]) -> DataFrame:
    """(file, problem): a row for each rule that a row breaks, all rules in one pass."""
    broken = F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())), lambda x: x.isNotNull())
    return rows.select(file.alias("file"), F.explode(broken).alias("problem"))


def malformed(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """(file, problem): rows of manifest (file, sha256, expected) and results (file, sha256, expected, verdict, agreement) that have not the
    form they should have."""
    col = F.col
    unnamed = F.coalesce(col("file"), F.lit("")) == ""
    checksum = ~F.coalesce(col("sha256").rlike(CHECKSUM), F.lit(False))
    unknown = ~F.coalesce(col("expected").isin(*EXPECTED), F.lit(False))
    verdict = ~F.coalesce(col("verdict").rlike(VERDICT), F.lit(False))
    share = F.isnan(col("agreement").cast("double")) | ~col("agreement").between(0, 1)
    of_manifest = _told(manifest, col("file"), {"manifest-file": unnamed, "manifest-sha256": checksum, "manifest-class": unknown})
    return of_manifest.unionByName(_told(results, col("file"), {"result-file": unnamed, "result-sha256": checksum, "result-class": unknown, "result-verdict": verdict, "result-agreement": share}))


def problems(manifest: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """(file, problem) of a manifest and its results; of several results of a file the last by `order` counts. No rows: all is well.

    Results without a row are one problem of no file; where rows have not their form only that is told. Else: no-result, sha256,
    expected-class, classification, no-agreement, low-agreement and no-anchor for files of the manifest, ghost for results of others.
    results: (file, sha256, expected, verdict, agreement, anchor).
    """
    if results.isEmpty():
        return results.sparkSession.createDataFrame([(None, "empty")], "file string, problem string")
    form = malformed(manifest, results)
    if not form.isEmpty():
        return form
    fields = ("sha256", "expected", "verdict", "agreement", "anchor")
    last = results.groupBy(F.col("file").alias("r_file")).agg(F.max_by(F.struct(*fields), F.col(order)).alias("r"))
    rows = manifest.join(last, F.col("file") == F.col("r_file"), "left")
    wanted = F.lit(None).cast("string")
    for kind, verdict in EXPECTED.items():
        wanted = F.when(F.col("expected") == kind, verdict).otherwise(wanted)
    there, admitted = F.col("r_file").isNotNull(), F.col("r.verdict") == "admitted"
    own = _told(rows, F.col("file"), {
        "no-result": ~there,
        "sha256": F.col("r.sha256") != F.col("sha256"),
        "expected-class": F.col("r.expected") != F.col("expected"),
        "classification": F.col("r.verdict") != wanted,
        "no-agreement": admitted & F.col("r.agreement").isNull(),
        "low-agreement": admitted & (F.col("r.agreement") < LEAST_AGREEMENT),
        "no-anchor": admitted & ~F.coalesce(F.col("r.anchor"), F.lit(False)),
    })
    ghosts = results.join(manifest.select(F.col("file").alias("m_file")), F.col("file") == F.col("m_file"), "left_anti").select("file", F.lit("ghost").alias("problem"))
    return own.unionByName(ghosts)
