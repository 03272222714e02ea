"""Quote selectors: deriving them from positions and finding them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grapheme_count, graphemes

RADIUS, SLACK = 32, 16


def derive(df: DataFrame, clusters: str, start: Column, end: Column, radius: int = RADIUS) -> DataFrame:
    """Adds prefix, exact and suffix of [start, end) in a column of grapheme clusters."""
    piece = lambda a, b: F.array_join(F.slice(F.col(clusters), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "")
    size = F.size(clusters)
    return df.withColumns({
        "prefix": piece(F.greatest(start - radius, F.lit(0)), start),
        "exact": piece(start, end),
        "suffix": piece(end, F.least(end + radius, size)),
    })


def occurrences(clusters: Column, needle: Column) -> Column:
    """Starts at which the needle's clusters stand, overlaps included; none for an empty needle."""
    n, m = F.size(clusters), F.size(needle)
    hits = F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda i: F.slice(clusters, i + 1, m) == needle)
    return F.when((m == 0) | (m > n), F.array().cast("array<int>")).otherwise(hits)


def exact_hits(text: Column, exact: Column, clusters: Column, needle: Column) -> Column:
    """occurrences(clusters, needle), found in the text where that tells: no hit, or a single one that begins and ends with clusters.

    Only texts in which the quote stands several times, or inside a cluster, are searched cluster by cluster.
    """
    none = F.array().cast("array<int>")
    first = F.call_function("locate", exact, text)
    again = F.call_function("locate", exact, text, first + 1)
    at = grapheme_count(F.substring(text, F.lit(1), first - 1))
    whole = F.slice(clusters, at + 1, F.size(needle)) == needle
    return F.when(F.size(needle) == 0, none).when(first == 0, none).when((again == 0) & whole, F.array(at)).otherwise(occurrences(clusters, needle))


def resolve(df: DataFrame, text_col: str = "text", hint: Column | None = None) -> DataFrame:
    """Adds status (confident, ambiguous, orphan), at and until for selectors (prefix, exact, suffix).

    One exact match is confident whatever the hint says. Several are told apart by both contexts or are ambiguous.
    Without any, a passage between prefix and suffix counts, if one, or the one nearest to the hint; else it is
    an orphan. Work columns start with an underscore and are dropped.
    """
    out = df.withColumns({"_c": graphemes(F.col(text_col)), "_p": graphemes(F.col("prefix")), "_e": graphemes(F.col("exact")), "_s": graphemes(F.col("suffix"))})
    out = out.withColumn("_hits", exact_hits(F.col(text_col), F.col("exact"), F.col("_c"), F.col("_e")))
    m = F.size("_e")
    before = lambda i: F.slice("_c", F.greatest(i - F.size("_p"), F.lit(0)) + 1, F.least(i, F.size("_p"))) == F.col("_p")
    after = lambda i: F.slice("_c", i + m + 1, F.size("_s")) == F.col("_s")
    out = out.withColumn("_told", F.filter("_hits", lambda i: before(i) & after(i)))
    # Only where no exact match is left: the first suffix behind each prefix, not touching it.
    lost = (F.size("_hits") == 0) & (F.size("_p") > 0) & (F.size("_s") > 0)
    none = F.array().cast("array<int>")
    out = out.withColumn("_ps", F.when(lost, occurrences(F.col("_c"), F.col("_p"))).otherwise(none)).withColumn("_ss", F.when(lost, occurrences(F.col("_c"), F.col("_s"))).otherwise(none))
    reach = m + F.greatest(F.lit(SLACK), m)

    def passage(i):
        start = i + F.size("_p")
        end = F.array_min(F.filter("_ss", lambda s: (s >= start) & (s <= start + reach)))
        return F.struct(start.alias("at"), end.alias("until"))

    out = out.withColumn("_found", F.filter(F.transform("_ps", passage), lambda x: x["until"] > x["at"]))
    if hint is not None:
        ranked = F.array_sort(F.transform("_found", lambda x: F.struct(F.abs(x["at"] - hint).alias("d"), x["at"].alias("at"), x["until"].alias("until"))))
        near = F.when((F.size("_found") > 1) & (F.get(ranked, F.lit(0))["d"] < F.get(ranked, F.lit(1))["d"]), F.struct(ranked[0]["at"].alias("at"), ranked[0]["until"].alias("until")))
    else:
        near = F.lit(None).cast("struct<at:int,until:int>")
    exact = F.when(F.size("_hits") == 1, F.get("_hits", F.lit(0))).when((F.size("_hits") > 1) & (F.size("_told") == 1), F.get("_told", F.lit(0)))
    place = F.when(exact.isNotNull(), F.struct(exact.alias("at"), (exact + m).alias("until"))).when((F.size("_hits") == 0) & (F.size("_found") == 1), F.get("_found", F.lit(0))).when(F.size("_hits") == 0, near)
    out = out.withColumn("_place", place)
    status = F.when(F.col("_place").isNotNull(), "confident").when(F.size("_hits") > 1, "ambiguous").otherwise("orphan")
    return out.withColumns({"status": status, "at": F.col("_place.at"), "until": F.col("_place.until")}).drop("_c", "_p", "_e", "_s", "_hits", "_told", "_ps", "_ss", "_found", "_place")
