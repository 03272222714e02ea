"""Debounced reading positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, at: str, value: str, gap: str = "800 milliseconds", late: str | None = None) -> DataFrame:
    """(key, first, last, n, value): one row for each burst of events without a pause of `gap`, with its newest value.

    Works on batches and, with `late` as the watermark, on streams.
    """
    rows = events.withWatermark(at, late) if late else events
    out = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), F.max_by(value, F.struct(at, value)).alias("value"))
    return out.drop("w")
