"""Packing measured blocks into pages of one height, with splits inside blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written
from .layout import WIDOW_LINES

MOST_PAGES = 300
_FIELDS = ("idx", "lines", "line_height", "margin_before", "margin_after", "splits")


def _room(page: int, page_height: float, reserve: float) -> float:
    """What a page holds: the first one leaves room for the reserve, but keeps a quarter at least."""
    return page_height if page else page_height - min(reserve, 0.75 * page_height)


def _pack(blocks: list[dict], page_height: float, atomic_share: float, reserve: float, page: int = 0, first_line: int = 0) -> tuple[list[tuple], str]:
    """(page, idx, first line, last line) of one document, or the reason for not paging it; from the given page and line on."""
    out, used, margin = [], 0.0, 0.0
    room = _room(page, page_height, reserve)
    for n, b in enumerate(blocks):
        line, start = b["line_height"], 0 if n else first_line
        if not b["splits"] and b["lines"] * line > atomic_share * page_height:
            return [], "oversized-atomic-block"
        if line > page_height:
            return [], "line-taller-than-page"
        while start < b["lines"]:
            # Margins of neighbours collapse to the larger; a page begins with the block's own.
            top = max(margin, b["margin_before"]) if used else (b["margin_before"] if start == 0 else 0.0)
            left, rest = b["lines"] - start, room - used - top
            if left * line <= rest:
                out.append((page, b["idx"], start, b["lines"]))
                used, margin, start = used + top + left * line, b["margin_after"], b["lines"]
                continue
            fit = int(rest // line) if rest > 0 else 0
            if b["splits"] and left >= 2 * WIDOW_LINES and fit >= WIDOW_LINES:
                fit = min(fit, left - WIDOW_LINES)
                out.append((page, b["idx"], start, start + fit))
                start += fit
            elif not used:  # an empty page that still cannot hold it takes what fits, one line at least
                fit = max(1, min(fit, left))
                out.append((page, b["idx"], start, start + fit))
                start += fit
            page, used, margin, room = page + 1, 0.0, 0.0, page_height
            if page >= MOST_PAGES:
                return [], "too-many-pages"
    return out, ""


def paginate(docs: DataFrame, group: str, blocks: str, page_height: float, atomic_share: float = 0.75, reserve: float = 0.0) -> DataFrame:
    """(group, page, idx, from_line, to_line, reason): which lines of which block stand on which page.

    docs has an array `blocks` of structs idx, lines, line_height, margin_before, margin_after, splits. A block that splits leaves
    at least WIDOW_LINES lines on either page; others move whole. A document that cannot be paged (a block that does not split and is taller than
    atomic_share of a page, a line taller than a page, more than MOST_PAGES pages) gives one row with page -1 and the reason. The
    fill of a page depends on where the last one ended, so a document is one fold over its own row: no shuffle.
    """

    return _packed(docs, group, blocks, page_height, atomic_share, reserve)


def _packed(docs: DataFrame, group: str, blocks: str, page_height: float, atomic_share: float, reserve: float, begin: tuple[str, ...] = ()) -> DataFrame:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, own, *at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, reason = _pack(own or [], page_height, atomic_share, reserve, *at)
                rows += [(key, *r, "") for r in found] if not reason else [(key, -1, None, None, None, reason)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=[group, "page", "idx", "from_line", "to_line", "reason"])

    kind = docs.schema[group].dataType.simpleString()
    wanted = F.transform(blocks, lambda b: F.struct(*(b[f].alias(f) for f in _FIELDS)))
    return docs.select(group, wanted.alias("b"), *begin).mapInArrow(fold, f"{group} {kind}, page int, idx int, from_line int, to_line int, reason string")


def remeasured(entries: DataFrame, docs: DataFrame, group: str, blocks: str) -> DataFrame:
    """The pages of `paginate` with the measures that docs has for their blocks: a block's last entry ends with its last line.

    Adds the block's line_height, margin_before and margin_after, and whether its number of lines has changed.
    """
    fields = ("idx", "lines", "line_height", "margin_before", "margin_after")
    sizes = docs.select(F.col(group).alias("_g"), F.inline(F.transform(blocks, lambda b: F.struct(*(b[f].alias({"idx": "_idx", "lines": "_lines"}.get(f, f)) for f in fields)))))
    rows = entries.filter("page >= 0").join(sizes, (F.col(group) == F.col("_g")) & (F.col("idx") == F.col("_idx")))
    last = F.col("_last")
    rows = rows.withColumn("_last", F.max("to_line").over(W.partitionBy(group, "idx")))
    return rows.withColumn("to_line", F.when(F.col("to_line") == last, F.col("_lines")).otherwise(F.col("to_line"))).withColumn("changed", last != F.col("_lines")).select(*entries.columns, *fields[2:], "changed")


def page_fill(entries: DataFrame, group: str) -> DataFrame:
    """(group, page, height): what pages of `remeasured` entries hold: lines and collapsed margins."""
    own = W.partitionBy(group, "page").orderBy("idx", "from_line")
    before = F.lag("margin_after").over(own)
    top = F.when(before.isNotNull(), F.greatest(before, "margin_before")).otherwise(F.when(F.col("from_line") == 0, F.col("margin_before")).otherwise(0.0))
    part = entries.select(group, "page", ((F.col("to_line") - F.col("from_line")) * F.col("line_height") + top).alias("part"))
    return part.groupBy(group, "page").agg(F.sum("part").alias("height"))


def repaired(entries: DataFrame, docs: DataFrame, group: str, blocks: str, page_height: float, atomic_share: float = 0.75, reserve: float = 0.0, tolerance: float = 1.0) -> DataFrame:
    """The pages of `paginate` after some blocks turned out to have more lines; docs has the true measures.

    Documents whose pages all hold them stay as they are. Where a page overflows, pages stay up to the one on which a block that has grown
    begins, or on which it might have begun as it opens the next; from there on the document is packed again, in place of the whole of
    it, with the result that packing everything would give. A document that cannot be paged any more has one row with the reason.
    """
    # Both are gone through several times: written once, so that blocks are not cut and packed again each time.
    docs, entries = written(docs.select(group, blocks), "measures"), written(entries, "pages")
    now = written(remeasured(entries, docs, group, blocks), "remeasured")
    room = F.when(F.col("page") == 0, _room(0, page_height, reserve)).otherwise(page_height)
    over = page_fill(now, group).filter(F.col("height") > room + tolerance).select(F.col(group).alias("_v")).distinct()
    opens = F.row_number().over(W.partitionBy(group, "page").orderBy("idx", "from_line")) == 1
    grown = now.withColumn("_opens", opens).filter("changed and from_line = 0").join(over, F.col(group) == F.col("_v"), "left_semi")
    first = F.min(F.col("page") - (F.col("_opens") & (F.col("page") > 0)).cast("int")).alias("_page")
    over = grown.groupBy(F.col(group).alias("_o")).agg(first)
    unpaged = entries.filter("page < 0")
    joined = now.select(*entries.columns).join(over, F.col(group) == F.col("_o"), "left")
    kept = joined.filter("_page is null or page < _page").select(*entries.columns)
    opening = joined.filter("page = _page").groupBy(F.col(group).alias("_o"), "_page").agg(F.min(F.struct("idx", "from_line")).alias("_at"))
    again = docs.join(opening, F.col(group) == F.col("_o")).select(group, "_page", "_at.from_line", F.filter(blocks, lambda b: b["idx"] >= F.col("_at.idx")).alias("_rest"))
    packed = _packed(again, group, "_rest", page_height, atomic_share, reserve, ("_page", "from_line"))
    failed = packed.filter("page < 0").select(F.col(group).alias("_f"))
    return kept.join(failed, F.col(group) == F.col("_f"), "left_anti").unionByName(packed).unionByName(unpaged)


def measured(blocks: str, columns: int, line_height: float, margin_before: float, margin_after: float, splits: Column | None = None) -> Column:
    """The blocks of `with_block_arrays`, measured by a number of characters a line."""
    return F.transform(
        blocks,
        lambda b: F.struct(
            b["idx"].alias("idx"), F.ceil(b["len"] / columns).cast("int").alias("lines"), F.lit(line_height).alias("line_height"),
            F.lit(margin_before).alias("margin_before"), F.lit(margin_after).alias("margin_after"), (F.lit(True) if splits is None else splits).alias("splits"),
        ),
    )
