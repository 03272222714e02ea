"""Sanitized pages from element rows: subtrees that go, elements that only their content survives, attributes and addresses by lists.

Elements are intervals of the page's numbering (node to last). What lies in a dropped one goes by a running maximum of ends; what is unwrapped leaves
its rows where they are, as the text is put together from what opens and closes at each number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .page_blocks import VOID

# Elements and attributes that stay.
ALLOWED = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote", "pre", "code", "a", "strong", "em", "img", "figure", "figcaption", "br", "hr", "sup")
ATTRIBUTES = ("href", "title", "alt", "src", "cite")
# Elements that go with all they hold; others that are not allowed leave their content.
WITH_CONTENT = (
    "annotation-xml", "audio", "colgroup", "desc", "foreignobject", "head", "iframe", "math", "mi", "mn", "mo", "ms", "mtext", "noembed", "noframes", "noscript",
    "plaintext", "script", "style", "svg", "template", "thead", "title", "video", "xmp", "object", "embed", "selectedcontent",
)
# Addresses that may stay: these schemes, or none.
ADDRESS = r"(?i)^(?:(?:(?:f|ht)tps?|mailto|tel|callto|sms|cid|xmpp|matrix):|[^a-z]|[a-z+.\-]+(?:[^a-z+.\-:]|$))"
#: What browsers leave out of an address before they look for its scheme.
_IGNORED = r"[\x00-\x20\x{a0}\x{1680}\x{180e}\x{2000}-\x{2029}\x{205f}\x{3000}]"


def escaped(text: Column, quotes: bool = False) -> Column:
    """Text as it stands in a page; with quotes, as the value of an attribute."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c, name in (("\u00a0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) * quotes)):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def safe_attributes(tag: Column, attributes: Column) -> Column:
    """The attributes that stay, by name: those on the list, addresses only with a scheme on theirs. An image may hold its own data."""
    bare = lambda v: F.regexp_replace(v, _IGNORED, "")
    inline = lambda k, v: (tag == "img") & (k == "src") & bare(v).rlike("(?i)^data:")
    good = lambda k, v: k.isin(*ATTRIBUTES) & (~k.isin("href", "src", "cite") | bare(v).rlike(ADDRESS) | inline(k, v) | (v == ""))
    return F.array_sort(F.map_entries(F.map_filter(attributes, good)))


def surviving(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """nodes (of page_nodes with attributes) with `gone`, whether they lie in a dropped subtree, and `element`: the tag where the element
    itself stays, else null."""
    name = F.when(F.col("tag").isin("chrome", "footnote"), F.when(F.col("tag") == "footnote", "sup")).otherwise(F.col("tag"))
    cut = F.when(name.isin(*WITH_CONTENT), F.col("last"))
    end = F.max(cut).over(W.partitionBy(id_col).orderBy("node").rowsBetween(W.unboundedPreceding, 0))
    rows = nodes.withColumn("gone", F.coalesce(F.col("node") <= end, F.lit(False)))
    return rows.withColumn("element", F.when(~F.col("gone") & name.isin(*ALLOWED), name))


def sanitized(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, html, dropped, unwrapped): the page that is left, and how many elements went with their content and without it.

    nodes: page_nodes with attributes. Pages of which nothing is left have an empty html; pages without rows none at all.
    """
    rows = surviving(nodes, id_col).withColumn("_kept", safe_attributes(F.col("element"), F.col("attributes")))
    said = F.array_join(F.transform("_kept", lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), escaped(a["value"], True), F.lit('"'))), "")
    opens = F.when(F.col("tag") == "#text", escaped(F.col("text"))).when(F.col("element").isNotNull(), F.concat(F.lit("<"), "element", said, F.lit(">")))
    closes = F.when(~F.col("element").isin(*VOID), F.concat(F.lit("</"), "element", F.lit(">")))
    mark = lambda at, close, order, said: F.struct(at.alias("at"), F.lit(close).alias("close"), order.alias("order"), said.alias("said"))
    # Of elements that end at one number the inner one, whose own number is higher, closes first.
    events = F.filter(F.array(mark(F.col("node"), 0, F.lit(0), opens), mark(F.col("last"), 1, -F.col("node"), closes)), lambda e: e["said"].isNotNull())
    stays = F.col("tag") != "#text"
    # One pass over a page's rows: the order is that of the events' structs, which holds no nulls.
    said = F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list(F.when(~F.col("gone"), events)))), lambda e: e["said"]), "")
    out = rows.groupBy(id_col).agg(said.alias("html"), F.count_if(stays & F.col("gone")).alias("dropped"), F.count_if(stays & ~F.col("gone") & F.col("element").isNull()).alias("unwrapped"))
    return out.select(id_col, "html", "dropped", "unwrapped")
