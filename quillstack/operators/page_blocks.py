"""Web pages as block rows: one parse a page gives element and text rows; which blocks they form is decided by joins and aggregates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import WHITE, normalized
from ..session import spread

# Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# Elements whose text is no content.
HIDDEN = ("script", "style", "template", "noscript")
# Elements that end an open paragraph.
BREAKS_PARAGRAPH = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "blockquote", "figure", "pre", "table", "hr", "div", "section", "article", "form")
# Elements shown as not supported.
UNSUPPORTED = ("table", "iframe", "video", "audio", "embed", "object", "canvas", "svg", "form", "input", "button", "select", "textarea", "math")
# Block elements that take their whole content.
LEAVES = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "figure", "img", *UNSUPPORTED)
_MARKS = {"a": "link", "code": "code", "kbd": "code", "samp": "code", "strong": "strong", "b": "strong", "em": "em", "i": "em"}
# Elements that hold other blocks, and what they are called.
BOXES = {"blockquote": "blockquote", "ul": "bulleted-list", "ol": "numbered-list", "li": "item"}
#: Rows that leave the reader together.
BATCH = 10_000
#: Bodies of footnotes that one page may have.
MOST_NOTES = 50
# The elements that may hold a page's content, the best first.
ROOTS = ("article", "main", "#readability-page-1", "#mw-content-text", ".mw-parser-output", "#content", "[role=main]")
# Targets that make a link one.
LINKED = re.compile("^(https?:|mailto:)", re.I)
_ROWS = "node int, parent int, last int, roots string, leaf int, depth int, tag string, attr string, text string, marks string, href string, boxes string, note int"
_ATTRIBUTES = "attributes map<string,string>"


class _Reader(HTMLParser):
    """Rows of one page. A row's leaf is the outermost block element above it that takes its whole content."""

    def __init__(self, hidden: bool = False):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.attributes: list[dict] = []
        self.open: list[tuple[int, str, int, str]] = []  # node, tag, leaf, target of the link
        self.hidden = 0
        self.show_hidden = hidden
        # By node: the boxes around it as (node, tag, start), the footnote item it is in, whether lists below it hold footnotes.
        self.boxes: dict[int, tuple] = {-1: ()}
        self.note = {-1: -1}
        self.notes = {-1: False}
        self.note_lists: set[int] = set()

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag in BREAKS_PARAGRAPH and any(t == "p" for _, t, _, _ in self.open):
            self.handle_endtag("p")
        if tag == "li" and any(t == "li" for _, t, _, _ in self.open[-1:]):
            self.handle_endtag("li")
        node = len(self.rows)
        parent, _, leaf, link = self.open[-1] if self.open else (-1, "", -1, "")
        chrome = attrs.get("role") == "navigation" or "mw-editsection" in attrs.get("class", "").split()
        classes = attrs.get("class", "").split()
        mark = tag == "sup" and ("reference" in classes or "footnote" in classes)
        above = self.open[-1][1] if self.open else ""
        own = leaf < 0 and tag in BOXES and (tag != "li" or above in ("ul", "ol"))
        self.boxes[node] = self.boxes[parent] + (((node, tag, attrs.get("start", "")),) if own else ())
        if tag == "ol" and (self.notes[parent] or "references" in classes or "citation" in classes):
            self.note_lists.add(node)
        self.notes[node] = self.notes[parent] or "references" in classes or attrs.get("id") == "References" or (tag == "section" and (attrs.get("id") == "notes" or "footnotes" in classes))
        self.note[node] = node if tag == "li" and parent in self.note_lists else self.note[parent]
        if leaf < 0 and (tag in LEAVES or chrome or mark):
            leaf = node
        names = {tag, f"#{attrs.get('id', '')}", f"[role={attrs.get('role', '')}]", *(f".{c}" for c in classes)}
        roots = ",".join(str(i) for i, r in enumerate(ROOTS) if r in names)
        if tag == "a":
            link = attrs.get("href", "") if LINKED.match(attrs.get("href", "")) else ""
        kept = {"a": "href", "img": "src"}.get(tag, "class")
        name = "chrome" if chrome else "footnote" if mark else tag
        self.rows.append([node, parent, node, roots, leaf, len(self.open), name, attrs.get(kept, ""), attrs.get("alt") if tag == "img" else None, self._marks(), link, "", self.note[node]])
        self.attributes.append(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        if tag not in VOID:
            self.open.append((node, tag, leaf, link))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][1] == tag:
                self.hidden -= sum(t in HIDDEN for _, t, _, _ in self.open[i:])
                self._end(i)
                return

    def handle_data(self, data):
        if (not self.hidden or self.show_hidden) and self.open:
            parent, _, leaf, link = self.open[-1]
            node = len(self.rows)
            self.boxes[node] = self.boxes[parent]
            self.rows.append([node, parent, node, "", leaf, len(self.open), "#text", "", data, self._marks(), link, "", self.note[parent]])
            self.attributes.append({})

    def _end(self, first):
        """Ends the open elements from the one at this place on: their subtrees reach to the last row."""
        for node, *_ in self.open[first:]:
            self.rows[node][2] = len(self.rows) - 1
        del self.open[first:]

    def finish(self):
        """Names the boxes of each row; a quote that holds no block becomes the leaf of the texts right in it."""
        self.close()
        self._end(0)
        filled = set()
        for node, _, _, _, leaf, _, tag, _, text, *_ in self.rows:
            if leaf >= 0 and (tag != "#text" and leaf == node and tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "chrome") or tag == "#text" and text.strip() and self.rows[leaf][6] != "chrome"):
                filled.update(b[0] for b in self.boxes[leaf])
        for row in self.rows:
            boxes = self.boxes[row[0]]
            if row[4] < 0 and boxes and boxes[-1][1] == "blockquote" and boxes[-1][0] not in filled:
                row[4], boxes = boxes[-1][0], boxes[:-1]
            row[11] = "/".join(f"{n}:{BOXES[t]}:{start}" for n, t, start in boxes)

    def _marks(self) -> str:
        return ",".join(dict.fromkeys(_MARKS[t] for _, t, _, link in self.open if t in _MARKS and (t != "a" or link)))


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", attributes: bool = False) -> DataFrame:
    """(id, node, parent, last, roots, leaf, depth, tag, attr, text, marks, href, boxes, note): the elements and texts of each page in order.

    The subtree of a node are the nodes up to `last`; roots are the places in ROOTS of what an element may be; leaf the block element
    whose content a row is (-1: none), attr the href of links, the src of images and else the class, text also the alt of images,
    href the target of the link around a row, where it is one; boxes names the quotes, lists and items around a row from the outermost on
    (node:kind:start), note the footnote item it is in (-1: none). With `attributes`, all of them follow as a map, and texts of
    scripts and the like are rows too. A null or empty page has no rows.
    """

    key = pages.schema[id_col]
    kinds = to_arrow_schema(T.StructType([key, *T._parse_datatype_string(_ROWS + f", {_ATTRIBUTES}" * attributes)]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, maps = [], [], []

        def out() -> pa.RecordBatch:
            columns = [keys, *zip(*rows, strict=True), *([maps] if attributes else [])]
            made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
            keys.clear(), rows.clear(), maps.clear()
            return made

        for batch in batches:
            for page, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = _Reader(attributes)
                reader.feed(html or "")
                reader.finish()
                # Rows of many small pages go on together, those of a large one in parts.
                for lo in range(0, len(reader.rows), BATCH):
                    rows += reader.rows[lo : lo + BATCH]
                    keys += [page] * (len(rows) - len(keys))
                    maps += [list(a.items()) for a in reader.attributes[lo : lo + BATCH]] if attributes else []
                    if len(rows) >= BATCH:
                        yield out()
        if rows:
            yield out()

    kind = key.dataType.simpleString()
    return spread(pages.select(id_col, html_col), id_col).mapInArrow(read, f"{id_col} {kind}, {_ROWS}" + f", {_ATTRIBUTES}" * attributes)


def content_nodes(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The rows below each page's content element: of ROOTS in their order the first whose first element has text; else all."""
    page = W.partitionBy(id_col)
    # The next row with text from here on lies in an element's subtree, or the element has none.
    solid = F.min(F.when((F.col("tag") == "#text") & (F.trim("text") != ""), F.col("node"))).over(page.orderBy("node").rowsBetween(0, W.unboundedFollowing))
    ranks = F.split("roots", ",")
    first = lambda i: F.min(F.when(F.array_contains(ranks, str(i)), F.struct("node", "last", F.coalesce(F.col("_solid") <= F.col("last"), F.lit(False)).alias("filled")))).over(page)
    found = nodes.withColumn("_solid", solid).withColumns({f"_r{i}": first(i) for i in range(len(ROOTS))})
    chosen = F.coalesce(*(F.when(F.col(f"_r{i}.filled"), F.col(f"_r{i}")) for i in range(len(ROOTS))))
    below = F.col("_c").isNull() | F.col("node").between(F.col("_c.node"), F.col("_c.last"))
    return found.withColumn("_c", chosen).filter(below).select(*nodes.columns)


def page_blocks(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, idx, kind, level, text): the leaf blocks of page_block_tree."""
    return page_block_tree(nodes, id_col).select(id_col, "idx", "kind", "level", "text")


def page_block_tree(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, idx, boxes, kind, level, text, footnote_id): paragraphs, headings, code, figures, footnote marks and unsupported elements in page order.

    boxes, array<struct<node, kind, start>>, are the quotes, lists and items around a block from the outermost on; blocks of one item
    share its node. Text outside these elements is no block, but for a quote without any, which is a paragraph; navigation gives none,
    nor what lies in a list beside its items. Figures need an http(s) source and show their alt text, else they are unsupported. A
    footnote mark without a number of its own has its place among the marks of the page.
    """
    inside = content_nodes(nodes, id_col).filter("leaf >= 0")
    piece = F.struct("node", "text")
    source = F.when((F.col("tag") == "img"), F.struct("node", F.col("attr").alias("src"), F.col("text").alias("alt")))
    words = F.when(F.col("tag") == "#text", piece).when(F.col("tag") == "br", F.struct("node", F.lit(" ").alias("text")))
    own = F.col("node") == F.col("leaf")
    rows = inside.groupBy(id_col, "leaf").agg(
        F.max(F.when(own, F.col("tag"))).alias("tag"), F.max(F.when(own, F.col("boxes"))).alias("boxes"), F.min(source).alias("img"), F.array_sort(F.collect_list(words)).alias("ws")
    )
    tag = F.col("tag")
    kind = (
        F.when(tag.rlike("^h[1-6]$"), "heading")
        .when(tag.isin("p", "blockquote"), "paragraph")
        .when(tag == "pre", "code-block")
        .when(tag == "footnote", "footnote-reference")
        .when(tag.isin("figure", "img"), F.when(F.col("img.src").rlike("(?i)^https?:"), "figure").otherwise("unsupported"))
        .otherwise("unsupported")
    )
    raw = F.array_join(F.expr("ws.text"), "")
    text = F.when(F.col("kind") == "code-block", raw).when(F.col("kind") == "figure", F.coalesce("img.alt", F.lit(""))).when(F.col("kind") == "unsupported", F.col("tag")).otherwise(normalized(raw))
    level = F.when(F.col("kind") == "heading", F.substring("tag", 2, 1).cast("int"))
    out = rows.filter("tag is not null and tag <> 'chrome'").withColumn("kind", kind).withColumns({"text": text, "level": level})
    out = out.filter("kind in ('figure', 'unsupported', 'footnote-reference') or trim(text) <> ''").filter(~F.col("boxes").rlike("-list:[^/]*$"))
    page = W.partitionBy(id_col)
    mark = F.col("kind") == "footnote-reference"
    number = F.coalesce(F.nullif(F.regexp_extract("text", r"^=?\s*(\d+)", 1), F.lit("")), F.sum(mark.cast("int")).over(page.orderBy("leaf")).cast("string"))
    out = out.withColumn("number", F.when(mark, number))
    part = lambda b, i: F.get(F.split(b, ":"), F.lit(i))
    start = lambda b: F.when(part(b, 1) == "numbered-list", F.coalesce(part(b, 2).try_cast("int"), F.lit(1)))
    boxes = F.transform(F.filter(F.split("boxes", "/"), lambda b: b != ""), lambda b: F.struct(part(b, 0).cast("int").alias("node"), part(b, 1).alias("kind"), start(b).alias("start")))
    shown = F.when(mark & (F.col("text") == ""), F.concat(F.lit("["), "number", F.lit("]"))).otherwise(F.col("text"))
    idx = (F.row_number().over(page.orderBy("leaf")) - 1).cast("long")
    return out.select(id_col, idx.alias("idx"), boxes.alias("boxes"), "kind", "level", shown.alias("text"), F.concat(F.lit("fn-"), "number").alias("footnote_id"))


def footnote_bodies(nodes: DataFrame, id_col: str = "page_id", most: int = MOST_NOTES) -> DataFrame:
    """(id, footnote_id, text): the items of a page's footnote lists, numbered in page order, blank ones without a row.

    Only the first `most` items of a page count, as a page shows no more.
    """
    piece = F.when(F.col("tag") == "#text", F.struct("node", "text"))
    items = nodes.filter("note >= 0").groupBy(id_col, "note").agg(F.array_sort(F.collect_list(piece)).alias("ts"))
    items = items.withColumn("n", F.row_number().over(W.partitionBy(id_col).orderBy("note"))).filter(F.col("n") <= most)
    rows = items.select(id_col, F.concat(F.lit("fn-"), F.col("n").cast("string")).alias("footnote_id"), normalized(F.array_join(F.expr("ts.text"), "")).alias("text"))
    return rows.filter("text <> ''")


def inline_runs(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, leaf, run, marks, href, text): neighbouring texts of a block with equal marks and link target as one run.

    White space inside is evened out and stays between runs; blank runs at the ends of a block go. A line break is a space. href is
    empty where there is no link; a target that is neither http(s) nor mailto makes none.
    """
    own = W.partitionBy(id_col, "leaf").orderBy("node")
    pieces = content_nodes(nodes, id_col).filter("leaf >= 0 and tag in ('#text', 'br')")
    even = F.when(F.col("tag") == "br", " ").otherwise(F.regexp_replace("text", f"[{WHITE}]+", " "))
    pieces = pieces.withColumn("piece", even).filter("piece <> ''").withColumn("solid", F.btrim("piece") != "")
    pieces = pieces.withColumn("begun", F.max("solid").over(own)).filter("begun")
    changed = (F.lag("marks").over(own) != F.col("marks")) | (F.lag("href").over(own) != F.col("href"))
    pieces = pieces.withColumn("n", F.sum(F.coalesce(changed.cast("int"), F.lit(0))).over(own))
    runs = pieces.groupBy(id_col, "leaf", "n").agg(F.first("marks").alias("marks"), F.first("href").alias("href"), F.max("solid").alias("solid"), F.array_sort(F.collect_list(F.struct("node", "piece"))).alias("ps"))
    after = F.max("solid").over(W.partitionBy(id_col, "leaf").orderBy(F.desc("n")))
    text = F.regexp_replace(F.array_join(F.expr("ps.piece"), ""), "[ \\t]{2,}", " ")
    runs = runs.withColumn("more", after).filter("more").select(id_col, "leaf", "n", "marks", "href", text.alias("text"))
    run = (F.row_number().over(W.partitionBy(id_col, "leaf").orderBy("n")) - 1).cast("long")
    return runs.select(id_col, "leaf", run.alias("run"), "marks", "href", "text")
