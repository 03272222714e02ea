"""Markdown with nested quotes and lists: one pass over a document's lines carries the stack of open containers.

A line first meets the open containers, each of which takes its mark or its indent away; what is left opens new ones, and the rest is
a leaf: paragraph, heading, code, rule. A paragraph goes on over a line that has lost its marks (a lazy line). Inline marks
stay in the text; HTML blocks and link definitions count as paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import spread

_HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_ITEM = re.compile(r"([-+*]|(\d{1,9})([.)]))(?=[ \t]|$)")
_UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
_FIGURE = re.compile(r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)$")
#: Blocks that leave the reader together.
BATCH = 10_000
_ROWS = "idx long, boxes string, kind string, level int, text string"


class _Lines:
    """The containers and the leaf that are open after some lines, and the blocks that are done."""

    def __init__(self):
        self.blocks: list[tuple] = []
        self.stack: list[tuple[str, int, str, int]] = []  # "" or the list's mark, indent of the content, box, node
        self.lists: dict[int, tuple[str, str]] = {}  # by node around it: the list that a next item may join
        self.nodes = 0
        self.paragraph: list[str] = []
        self.code: list[str] = []
        self.fence: tuple[str, int] | None = None

    def _node(self) -> int:
        self.nodes += 1
        return self.nodes

    def _above(self) -> int:
        return self.stack[-1][3] if self.stack else 0

    def emit(self, kind: str, text: str, level: int | None = None) -> None:
        self.lists.pop(self._above(), None)
        self.blocks.append(("/".join(box for _, _, box, _ in self.stack), kind, level, text))

    def end_leaf(self) -> None:
        if self.paragraph:
            text = " ".join(x.strip() for x in self.paragraph)
            self.paragraph = []
            figure = _FIGURE.match(text)
            if figure and re.match("(?i)https?:", figure[2]):
                self.emit("figure", figure[1])
            else:
                self.emit("unsupported" if figure else "paragraph", "image" if figure else text)
        if self.fence or self.code:
            while not self.fence and self.code and not self.code[-1].strip():
                self.code.pop()
            text = "\n".join(self.code)
            self.code, self.fence = [], None
            if text.strip():
                self.emit("code-block", text)

    def keep(self, depth: int) -> None:
        """Ends the containers beyond `depth`, and the leaf in them."""
        if depth < len(self.stack):
            self.end_leaf()
            del self.stack[depth:]

    def line(self, raw: str) -> None:
        indent = len(raw) - len(raw.lstrip(" \t"))
        rest = raw[:indent].expandtabs(4) + raw[indent:]
        depth = 0
        for mark, width, _, _ in self.stack:
            lead = len(rest) - len(rest.lstrip(" "))
            if not mark:
                if lead > 3 or not rest[lead:].startswith(">"):
                    break
                rest = rest[lead + 1 :].removeprefix(" ")
            elif rest.strip():
                if lead < width:
                    break
                rest = rest[width:]
            depth += 1
        if self.fence and depth == len(self.stack):
            char, size, lead = self.fence
            if re.fullmatch(rf" {{0,3}}{char}{{{size},}}[ \t]*", rest):
                self.end_leaf()
            else:
                self.code.append(re.sub(rf"^ {{0,{lead}}}", "", rest))
            return
        opened = False
        while rest.strip():
            lead = len(rest) - len(rest.lstrip(" "))
            bare = rest[lead:]
            going = bool(self.paragraph) and not opened
            if lead > 3:
                break
            if bare.startswith(">"):
                self.keep(depth)
                self.end_leaf()
                self.lists.pop(self._above(), None)
                node = self._node()
                self.stack.append(("", 0, f"{node}:blockquote:", node))
                rest = bare[1:].removeprefix(" ")
            elif (item := _ITEM.match(bare)) and not _RULE.match(bare):
                after = bare[item.end() :]
                if going and depth == len(self.stack) and (not after.strip() or item[2] not in (None, "1")):
                    break  # such an item does not end a paragraph
                gap = len(after) - len(after.lstrip(" "))
                gap = gap if 1 <= gap <= 4 and after.strip() else 1
                self.keep(depth)
                self.end_leaf()
                mark, above = item[3] or item[1], self._above()
                if self.lists.get(above, ("",))[0] != mark:
                    kind = f"numbered-list:{max(int(item[2]), 1) if item[2] else ''}" if item[2] else "bulleted-list:"
                    self.lists[above] = (mark, f"{self._node()}:{kind}")
                node = self._node()
                self.stack.append((mark, lead + item.end() + gap, f"{self.lists[above][1]}/{node}:item:", node))
                rest = after[gap:] if after.strip() else ""
            else:
                break
            depth, opened = len(self.stack), True
        lead = len(rest) - len(rest.lstrip(" "))
        bare = rest[lead:].rstrip("\r")
        if not bare.strip():
            self.keep(depth)
            if self.code:
                self.code.append(rest[4:])
            elif not self.fence:
                self.end_leaf()
            return
        if lead > 3 and not self.paragraph:
            self.keep(depth)
            self.code.append(rest[4:])
            return
        if lead <= 3:
            under = _UNDERLINE.match(bare)
            if under and self.paragraph and depth == len(self.stack):
                text = " ".join(x.strip() for x in self.paragraph)
                self.paragraph = []
                self.emit("heading", text, 1 if bare[0] == "=" else 2)
                return
            heading, rule, fence = _HEADING.match(bare), _RULE.match(bare), _FENCE.match(bare)
            if heading or rule or fence:
                self.keep(depth)
                self.end_leaf()
                if fence:
                    mark = fence[1] or fence[3]
                    self.fence = (mark[0], len(mark), lead)
                elif rule:
                    self.lists.pop(self._above(), None)
                elif heading[2]:
                    self.emit("heading", heading[2].strip(), len(heading[1]))
                return
        if not self.paragraph:
            self.keep(depth)
        if self.code:
            self.end_leaf()
        self.paragraph.append(bare)

    def done(self) -> list[tuple]:
        self.keep(0)
        self.end_leaf()
        return self.blocks


def markdown_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, boxes, kind, level, text): leaf blocks in order, boxes as in page_block_tree: the quotes, lists and items around a
    block from the outermost on, array<struct<node, kind, start>>; blocks of one item share its node.

    Paragraphs and headings have their lines joined by a space, code as it is. A null or blank document has no blocks.
    """

    key = docs.schema[id_col]
    kinds = to_arrow_schema(T.StructType([key, *T._parse_datatype_string(_ROWS)]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def out(few: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*few, strict=True), kinds, strict=True)], schema=kinds)

        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = _Lines()
                for raw in (text or "").split("\n"):
                    lines.line(raw.rstrip("\r"))
                # Blocks of many small documents go on together, those of a large one in parts.
                rows += [(name, i, *b) for i, b in enumerate(lines.done())]
                while len(rows) >= BATCH:
                    yield out(rows[:BATCH])
                    del rows[:BATCH]
        if rows:
            yield out(rows)

    kind = key.dataType.simpleString()
    rows = spread(docs.select(id_col, text_col), id_col).mapInArrow(read, f"{id_col} {kind}, {_ROWS}")
    part = lambda b, i: F.get(F.split(b, ":"), F.lit(i))
    boxes = F.transform(F.filter(F.split("boxes", "/"), lambda b: b != ""), lambda b: F.struct(part(b, 0).cast("int").alias("node"), part(b, 1).alias("kind"), F.nullif(part(b, 2), F.lit("")).cast("int").alias("start")))
    return rows.withColumn("boxes", boxes)
