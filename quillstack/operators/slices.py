"""Blocks cut at highlights and at page ranges, headings from outline targets, contents lists and front matter."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grapheme_count, graphemes
from .blocks import let

#: Ranges meet in cells of so many positions, so that a long article is dealt to many tasks.
CELL = 4096
OUTLINE_TOLERANCE_LINES = 1.5
# Kinds of blocks that are never cut.
ATOMIC = ("heading", "figure", "code-block", "footnote-reference", "unsupported")
# Plain YAML scalars that are no strings.
NOT_A_STRING = r"^(~|null|Null|NULL|true|True|TRUE|false|False|FALSE|[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+|[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN))$"


def overlapping(left: DataFrame, right: DataFrame, key: str, cell: int = CELL) -> DataFrame:
    """All columns of both sides, the right ones but for key prefixed by `r_`, for ranges [start, end) of one key that share a position.

    Each range goes to the cells that it touches; a pair is taken in the first cell that both touch, so once. Empty ranges
    count as their first position. Null bounds or keys meet nothing.
    """
    last = lambda c, s: F.floor((F.greatest(F.col(c), F.col(s) + 1) - 1) / cell)
    a = left.withColumn("_first", F.floor(F.col("start") / cell)).withColumn("_cell", F.explode(F.sequence("_first", last("end", "start"))))
    b = right.select(F.col(key).alias("_key"), *(F.col(c).alias(f"r_{c}") for c in right.columns if c != key))
    b = b.withColumn("_r_first", F.floor(F.col("r_start") / cell)).withColumn("_r_cell", F.explode(F.sequence("_r_first", last("r_end", "r_start"))))
    both = a.join(b, (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_r_cell")))
    meet = (F.greatest(F.col("end"), F.col("start") + 1) > F.col("r_start")) & (F.col("start") < F.greatest(F.col("r_end"), F.col("r_start") + 1))
    return both.filter(meet & (F.col("_cell") == F.greatest("_first", "_r_first"))).drop("_key", "_first", "_cell", "_r_first", "_r_cell")


def highlighted_runs(blocks: DataFrame, highlights: DataFrame, key: str, block: str = "idx") -> DataFrame:
    """(key, block, slice, start, len, highlight, marks, text): the runs of each block, cut where highlights begin and end.

    blocks has key, block, start and runs, array<struct<text, marks>>; highlights key, id, start and end; positions are clusters of
    the article. Pieces of a block cover it without gaps; those of one highlight, or between two, share a slice number. Marks stay
    with both halves of a cut run. Of highlights that overlap the one that begins first counts. Blocks without text, and empty
    runs, give no rows; a block without highlights is one slice.
    """
    # Runs travel as texts with their sizes; clusters are told apart only where a run is cut.
    runs = F.filter("runs", lambda r: F.coalesce(r["text"], F.lit("")) != "")
    sizes = F.transform(runs, lambda r: grapheme_count(r["text"]))
    total = F.aggregate(sizes, F.lit(0), lambda n, x: n + x)
    sized = blocks.select(key, block, F.col("start").cast("long").alias("start"), runs.alias("runs"), sizes.alias("sizes"), total.alias("size"))
    spans = sized.select(key, block, "start", (F.col("start") + F.col("size")).alias("end")).filter("end > start")
    real = highlights.select(key, "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("end > start")
    hit = overlapping(spans, real, key)
    own = F.struct((F.greatest("r_start", "start") - F.col("start")).cast("int").alias("s"), (F.least("r_end", "end") - F.col("start")).cast("int").alias("e"), F.col("r_id").alias("id"))
    met = hit.groupBy(F.col(key).alias("_k"), F.col(block).alias("_b")).agg(F.array_sort(F.collect_list(own)).alias("_hs"))
    none = F.array().cast(met.schema["_hs"].dataType)
    rows = sized.filter("size > 0").join(met, (F.col(key) == F.col("_k")) & (F.col(block) == F.col("_b")), "left").withColumn("hs", F.coalesce("_hs", none))
    begun = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))
    opens = F.aggregate("sizes", begun, lambda s, x: F.struct(F.array_append(s["at"], s["n"]).alias("at"), (s["n"] + x).alias("n")))["at"]
    bounds = F.filter(F.concat(F.array(F.lit(0)), F.expr("hs.s"), F.expr("hs.e")), lambda b: b < F.col("size"))
    rows = rows.withColumns({"bounds": F.array_distinct(bounds), "opens": opens})

    def of_run(r: Column, i: Column) -> Column:
        first, length = F.get("opens", i), F.get("sizes", i)
        cuts = F.array_sort(F.array_union(F.array(first), F.filter("bounds", lambda b: (b > first) & (b < first + length))))

        def pieces(at: Column, clusters: Column) -> Column:
            def piece(a: Column, k: Column) -> Column:
                n = F.coalesce(F.get(at, k + 1), first + length) - a
                return F.struct(
                    (F.size(F.filter("bounds", lambda b: b <= a)) - 1).alias("slice"),
                    (F.col("start") + a).alias("start"),
                    n.cast("long").alias("len"),
                    F.get(F.filter("hs", lambda h: (h["s"] <= a) & (a < h["e"])), F.lit(0))["id"].alias("highlight"),
                    r["marks"].alias("marks"),
                    F.array_join(F.slice(clusters, a - first + 1, n), "").alias("text"),
                )

            return F.transform(at, piece)

        return let(cuts, lambda at: let(graphemes(r["text"]), lambda g: pieces(at, g)))

    return rows.select(key, block, F.inline(F.flatten(F.transform("runs", of_run))))


def sliced_blocks(leaves: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, range, path, start, end): what each range [start, end) shows of the leaf blocks of a tree.

    leaves has key, path, kind, start, end and the bounds of the top block it belongs to, top_start and top_end; ranges key, range,
    start and end. Paragraphs are cut to the range, kinds in ATOMIC are shown whole as soon as one position is inside. Leaves
    without text are shown inside a range, at its start only if the range shows the whole top block.
    """
    hit = overlapping(leaves, ranges, key)
    whole = (F.col("r_start") <= F.col("top_start")) & (F.col("r_end") >= F.col("top_end"))
    shown = hit.filter(((F.col("end") > F.col("r_start")) & (F.col("start") < F.col("r_end"))) | whole)
    cut = ~(F.col("kind").isin(*ATOMIC) | whole)
    return shown.select(key, F.col("r_range").alias("range"), "path", F.when(cut, F.greatest("start", "r_start")).otherwise(F.col("start")).alias("start"), F.when(cut, F.least("end", "r_end")).otherwise(F.col("end")).alias("end"))


def outline_headings(paragraphs: DataFrame, targets: DataFrame, page: str, tolerance: float = OUTLINE_TOLERANCE_LINES) -> DataFrame:
    """(page, pos, level): paragraphs that outline targets turn into headings, each at most once, in the order of the targets.

    paragraphs has page, pos, y and delta (line distance), targets page, ord, y and level. A target takes the nearest paragraph of its
    page that is still one, the earlier on ties, if it is within `tolerance` lines; else the first if it points at or above all of
    them or nowhere (null). One target's choice depends on those before it, so a page is one fold over its targets.
    """
    rows = paragraphs.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("y").cast("double").alias("y"), F.col("delta").cast("double").alias("delta")))).alias("ps"))
    wanted = targets.groupBy(F.col(page).alias("_page")).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("y").cast("double").alias("y"), F.col("level").cast("int").alias("level")))).alias("ts"))
    kind = f"array<struct<pos:{paragraphs.schema['pos'].dataType.simpleString()},level:int>>"

    def choice(rest: Column, t: Column) -> Column:
        near = F.array_min(F.transform(rest, lambda p: F.struct(F.abs(p["y"] - t["y"]).alias("d"), p["pos"].alias("pos"), p["delta"].alias("delta"))))
        top = F.array_max(F.transform(rest, lambda p: p["y"]))
        first = F.get(rest, F.lit(0))["pos"]
        return F.when(t["y"].isNull(), first).when(near["d"] <= tolerance * near["delta"], near["pos"]).when(t["y"] >= top, first)

    def step(done: Column, t: Column) -> Column:
        rest = F.filter("ps", lambda p: ~F.exists(done, lambda x: x["pos"] == p["pos"]))
        chosen = let(rest, lambda r: F.struct(choice(r, t).alias("pos"), t["level"].alias("level")))
        return let(chosen, lambda c: F.when(c["pos"].isNull(), done).otherwise(F.array_append(done, c)))

    found = F.aggregate("ts", F.array().cast(kind), step)
    return rows.join(wanted, F.col(page) == F.col("_page")).select(page, F.inline(found))


class _Contents(HTMLParser):
    """Entries of the contents lists of one document: [label parts, href, depth], in the order in which their items open."""

    def __init__(self, lists: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.lists, self.entries, self.items = lists, [], []
        self.nav = self.depth = 0
        self.label = None

    def _item(self, depth: int):
        self.entries.append([[], None, depth])
        self.items.append(self.entries[-1])

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "nav":
            self.nav += 1
        elif tag == "navpoint":
            self._item(len(self.items) + 1)
        elif tag == "navlabel" and self.items and not self.items[-1][0]:
            self.label = self.items[-1]
        elif tag == "content" and self.items:
            self.items[-1][1] = self.items[-1][1] or attrs.get("src")
        elif self.nav and tag in self.lists:
            self.depth += 1
        elif self.nav and tag == "li":
            self._item(self.depth)
        elif self.nav and tag == "a" and self.items and self.items[-1][1] is None:
            self.items[-1][1], self.label = attrs.get("href") or "", self.items[-1]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag != "content":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("a", "navlabel"):
            self.label = None
        elif tag in ("li", "navpoint") and self.items:
            self.items.pop()
        elif tag in self.lists and self.depth:
            self.depth -= 1
        elif tag == "nav" and self.nav:
            self.nav -= 1

    def handle_data(self, data):
        if self.label is not None:
            self.label[0].append(data)


def contents_entries(docs: DataFrame, id_col: str, text_col: str, lists: tuple[str, ...] = ("ol",)) -> DataFrame:
    """(id, ord, label, href, depth): entries of navigation lists (nav, lists, li, a) and of navPoint trees, in order, depth from 1.

    An item without a label or a target is no entry, but what is nested in it counts. Null and empty documents have none.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_col], batch[text_col], strict=True):
                reader = _Contents(lists)
                reader.feed(text or "")
                reader.close()
                good = ((" ".join("".join(parts).split()), href, depth) for parts, href, depth in reader.entries)
                rows += [(key, i, *e) for i, e in enumerate(e for e in good if e[0] and e[1])]
            yield pd.DataFrame(rows, columns=[id_col, "ord", "label", "href", "depth"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(read, f"{id_col} {kind}, ord int, label string, href string, depth int")


def front_matter(text: Column) -> Column:
    """struct<title, author, date, body>: string fields of a leading block between lines of `---`, and the text below it.

    Values that YAML does not read as strings, block scalars and collections count as absent, empty ones too. A text without such
    a block is all body; null stays null.
    """
    plain = F.regexp_replace(text, "\r\n?", "\n")
    fence = r"\A---[ \t]*\n((?s:.*?\n)??)---[ \t]*(?:\n|\z)"

    def field(head: Column, name: str) -> Column:
        raw = F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]+(.*)$", 1))
        double, single = r'^"((?:[^"\\]|\\.)*)"[ \t]*(?:#.*)?$', r"^'((?:[^']|'')*)'[ \t]*(?:#.*)?$"
        bare = F.trim(F.regexp_replace(raw, r"(^|[ \t]+)#.*$", ""))
        value = (
            F.when(raw.rlike(double), F.regexp_replace(F.regexp_extract(raw, double, 1), r'\\(["\\/])', "$1"))
            .when(raw.rlike(single), F.regexp_replace(F.regexp_extract(raw, single, 1), "''", "'"))
            .when(~bare.rlike(NOT_A_STRING) & ~bare.rlike(r"""^["'\[\]{}&*!|>%@`,]|^[-?:]([ \t]|$)|:([ \t]|$)"""), bare)
        )
        return F.nullif(value, F.lit(""))

    head = F.regexp_extract(plain, fence, 1)
    return F.struct(*(field(head, n).alias(n) for n in ("title", "author", "date")), F.regexp_replace(plain, fence, "").alias("body"))
