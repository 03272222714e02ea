"""Main text of web pages by wrappers inferred from pages of one host (operator 4).

A wrapper is a union-free regular expression over the page's tokens: block tags, text slots (# with the path of the
text's box), optional groups (...)? and repeated groups (...)+. It starts as the first sample page with its repeats folded; each further page is
aligned with it, and what does not match becomes an optional group, or a repeated one where the same
unit stands once on one side and several times on the other.

Slots are then judged over the sample: a slot is content where its texts stand in articles; where the host has no article element, if
they lie in the box with most text and differ from page to page; else it is the template's. Every page of the
host is matched with the wrapper, and the verdict of a text's slot decides whether it is kept. Marks of the page itself (hidden and
navigation elements, words in class names) drop a text in any slot, and decide alone for texts that no slot matches.

A wrapper is learned from SAMPLE pages of a host (those of smallest id hash), so that a host with a third of all
pages is no larger a task than others; extraction reads every page whole.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._tables import shared_checkpoint, table

#: Sample pages of a host, and tokens of the longest unit that is looked for as a repeated group.
SAMPLE, LONGEST_UNIT, BROADCAST_BYTES, BROADCAST_ROWS = 8, 64, 16 << 20, 200_000

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg select datalist annotation button title audio video canvas".split())
#: Of these, what holds characters only: nothing but its own end tag ends it.
CHARACTERS = frozenset("script style noscript textarea iframe title".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mtable mtr mtd semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside dialog menu head".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Blocks of text, whose id names a place in the text (a heading's is made from its words) and no kind of box.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th pre blockquote figure".split())
MAIN = frozenset({"article", "main"})
#: Words of a class, id or role that mark what is not the article, anywhere and outside it.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar rail widget related "
    "recommended share sharing social comment comments disqus respond replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "signup signin login search pagination pager toolbar footer contentinfo complementary".split()
)
OUTSIDE = BOILERPLATE | {"header", "masthead", "topbar", "banner", "copyright", "skip", "alert", "tags", "meta"}
#: Words that only say which box of its kind it is: site-footer is a footer, has-sidebar is no sidebar.
PLACES = frozenset("site page main global left right top bottom primary secondary wrapper container box block section area list item bar inner outer".split())
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in CHARACTERS}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _says(name: str, words: frozenset) -> bool:
    """Whether a whole class name, id or role is one of the words, with numbers and PLACES at most."""
    parts = re.findall(r"[a-z]+", name)
    return any(x in words for x in parts) and all(x in words or x in PLACES for x in parts)


def _element(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Label (tag and classes), whether it is dropped for certain, dropped by a word anywhere, by a word outside the
    article, and the article itself."""
    found: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(attributes):
        if k:
            found.setdefault(k.lower(), v.strip("\"'"))
    names = " ".join(found.get(k, "") for k in ("class", "role") + ("id",) * (tag not in ANCHORED)).lower().split()
    label = ".".join([tag, *sorted(set(re.sub(r"\d+", "", found.get("class", "")).split()))])
    gone = tag in DROPPED or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    main = tag in MAIN or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    block = tag not in INLINE
    if tag in ("html", "body"):
        return label, gone, False, False, main
    boxed = tag == "form" or (tag != "article" and not (main and block) and any(_says(x, BOILERPLATE) for x in names))
    return label, gone, boxed, tag == "header" or (block and not main and any(_says(x, OUTSIDE) for x in names)), main


_remembered = lru_cache(maxsize=4096)(_element)


def element(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """As _element; long attributes are read whole, but not remembered."""
    return (_remembered if len(attributes) <= 500 else _element)(tag, attributes)


def _spared(rows: list[tuple]) -> set[int]:
    """Boxes that a word may not drop: those around a main element, around an article with more text than
    all that stays in articles, and, where no article stays, those with most of the page's text."""
    rows = [r for r in rows if not r[2]]
    length, around, is_main = Counter(), {}, {}
    for _, text, _, boxes, _, articles in rows:
        for n, main, above in articles:
            length[n] += len(text)
            around[n], is_main[n] = above, main
    spared: set[int] = set()
    stays = lambda r: spared.issuperset(r[3])
    largest = max((n for n in length if is_main[n]), key=length.get, default=None)
    if largest is not None:
        spared.update(around[largest])
    largest = max((n for n in length if not is_main[n]), key=length.get, default=None)
    if largest is not None and length[largest] > sum(len(r[1]) for r in rows if r[5] and stays(r)):
        spared.update(around[largest])
    if any(not main for r in rows if stays(r) for _, main, _ in r[5]):
        return spared
    pool = [r for r in rows if r[5]] or rows
    held = Counter()
    for r in pool:
        for n in set(r[3]) | (set() if r[5] else set(r[4])):
            held[n] += len(r[1])
    return spared | {n for n, k in held.items() if 2 * k > sum(len(r[1]) for r in pool)}


def _tags(page: str):
    """The tags and comments of a page. What stands in a script and the like is none: after its start tag comes its end tag."""
    m = _TOKEN.search(page)
    while m:
        yield m
        tag = (m[2] or m[5] or "").lower()
        if tag in CHARACTERS and not (m[1] or m[4]):
            end = _ENDS[tag].search(page, m.end())
            m = _TOKEN.match(page, end.start()) if end else None
        else:
            m = _TOKEN.search(page, m.end())


def blocks(page: str) -> tuple[list[tuple[str, str, bool, bool]], list[str]]:
    """Text blocks as (path, text, dropped, in the article), and the page's tokens.

    Unclosed elements end as HTML has them end; br is white space; text in script, style and the like is skipped.
    """
    rows, tokens, text = [], [], []
    # tag, path, dropped for certain; numbers of the boxes dropped by a word, anywhere and outside the article; articles
    # as (number, is a main element, boxes around it)
    stack: list[tuple[str, str, bool, tuple, tuple, tuple]] = [("", "", False, (), (), ())]
    at, skip = 0, ""
    # A hidden inline element: its tag, how many of that tag are open in it, and how deep the stack was. Blocks go on around it.
    mute: list = []

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                rows.append((stack[-1][1], " ".join(words), *stack[-1][2:]))
                tokens.append(f"#{stack[-1][1]}")

    for m in _tags(page):
        tag = (m[2] or m[5] or "").lower()
        closing = (m[1] or m[4]) == "/"
        if skip:
            if closing and tag == skip:
                skip, at = "", m.end()
            continue
        if m.start() > at and not mute:
            text.append(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW:
            attributes = m[3] or m[6] or ""
            if not closing and (tag in CHARACTERS or not attributes.endswith("/")):
                skip = tag
            continue
        if tag in INLINE:
            if mute and tag == mute[0]:
                mute[1] += -1 if closing else 1
                if not mute[1]:
                    mute = []
            elif not mute and not closing and tag not in VOID and any(element(tag, m[3] or m[6] or "")[1:3]):
                mute = [tag, 1, len(stack)]
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    tokens.append(f"/{tag}")
                    break
            mute = mute if mute and len(stack) >= mute[2] else []
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SIBLINGS[tag]:
                    del stack[i:]
                    if tag != "tr":
                        break
                elif stack[i][0] in SCOPES[tag]:
                    break
        mute = mute if mute and len(stack) >= mute[2] else []
        if tag in VOID:
            continue
        label, gone, boxed, outside, main = element(tag, m[3] or m[6] or "")
        _, path, above_gone, boxes, outer, articles = stack[-1]
        if tag not in ("html", "body"):
            path = f"{path}/{label}"
        if main:
            articles = (*articles, (m.start(), tag == "main", boxes))
        if boxed:
            boxes = (*boxes, m.start())
        if outside and not articles:
            outer = (*outer, m.start())
        stack.append((tag, path, above_gone or gone, boxes, outer, articles))
        tokens.append(label)
    if not skip and not mute and at < len(page):
        text.append(page[at:])
    flush()
    spared = _spared(rows) if any(boxes or outer for *_, boxes, outer, _ in rows) else set()
    out = []
    for path, words, gone, boxes, outer, articles in rows:
        dropped = gone or not spared.issuperset(boxes) or not (articles or spared.issuperset(outer))
        out.append((path, words, dropped, bool(articles)))
    return out, tokens


# A wrapper's node is a token, or (sign, nodes) with sign "+" or "?".
def repeats(nodes: list) -> list[tuple[int, int, int]]:
    """(first, unit, times): nodes as runs of a unit that stands times in a row; times is 1 for a single node."""
    out, i = [], 0
    while i < len(nodes):
        most, unit = 1, 1
        for n in range(1, min(LONGEST_UNIT, (len(nodes) - i) // 2) + 1):
            if nodes[i + n] != nodes[i]:
                continue
            times = 1
            while nodes[i + times * n : i + (times + 1) * n] == nodes[i : i + n]:
                times += 1
            if times > 1 and times * n > most:
                most, unit = times * n, n
        out.append((i, unit, most // unit))
        i += most
    return out


def fold(nodes: list) -> list:
    """Replaces units standing two or more times in a row by a repeated group."""
    return [nodes[i] if times == 1 else ("+", tuple(nodes[i : i + unit])) for i, unit, times in repeats(nodes)]


def _core(node):
    return node[1] if isinstance(node, tuple) else (node,)


def align(wrapper: list, page: list) -> list:
    """The wrapper generalised so that it matches a folded page as well."""
    out: list = []

    def optional(nodes: list) -> None:
        out.extend(x if isinstance(x, tuple) and x[0] == "?" else ("?", (x,)) for x in nodes)

    matcher = SequenceMatcher(None, [_core(x) for x in wrapper], [_core(x) for x in page], autojunk=False)
    for kind, i, i_end, j, j_end in matcher.get_opcodes():
        if kind == "equal":
            for x, y in zip(wrapper[i:i_end], page[j:j_end], strict=True):
                signs = {v[0] for v in (x, y) if isinstance(v, tuple)}
                sign = "?" if "?" in signs else "+" if "+" in signs else ""
                out.append((sign, _core(x)) if sign else x)
        else:
            optional(wrapper[i:i_end])
            optional(page[j:j_end])
    return out


def spelled(nodes) -> list[str]:
    """The expression's tokens in order, groups opened: a slot is known by its place among them."""
    return [t for x in nodes for t in ([x] if isinstance(x, str) else spelled(x[1]))]


@lru_cache(maxsize=4096)
def _places(expression: tuple[str, ...], page: tuple[str, ...]) -> tuple[int, ...]:
    """For each token of a page without repeats the place in the expression that it matches, -1 without one."""
    out = [-1] * len(page)
    for i, j, n in SequenceMatcher(None, expression, page, autojunk=False).get_matching_blocks():
        for k in range(n):
            out[j + k] = i + k
    return tuple(out)


def slots(expression: tuple[str, ...], tokens: list[str]) -> list[int]:
    """The slot of each text of a page: repeats of a unit share the slots of the unit."""
    runs = repeats(tokens)
    places = _places(expression, tuple(t for i, unit, _ in runs for t in tokens[i : i + unit]))
    out, at = [], 0
    for i, unit, times in runs:
        texts = [places[at + k] for k in range(unit) if tokens[i + k][0] == "#"]
        out += texts * times
        at += unit
    return out


def as_regex(nodes) -> str:
    return " ".join(x if isinstance(x, str) else f"({as_regex(x[1])}){x[0]}" for x in nodes)


def infer(pages: list[str]) -> dict:
    """A host's wrapper: its expression, its tokens in order, the verdict of each slot that has one, and the box with most text."""
    wrapper: list = []
    read = [blocks(page) for page in pages]
    for k, (_, tokens) in enumerate(read):
        wrapper = fold(tokens) if k == 0 else fold(align(wrapper, fold(tokens)))
    expression = tuple(spelled(wrapper))
    seen = defaultdict(list)
    for k, (found, tokens) in enumerate(read):
        for slot, row in zip(slots(expression, tokens), found, strict=True):
            seen[slot].append((k, *row))
    # The template's texts: the same in a slot on most pages that fill it.
    fixed = set()
    for slot, rows in seen.items():
        pages_with = Counter(t for t, _ in {(text, k) for k, _, text, _, _ in rows})
        fixed |= {(slot, t) for t, n in pages_with.items() if n >= 3 and n >= 0.6 * len({k for k, *_ in rows})}
    mass = Counter()
    for slot, rows in seen.items():
        for _, path, text, gone, _ in rows:
            if not gone and (slot, text) not in fixed:
                mass[path.rpartition("/")[0]] += len(text)
    root = max(sorted(mass), key=mass.get, default="")
    has_main = any(main and not gone for rows in seen.values() for _, _, _, gone, main in rows)
    verdicts = {}
    for slot, rows in seen.items():
        if slot < 0:
            continue
        inside = sum((main if has_main else f"{path}/".startswith(f"{root}/") and (slot, text) not in fixed) and not gone for _, path, text, gone, main in rows)
        if 10 * inside >= 9 * len(rows):
            verdicts[slot] = True
        elif 10 * inside <= len(rows):
            verdicts[slot] = False
    return {"regex": as_regex(wrapper), "tokens": expression, "content": sorted(x for x, v in verdicts.items() if v), "template": sorted(x for x, v in verdicts.items() if not v), "root": None if has_main else root}


@lru_cache(maxsize=256)
def _loaded(wrapper: str) -> tuple:
    w = json.loads(wrapper)
    return tuple(w["tokens"]), frozenset(w["content"]), frozenset(w["template"]), w["root"]


def extract(page: str, wrapper: str | None) -> str:
    found, tokens = blocks(page)
    if wrapper:
        expression, content, template, root = _loaded(wrapper)
        places = slots(expression, tokens)
        kept = [t for (_, t, gone, main), slot in zip(found, places, strict=True) if not gone and (slot in content or (main and slot not in template))]
    else:
        root, template, places = None, frozenset(), [-1] * len(found)
        kept = [t for _, t, gone, main in found if not gone and main]
    if not kept:  # nothing in a slot of content or an article: the box with most text of the host, or the page without its template
        rest = [(p, t) for (p, t, gone, _), slot in zip(found, places, strict=True) if not gone and slot not in template]
        rest = rest or [(p, t) for p, t, gone, _ in found if not gone]
        kept = [t for p, t in rest if root is not None and f"{p}/".startswith(f"{root}/")] or [t for _, t in rest]
    return "\n\n".join(kept)


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def learn_wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, wrapper JSON) from (host, page_id, html)."""
    order = F.xxhash64("page_id")
    # Two steps, so that a large host is first cut down in many tasks.
    near = pages.select("host", "page_id").withColumn("_h", order)
    some = near.withColumn("_r", F.row_number().over(W.partitionBy("host", F.pmod("_h", F.lit(256))).orderBy("_h", "page_id"))).filter(F.col("_r") <= sample)
    some = some.withColumn("_r", F.row_number().over(W.partitionBy("host").orderBy("_h", "page_id"))).filter(F.col("_r") <= sample)
    some = some.select(F.col("host").alias("_host"), F.col("page_id").alias("_id")).distinct()
    if some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    chosen = pages.join(some, F.col("host").eqNullSafe(F.col("_host")) & F.col("page_id").eqNullSafe(F.col("_id"))).select("host", "page_id", "html")
    # One page an id: a repeated id must not make a host's sample larger.
    chosen = chosen.groupBy("host", "page_id").agg(F.min("html").alias("html"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["page_id", "html"])["html"].tolist()
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(infer(ordered), ensure_ascii=False)]})

    return chosen.groupBy("host").applyInPandas(one, "host string, wrapper string")


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text (blocks joined by two newlines, empty if there are none), wrapper (the host's, as JSON).

    Null pages count as empty; pages without a url form a host of their own. Other columns are not read.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("host", host(F.col("url")))
    wrappers = shared_checkpoint(learn_wrappers(pages)).select(F.col("host").alias("_host"), "wrapper")
    if (wrappers.agg(F.sum(F.octet_length("wrapper"))).head()[0] or 0) <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    joined = pages.join(wrappers, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "wrapper")
    kind = joined.schema["page_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            texts = [extract(p, w) for p, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), batch.column("wrapper")], names=["page_id", "url", "text", "wrapper"])

    out = joined.mapInArrow(cut, f"page_id {kind}, url string, text string, wrapper string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "wrapper")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
