"""Random trees written as Markdown and read back, and stated documents."""

import random

from quillstack.operators.markdown_tree import _Lines, markdown_tree


def _read(text):
    lines = _Lines()
    for raw in text.split("\n"):
        lines.line(raw)
    return [("/".join(p.split(":", 1)[1].rstrip(":") for p in b.split("/") if p), k, lv, t) for b, k, lv, t in lines.done()]


def test_stated_documents():
    cases = {
        "> a\nb\n> c": [("blockquote", "paragraph", None, "a b c")],
        "> a\n\nb": [("blockquote", "paragraph", None, "a"), ("", "paragraph", None, "b")],
        "- a\n- b\n\n  c\n- > d\n  > - e": [("bulleted-list/item", "paragraph", None, x) for x in "abc"] + [("bulleted-list/item/blockquote", "paragraph", None, "d"), ("bulleted-list/item/blockquote/bulleted-list/item", "paragraph", None, "e")],
        "3. x\n4. y\n1) z": [("numbered-list:3/item", "paragraph", None, "x"), ("numbered-list:3/item", "paragraph", None, "y"), ("numbered-list:1/item", "paragraph", None, "z")],
        "a\n2. b": [("", "paragraph", None, "a 2. b")],
        "a\n1. b": [("", "paragraph", None, "a"), ("numbered-list:1/item", "paragraph", None, "b")],
        "> ```\n> x\ny": [("blockquote", "code-block", None, "x"), ("", "paragraph", None, "y")],
        "- ```\n  x\n\n    y\n  ```\n  z": [("bulleted-list/item", "code-block", None, "x\n\n  y"), ("bulleted-list/item", "paragraph", None, "z")],
        "    code\n\n      more\n\ntext": [("", "code-block", None, "code\n\n  more"), ("", "paragraph", None, "text")],
        "A\nB\n===\nC\n---\n# D #\n***": [("", "heading", 1, "A B"), ("", "heading", 2, "C"), ("", "heading", 1, "D")],
        "> A\n---": [("blockquote", "paragraph", None, "A")],
        "![alt](https://x/y.png)\n\n![no](data:1)": [("", "figure", None, "alt"), ("", "unsupported", None, "image")],
        "- - a": [("bulleted-list/item/bulleted-list/item", "paragraph", None, "a")],
        "-\n  a": [("bulleted-list/item", "paragraph", None, "a")],
        "\t- x": [("", "code-block", None, "- x")],
        "": [],
    }
    for text, want in cases.items():
        assert _read(text) == want, text


def test_items_of_one_list_share_it(spark):
    df = spark.createDataFrame([(1, "- a\n- b\n\n  c\n\ntext\n- d"), (2, None), (3, "> x\r\n>\r\n> 7. y")], "doc_id long, text string")
    rows = {(r.doc_id, r.text): r for r in markdown_tree(df).collect()}
    lists = {t: [b.node for b in rows[1, t].boxes] for t in "abcd"}
    assert lists["a"][0] == lists["b"][0] != lists["d"][0] and lists["a"][1] != lists["b"][1] == lists["c"][1]
    assert [(b.kind, b.start) for b in rows[3, "y"].boxes] == [("blockquote", None), ("numbered-list", 7), ("item", None)]
    assert len(rows) == 7


def _tree(rng, depth=0):
    """Blocks as (kind, content): leaves, quotes of blocks, lists of items of blocks."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(("p", "h", "c", "q", "u", "o")) if depth < 4 else rng.choice("phc")
        if kind in "phc":
            out.append((kind, "w" + "".join(rng.choice("ab ") for _ in range(8)).strip()))
        elif kind == "q":
            out.append(("q", _tree(rng, depth + 1)))
        else:
            out.append((kind, [_tree(rng, depth + 1) for _ in range(rng.randrange(1, 4))]))
    return out


def _written(blocks, rng, last=""):
    """Lines of blocks, with a blank line between; two lists next to each other get a rule between them."""
    lines = []
    for i, (kind, content) in enumerate(blocks):
        if i:
            lines.append("")
            if kind in "uo" and blocks[i - 1][0] in "uo" or kind == "q" and blocks[i - 1][0] == "q":
                lines += ["***", ""]
        if kind == "p":
            lines.append(content)
        elif kind == "h":
            lines.append(f"## {content}")
        elif kind == "c":
            lines += ["```", content, "```"]
        elif kind == "q":
            lines += [f"> {x}".rstrip() for x in _written(content, rng)]
        else:
            for n, item in enumerate(content):
                mark = "- " if kind == "u" else f"{n + 5}. "
                own = _written(item, rng)
                lines += [mark + own[0], *((" " * len(mark) + x).rstrip() for x in own[1:]), ""]
            lines.pop()
    return lines


def _leaves(blocks, boxes=()):
    for kind, content in blocks:
        if kind in "phc":
            name, level = {"p": ("paragraph", None), "h": ("heading", 2), "c": ("code-block", None)}[kind]
            yield "/".join(boxes), name, level, content
        elif kind == "q":
            yield from _leaves(content, (*boxes, "blockquote"))
        else:
            for item in content:
                yield from _leaves(item, (*boxes, "bulleted-list" if kind == "u" else "numbered-list:5", "item"))


def test_random_trees_come_back():
    rng = random.Random(6)
    for _ in range(400):
        tree = _tree(rng)
        text = "\n".join(_written(tree, rng))
        assert _read(text) == list(_leaves(tree)), text
