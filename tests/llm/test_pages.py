"""Page tokens that end where a browser ends them, and words that only look like boxes."""

import pytest

from quillstack.llm.html_wrappers import extract, extract_main_text

ARTICLE = "<article><h1>Title</h1><p>First words of it.</p><p>Second ones.</p></article>"
WANT = "Title\n\nFirst words of it.\n\nSecond ones."


@pytest.mark.parametrize(
    "before",
    [
        "<script>for(var i=0;i<n;i++){x(i)}</script>",
        "<script>document.write(\"<img alt='\")</script>",
        '<script type="application/json">{"a":"</p><b"}</script>',
        "<SCRIPT>if(a<b){}</SCRIPT >",
        "<script src=x />var a;</script>",
        "<style>a<b{}</style>",
        "<title>1 < 2 </title>",
        "<textarea><p>kept by a form</textarea>",
        "<datalist><option>a<option>b</datalist>",
        "<select><option>x<option>y</select>",
        "<!-->",
        "<!--->",
        "<!-- <p>no --!>",
    ],
)
def test_what_stands_before_the_article_does_not_swallow_it(before):
    assert extract(f"<html><body>{before}{ARTICLE}</body></html>", None) == WANT
    assert extract(f"<html><body><div>{ARTICLE.replace('<p>Second', before + '<p>Second')}</div></body></html>", None) == WANT


def test_an_open_script_hides_the_rest():
    assert extract(f"<html><body>{ARTICLE}<script>var a = '<p>no</p>';", None) == WANT


def test_headings_keep_their_text_whatever_their_id():
    page = "<article><h2 id=comments>Comments</h2><p id=share>The share price fell.</p><h2 id='search'>Search</h2></article>"
    assert extract(page, None) == "Comments\n\nThe share price fell.\n\nSearch"


def test_math_is_part_of_its_sentence():
    page = "<article><p>As <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds.</p></article>"
    assert extract(page, None) == "As x=2 holds."


def test_pages_in_a_table(spark):
    script = "<script>for(var i=0;i<n;i++){x(i)}</script>"
    long = "".join(f"<p>Line {i} of a long page.</p>" for i in range(20_000))
    rows = [(i, f"http://a.org/{i}", f"<html><body>{script}{ARTICLE}</body></html>") for i in range(5)]
    rows += [(7, "http://b.org/", f"<html><body><article>{long}</article></body></html>"), (8, None, None), (None, "http://a.org/x", f"<body>{ARTICLE}"), (3, "http://a.org/3", f"<body>{ARTICLE}")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, host string, wrapper string, text string")
    got = sorted(((r.page_id, r.text) for r in extract_main_text(df).collect()), key=repr)
    texts = {7: "\n\n".join(f"Line {i} of a long page." for i in range(20_000)), 8: ""}
    assert got == sorted(((r[0], texts.get(r[0], WANT)) for r in rows), key=repr)
