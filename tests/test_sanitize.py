"""Attack payloads and plain pages through the sanitizer."""

import pytest

from quillstack.operators import page_blocks, sanitize

PAYLOADS = {
    "script": "<script>alert(1)</script>",
    "handler": "<img src=x onerror=alert(1)>",
    "svg script": "<svg><script>alert(1)</script></svg>",
    "math script": "<math><mtext><script>alert(1)</script></mtext></math>",
    "noscript title": '<noscript><p title="</noscript><img src=x onerror=alert(1)>"></p></noscript>',
    "namespaces": "<math><mtext><table><mglyph><style><!--</style><img src=x onerror=alert(1)>-->",
    "clobbering": '<img id="location" src="https://example.com/i.png">',
    "svg onload": '<svg onload="alert(1)"></svg>',
    "button": '<button onclick="alert(1)">x</button>',
    "iframe": '<iframe src="javascript:alert(1)"></iframe>',
    "link": '<a href="javascript:alert(1)">x</a>',
    "spaced link": '<a href=" java\nscript:alert(1)">x</a>',
    "data link": '<a href="data:text/html,<script>alert(1)</script>">x</a>',
    "vbscript": '<a href="vbscript:x">x</a>',
    "form": '<form action="javascript:alert(1)"><input value="alert"></form>',
    "breakout": "<p>a</p><title></title><img src=1 onload=alert(1)></title>",
}


@pytest.fixture(scope="module")
def clean(spark):
    pages = {
        "plain": '<div class="x"><p id="1">A &amp; B <b>bold</b>\u00a0<em>em</em></p><ul><li>one<li>two</ul></div>',
        "links": '<a href="https://x.org/?a=1&amp;b=2" target="_blank" title="t &quot;q&quot;">l</a><a href="/rel">r</a><a href="mailto:a@b">m</a><a href="x:y">n</a>',
        "figure": '<figure><img alt="" src="data:image/png;base64,AA"><figcaption>c</figcaption></figure><br><hr>',
        "nested": "<div><section><p>x<span>y<svg><g>no</g></svg>z</span></p></section></div>",
        "sup": '<p>a<sup class="reference">[1]</sup></p><nav role="navigation"><p>menu</p></nav>',
        "empty": "<script>x</script>",
    }
    rows = list((pages | {f"attack {k}": f"<p>before</p>{v}" for k, v in PAYLOADS.items()}).items())
    df = spark.createDataFrame([*rows, ("null", None)], "page_id string, html string")
    out = sanitize.sanitized(page_blocks.page_nodes(df, attributes=True))
    return {r.page_id: r for r in out.collect()}


@pytest.mark.parametrize("name", sorted(PAYLOADS))
def test_payloads_are_gone(clean, name):
    html = clean[f"attack {name}"].html.lower()
    assert html.startswith("<p>before</p>")
    assert not any(x in html for x in ("onerror", "onload", "onclick", "javascript:", "vbscript:", "<script", 'id="', "alert(1)", "data:", "<form", "<svg", "<math", "<iframe"))


def test_what_stays(clean):
    got = {k: (r.html, r.dropped, r.unwrapped) for k, r in clean.items() if not k.startswith("attack")}
    assert got == {
        "plain": ("<p>A &amp; B bold&nbsp;<em>em</em></p><ul><li>one</li><li>two</li></ul>", 0, 2),
        "links": ('<a href="https://x.org/?a=1&amp;b=2" title="t &quot;q&quot;">l</a><a href="/rel">r</a><a href="mailto:a@b">m</a><a>n</a>', 0, 0),
        "figure": ('<figure><img alt="" src="data:image/png;base64,AA"><figcaption>c</figcaption></figure><br><hr>', 0, 0),
        "nested": ("<p>xyz</p>", 2, 3),
        "sup": ("<p>a<sup>[1]</sup></p><p>menu</p>", 0, 1),
        "empty": ("", 1, 0),
    }
