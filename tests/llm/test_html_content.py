"""Which elements hold the content of a page."""

import pytest

from brindle.llm.html_text import page_blocks

LONG = "The text of the page goes on for a while and says a lot."


@pytest.mark.parametrize(("body", "want"), [
    ("<article><p>One part</p></article><article><p>Another longer part</p></article>", ["One part", "Another longer part"]),
    ("<main><p>Main text</p><article><p>An article in it</p></article></main>", ["Main text", "An article in it"]),
    (f"<div><p>{LONG}</p></div><article>Short</article>", [LONG, "Short"]),
    (f"<div>menu</div><article><p>{LONG}</p><article>Inner</article></article><div class=related><article>Other</article></div>", [LONG, "Inner"]),
    (f"<nav>{LONG}</nav><div>menu</div><article>Some text of its own</article>", ["Some text of its own"]),
])
def test_content(body, want):
    assert page_blocks(f"<html><body>{body}</body></html>") == want


@pytest.mark.parametrize(("body", "want"), [
    ("<article><header class=entry-header><h1>Title</h1><p>by someone</p></header><p>Text</p></article>", ["Title", "Text"]),
    ("<article><div class=article-header><h1>Title</h1><span>date</span></div><p>Text</p></article>", ["Title", "Text"]),
    ("<article><p>Let <math><mi>x</mi></math> be</p><aside>side</aside><div class=comments>c</div></article>", ["Let x be"]),
])
def test_headings_stay(body, want):
    assert page_blocks(f"<html><body>{body}</body></html>") == want


@pytest.mark.parametrize("name", ["id=discussion", "class=social-history", "class=share-price", "id=related-work", 'class="search-results-discussed"', "class=notice"])
def test_sections_with_running_text_stay(name):
    text = "The section says what was found, and why it matters to those who read it, at some length."
    assert page_blocks(f"<body><article><h1>T</h1><p>{LONG * 9}</p><section {name}><h2>Heading</h2><p>{text}</p></section></article></body>")[2:] == ["Heading", text]
    assert page_blocks(f"<body><article><h1>T</h1><p>{LONG}</p><div class=share-bar><p>{text}</p><a>Tweet</a></div><div class=comments><p>{text}</p></div></article></body>")[2:] == [text, "Tweet"]


@pytest.mark.parametrize(("body", "want"), [
    (f"<form id=aspnetForm><article><p>{LONG}</p></article></form>", [LONG]),
    (f"<form><div><h1>Title</h1><p>{LONG}</p></div></form>", ["Title", LONG]),
    (f"<article><p>{LONG}</p><form><label>Name</label><p>{LONG}</p></form></article>", [LONG]),
    (f"<article><p>{LONG}</p><aside id=foo/>menu</aside></article>", [LONG]),
])
def test_forms_around_pages(body, want):
    assert page_blocks(f"<html><body>{body}</body></html>") == want


def test_deep_and_long_pages():
    deep = page_blocks("<div>x" * 40_000)
    assert len(deep) == 40_000 and page_blocks("<p>x</p>" * 200_000) == ["x"] * 200_000


def test_templates_equal_a_plain_count(spark):
    """Counted over whole pages, before names are judged: menus and footers are templates of their hosts."""
    import math
    from collections import defaultdict

    from pyspark.sql import functions as F

    from brindle.llm import html_text as h
    from brindle.llm.tables import ship
    from brindle.llm.urls import host

    ship(spark)
    site = [(f"http://Site.example.com/{k}", f"<body><nav><ul><li>Home<li>Shop</ul></nav><p>Own text {k}</p><footer>All rights</footer></body>") for k in range(9)]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html").unionByName(spark.createDataFrame(site, "url string, html string"))
    pages = pages.withColumn("host", host(F.col("url")))
    seen = defaultdict(dict)
    for r in pages.select("host", "html").collect():
        if r.host and r.html is not None:
            seen[r.host][r.html] = set(h.hashes(h.parse(r.html)).values())
    want = {}
    for name, copies in seen.items():
        n = defaultdict(int)
        for own in copies.values():
            for x in own:
                n[x] += 1
        least = max(h.LEAST_PAGES, math.ceil(h.SHARE * len(copies) - 1e-9))
        if found := {x for x, k in n.items() if k >= least} if len(copies) >= h.LEAST_PAGES else set():
            want[name] = found
    hashed = pages.where("html IS NOT NULL").select("host", "html").mapInArrow(h._hashed, "host string, digest bigint, hashes array<bigint>")
    assert {r.host: set(r.template) for r in h.templates(hashed).collect()} == want and len(want["site.example.com"]) == 5  # nav, ul, two li, footer
