"""The source of listing pages: paths, errors, embedded JSON."""

from __future__ import annotations

import pytest

from stagelight.sources import pages as P

PAGE = """<!DOCTYPE html><html lang=en><head><script type="application/ld+json">[{"@type": "Event", "name": "Ham &amp; let", "offers": {"price": 9.5}}, {"@type": "Event", "name": 7}]</script>
<script type="application/ld+json">{broken</script><script>var x = "<p class='show'>no</p>"</script></head><body><!-- <p class="show">no</p> -->
<div id=list class="box shows"><p class="show new">One &amp; <b>two</b><p class=show>Three<br>four<div class=show>five</div><ul><li>a<li>b<ul><li>c</ul></li></ul></div><a href="/x?a=1&amp;b=2">x</a></body>"""


def values(html, path):
    steps, attribute = P.steps_of(path)
    return [e.attributes.get(attribute) if attribute else e.text() for e in P.found(P.Tree(html), steps)]


@pytest.mark.parametrize("path, want", [
    ("p.show", ["One & two", "Three four"]), (".show", ["One & two", "Three four", "five"]), ("#list > p", ["One & two", "Three four"]), ("div div", ["five"]), ("body > div > p.new b", ["two"]), ("html@lang", ["en"]),
    ("a[href]@href", ["/x?a=1&b=2"]), ("div[id=list] li", ["a", "bc", "c"]), ("ul > li", ["a", "bc", "c"]), ("li li", ["c"]), ("* > b", ["two"]), ("nav a", []), ("body > p", []),
])
def test_paths(path, want):
    assert values(PAGE, path) == want


def test_paths_that_are_none():
    for path in ("", "@href", "p:first-child", "p > > b!"):
        with pytest.raises(ValueError):
            P.steps_of(path)


def test_odd_pages():
    for html in ("", "<", "<p", "</p></p>", "<div>" * 50_000 + "x", "<a href='", "<p>" * 20_000):
        P.Tree(html)
    assert values("<div>" * 3000 + "<p>deep</p>", "div > div p") == ["deep"]


def test_scraped_pages(spark):
    template = {"show": P.Field("p.show", required=True, pattern="[A-Z].*"), "any": P.Field(".show", pattern="[A-Z].*"), "venue": P.Field("#venue", required=True)}
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, "")], "page_id int, url string, html string")
    got = P.scraped(df, template).persist()
    errors = {r.page_id: r.errors for r in got.collect()}
    assert errors == {1: ["any 3: five", "venue: missing", "json 2: not JSON"], 2: ["show: missing", "venue: missing"]} and got.count() == 3
    assert sorted(tuple(r) for r in P.entries(got).select("field", "place", "value").collect()) == [("any", 1, "One & two"), ("any", 2, "Three four"), ("show", 1, "One & two"), ("show", 2, "Three four")]
    items = [r.item for r in P.embedded(got, "name string, offers struct<price: double>").collect()]
    assert [(i.name, i.offers and i.offers.price) for i in items] == [("Ham &amp; let", 9.5), ("7", None)]
