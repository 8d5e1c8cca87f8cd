"""No text of a page is gone before the model sees it."""

import pytest

from revtables.llm import html_text
from revtables.llm.html_tree import parse


def texts(page):
    return [n.text for n in parse(page) if n.tag == "#text"]


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><p>one</p><p>two</p></html>",
    "<head><meta charset=utf-8><link rel=x href=y><article><p>one<p>two</article>",
    "<html><head><title>T</title></head><p>one</p><p>two</p>",
    "<head><style>a{}</style>one<div>two</div>",
    "<head><noscript><link rel=x></noscript><script>var a;</script><body><p>one<p>two",
])
def test_head_ends_without_its_end_tag(page):
    assert texts(page) == ["one", "two"]


def test_head_is_left_out():
    page = "<html><head>\n<title>T</title>\n<meta name=a>\n<script>x</script>\n</head><body><p>one</p></body></html>"
    assert texts(page) == ["one"]
    assert texts("<body><p>one</p><head><p>two</p></body>") == ["one", "two"]


def test_formula_stays_in_its_paragraph():
    assert texts("<article><p>Let <math><mi>E</mi><mo>=</mo><mi>m</mi></math> hold.</p></article>") == ["Let E=m hold."]


@pytest.mark.parametrize("tag", ["svg", "noscript", "select", "button", "iframe", "datalist"])
def test_embedded_elements_are_nodes(tag):
    nodes = parse(f"<article><p>before <{tag}><g>inside</g></{tag}> after</p><p>next</p></article>")
    found = {n.text: n for n in nodes if n.tag == "#text"}
    assert list(found) == ["before", "inside", "after", "next"]
    assert nodes[found["before"].parent].tag == nodes[found["after"].parent].tag == "p" and found["before"].parent == found["after"].parent
    assert tag in {n.tag for n in nodes}


@pytest.mark.parametrize("tag", ["math", "svg", "noscript", "select", "button", "iframe", "datalist", "textarea", "title", "template"])
def test_an_open_element_does_not_hide_the_rest(tag):
    found = texts(f"<article><p>one</p><{tag}>x</article><div>rest</div>")
    assert "one" in found and "x" in found and "rest" in found


@pytest.mark.parametrize("tag", ["script", "style"])
def test_an_open_script_hides_the_rest(tag):
    assert texts(f"<p>one</p><{tag}>x<div>rest</div>") == ["one"]


def test_deep_pages_take_no_longer_a_tag():
    deep = parse("<ul>" * 60_000 + "x" + "</p>" * 60_000)
    assert len(deep) == 60_002 and deep[-1].text == "x" and deep[-1].depth == 60_001
    items = parse("<ul>" + "<li><b>a" * 30_000 + "</ul>" + "<div>" * 30_000 + "</ul>" * 30_000 + "y")
    assert sum(n.tag == "li" for n in items) == 30_000 and all(n.depth == 2 for n in items if n.tag == "li")


def test_what_an_opening_tag_ends():
    tags = lambda page: [(n.tag, n.depth) for n in parse(page)[1:] if n.tag != "#text"]
    assert tags("<ul><li><p>a<li>b") == [("ul", 1), ("li", 2), ("p", 3), ("li", 2)]
    assert tags("<ul><li><ul><li>a</ul><li>b") == [("ul", 1), ("li", 2), ("ul", 3), ("li", 4), ("li", 2)]
    assert tags("<table><tr><td><p>a<td>b<tr>") == [("table", 1), ("tr", 2), ("td", 3), ("p", 4), ("td", 3), ("tr", 2)]
    assert tags("<p>a<svg><p>b") == [("p", 1), ("svg", 2), ("p", 3)]


def test_training_pages_with_repeated_rows(spark):
    rows = [(k, f"<p>page {k}") for k in range(30)] + [(7, "<p>page 7")] * 200 + [(40, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(5)
    few = html_text.training_pages(pages, 10)
    assert len(few) <= 10 and len({s for s, _ in few}) == len(few) and [s for s, _ in few] == sorted(s for s, _ in few)
    assert len(html_text.training_pages(pages.dropDuplicates(), 10)) == 10
    assert html_text.training_pages(pages.limit(0)) == []
