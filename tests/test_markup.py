"""Price rows by tags: malformed and nested markup, on cases worked by hand."""

import pytest

from moodcast.sources import fixtures as FX
from moodcast.sources.markup import attribute, decode_entities, markup_prices_a, markup_prices_b, tokens
from moodcast.sources.prices import extract_prices
from tests.conftest import SF_SMALL, rows

DAY = 86400


def pages(spark, *htmls):
    return spark.createDataFrame([(f"p{i}", h) for i, h in enumerate(htmls)], "page_id string, html string")


def row(d, v, tag="tr", cls="datatable_row__Hk3IV"):
    return f"<{tag} class='{cls}'><td><time>{d}</time></td><td>{v}</td></{tag}>"


@pytest.mark.parametrize("text,want", [
    ("a&nbsp;b", "a\u00a0b"), ("1&#44;000&#x2E;5", "1,000.5"), ("&amp;lt;", "&lt;"), ("&#8364;", "€"),
    ("&#0;&#xD800;&#99999;", "&#0;&#xD800;&#99999;"), ("&;&#;&#x;", "&;&#;&#x;"), ("", ""), (None, None)])
def test_entities(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(decode_entities("t")).first()[0] == want


@pytest.mark.parametrize("tag,want", [
    ('<td id="a b">', "a b"), ("<td id='a'>", "a"), ("<td id=a>", "a"), ("<td ID = a/>", "a"), ("<td x=' id=z' id=a>", "a"),
    ("<td id>", ""), ("<td idx=1>", None), ("<td>", None), ('<td id="a &gt; b">', "a > b"), ('<td title="x > y" id=q>', "q")])
def test_attributes(spark, tag, want):
    df = spark.createDataFrame([(tag,)], "t string")
    assert df.select(attribute("t", "id")).first()[0] == want


def test_tokens(spark):
    got = [(r["tok"], r["name"]) for r in tokens(pages(
        spark, "a < b<!-- <td> --><TD title='>'>x</td ><script>'<tr>'</script><br/>")).orderBy("pos").collect()]
    assert got == [("a ", ""), ("<", ""), (" b", ""), ("<TD title='>'>", "td"), ("x", ""), ("</td >", "/td"), ("<br/>", "br")]


def test_layout_a(spark):
    nested = ("<table><tr class=datatable_row__Hk3IV><td><time>1/2/1970</time></td><td>1</td><td><table>"
              + row("1/3/1970", "2") + "</table></td></tr>" + row("01/04/1970", " 3,000.5 ") + "</table>")
    missing = "<table><tr class=datatable_row__Hk3IV><td><time>1/2/1970</time><td>4<tr class=datatable_row__Hk3IV><td><time>1/3/1970</time><td>5</table><p>9"
    broken = "</table></tr></td>" + "<table>" + row("1/2/1970", "6") + row("13/40/1970", "7") + row("1/3/1970", "x") + row("1/3/1970", "8")
    got = rows(markup_prices_a(pages(spark, nested, missing, broken, None, "", "<table></table>", "no tags")))
    want = [("p0", 0, DAY, 1.0), ("p0", 1, 2 * DAY, 2.0), ("p0", 2, 3 * DAY, 3000.5), ("p1", 0, DAY, 4.0), ("p1", 1, 2 * DAY, 5.0),
            ("p2", 0, DAY, 6.0), ("p2", 3, 2 * DAY, 8.0)]
    assert got == [(p, i, t, "nasdaq", v) for p, i, t, v in want]


def test_layout_b(spark):
    cell = "<td data-real-value={}>"
    body = "<table><tbody><tr>" + cell.format(60) + cell.format("1,5") + "</tr></tbody></table>"
    twice = f"<div id=results_box>{body}</div><div id=results_box>{body}</div>"
    deep = f"<section id='results_box'><section></section>{body}</section>{body}"
    other = f"<div id=results_boxes>{body}</div>" + body
    headless = "<div id=results_box><table><tr>" + cell.format(60) + cell.format(2) + "</tr></table></div>"
    got = rows(markup_prices_b(pages(spark, twice, deep, other, headless, None, "")))
    assert got == [("p0", 0, 60, "bitcoin", 15.0), ("p1", 0, 60, "bitcoin", 15.0)]


def test_long_page_and_many_quotes(spark):
    """Work follows the page's length, and a tag of many quotes stops no task."""
    many = "<table>" + "".join(row("1/2/1970", k) for k in range(20000)) + "</table>"
    quotes = "<td " + "'a'" * 50000 + ">" + "<table>" + row("1/2/1970", 1) + "</table>"
    got = markup_prices_a(pages(spark, many, quotes)).groupBy("page_id").count()
    assert rows(got) == [("p0", 20000), ("p1", 1)]


def test_agrees_with_the_fixed_patterns(spark):
    """On the plain pages both readers give the same rows."""
    plain = FX.Fixture(spark, SF_SMALL).price_pages()
    from moodcast.sources.markup import markup_prices
    assert rows(markup_prices(plain)) == rows(extract_prices(plain))


def test_pages_grow_with_events(spark):
    fx = FX.Fixture(spark, SF_SMALL)
    n = fx.events.count()
    assert fx.price_archive().count() >= n // FX.PAGE_EVENTS


def test_one_shuffle_of_tokens(spark):
    plan = markup_prices_b(pages(spark, "x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tasks_are_dealt_by_the_bytes_of_the_pages(spark):
    from moodcast.sources.markup import dealt
    pages = spark.createDataFrame([(f"p{i}", "x" * 1000) for i in range(100)] + [(None, "x" * 1000)], "page_id string, html string")
    assert dealt(pages, task_bytes=1000).rdd.getNumPartitions() == 100
    assert dealt(pages.unionAll(pages), task_bytes=1000).rdd.getNumPartitions() == 200
    assert dealt(pages.limit(0)).count() == 0
