"""Main content of markup (1)."""

import pytest

from quarrymill.llm import containers

PAGE = "id bigint, site string, html string, article string"


def page(site, k):
    return f"""<html><head><title>T</title></head><body class="b{k}"><header><nav class="menu"><ul><li><a href="/">Home</a><li><a href="/x">News {k}</a></ul></nav></header>
    <div class="row-{k}"><div class="cookie">This place of {site} uses cookies.</div><article class="post p{k}"><h1>Page {k} of {site}</h1><p>Its own words {k}, with a <a href="y">link</a> in them.</p><ul class="list"><li>first {k}</li><li>second {k}</li></ul>
    <aside class="more"><a href="a">More {k}</a> <a href="b">Even more</a></aside></article></div><script>var x = {k}</script><footer>Rights of {site}</footer></body></html>"""


def want(site, k):
    return f"Page {k} of {site}\nIts own words {k}, with a link in them.\nfirst {k}\nsecond {k}"


@pytest.mark.parametrize("sent", [10**6, 0])
def test_articles_of_markup(spark, sent):
    rows = [(s * 100 + k, f"s{s}.example", page(f"s{s}", k), "x") for s in range(3) for k in range(8)]
    got = {r["id"]: r["article"] for r in containers.markup_articles(spark.createDataFrame(rows, PAGE), sent_paths=sent).collect()}
    assert got == {s * 100 + k: want(f"s{s}", k) for s in range(3) for k in range(8)}


@pytest.mark.parametrize("sent", [10**6, 0])
def test_odd_markup(spark, sent):
    odd = [(1, None, page("s", 1), "x"), (2, "t", "", "x"), (3, "t", None, "x"), (None, "t", "<p>x", "x"), (4, "t", "<p>" + "word " * 50_000, "x"), (5, "t", "<div><p>a<div>b", "x"), (5, "t", "<div><p>a<div>b", "x")]
    got = sorted((r["id"], r["article"]) for r in containers.markup_articles(spark.createDataFrame(odd, PAGE), sent_paths=sent).collect())
    assert [i for i, _ in got] == [1, 2, 4, 5, 5] and got[1][1] == "" and got[3][1] == "a\nb" and len(got[2][1]) == 249_999 and "Home" in got[0][1]
    assert containers.markup_articles(spark.createDataFrame([], PAGE), sent_paths=sent).count() == 0
