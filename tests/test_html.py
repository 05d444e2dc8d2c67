import pytest

from quarrymill.operators.html import extract_all, read_markup


def doc(spark, html, path="/in/a-b_c.html"):
    return extract_all(spark.createDataFrame([(path, html)], "path string, html string"), "/in").first()


PAGE = "<html><head><title>T &amp; U</title></head><body><h1>Outside</h1><main><h1> In  side </h1><nav>menu</nav><p>One<p class='x no-search'>hidden<div>Two</div><h2>A</h2><h3>B</h3><h2>A</h2><h2> </h2><section data-search-exclude='false'>gone</section></main></body></html>"


def test_content_root_and_exclusions(spark):
    d = doc(spark, PAGE)
    assert (d["title"], d["title_source"], d["headings"]) == ("In side", "h1", ["A", "B"])
    assert d["body_text"] == "In side OneTwoABA"
    assert d["url"] == "/a-b_c"


def test_title_sources(spark):
    body = "<main>" + "word " * 20 + "</main>"
    d = doc(spark, f"<title>Kit</title><h1>Not in main</h1>{body}")
    assert (d["title"], d["title_source"]) == ("Kit", "title")
    d = doc(spark, body)
    assert (d["title"], d["title_source"]) == ("a b c", "filename")
    assert doc(spark, body, "/in/.html")["title"] == "Untitled"


@pytest.mark.parametrize(("html", "skipped"), [("<h1>Error 404</h1>", True), ("<h1>Room 4040</h1>", False), ("<body>short</body>", True), ("<body>short<h2>H</h2></body>", False), ("<title>x</title>", False), (None, True), ("", True)])
def test_skipped(spark, html, skipped):
    assert doc(spark, html)["skipped"] is skipped


def test_first_main_else_article_else_body():
    assert read_markup("<article>a</article><main>m</main><main>n</main>")["body"] == "m"
    assert read_markup("x<article>a</article>y")["body"] == "a"
    assert read_markup("just <b>text")["body"] == "just text"


def test_entities_and_raw_text():
    m = read_markup("<main>a &lt;b&gt; &amp c<script>if (a < b) x()</script><noscript>n</noscript><ul><li>1<li>2</ul></main>")
    assert m["body"] == "a <b> & c12"


def test_headings_are_at_most_twenty(spark):
    html = "<main>" + "".join(f"<h2>H{i}</h2>" for i in range(30)) + "</main>"
    assert doc(spark, html)["headings"] == [f"H{i}" for i in range(20)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([("/in/x.html", "<h1>X</h1>", "t", 5)], "path string, html string, title string, skipped int")
    assert extract_all(df, "/in").first()["title"] == "X"


@pytest.mark.parametrize(
    ("html", "title"),
    [("<title>A <b>B</b> &amp; C</title>", "A <b>B</b> & C"), ("<title>A<h1>x</h1></title>", "A<h1>x</h1>"), ("<title>T</title><textarea><h1>no</h1></textarea>", "T"), ("<title>T</title><iframe><h1>no</h1></iframe>", "T"), ("<title>T</title><xmp><h1>no</h1></xmp>", "T"), ("<title>T</title><noframes><h1>no</h1></noframes><noembed><h1>no</h1></noembed>", "T")],
)
def test_elements_without_markup(spark, html, title):
    assert doc(spark, html)["title"] == title


def test_text_of_elements_without_markup():
    assert read_markup("<main>a<textarea>&lt;x&gt; <i>y</i></textarea><xmp>&lt;<p></xmp>z</main>")["body"] == "a<x> <i>y</i>&lt;<p>z"
    assert read_markup("<title>T</title><main><svg><title>in <b>svg</b></title></svg>x</main>")["body"] == "x"
