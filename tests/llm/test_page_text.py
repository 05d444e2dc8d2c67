"""Main content (1), residue (4) and severity (9)."""

import duckdb
import pytest

from quarrymill.llm import boilerplate, residue, severity

PAGE = "kind string, id bigint, site string, title string, headings array<string>, text string, lines string"


def site_pages(n=12):
    out = []
    for s in range(4):
        for k in range(n):
            name = f"Topic{chr(97 + s)}{chr(97 + k)}word"
            text = [
                "Home · Docs · Blog", "Skip to content", "", f"Using {name}", "By Copper desk, 6 min read", f"Why {name} works", f"The {name} keeps {k + 3} files near the {name}, and each of them has a reader of its own.",
                "Advertisement", f"- open the {name} before the others are read", f"run {name.lower()} --fast", "See also: Another thing", "Related articles", f"Notes on Other{k}", f"© 2024 Brand{s}. All rights reserved.",
            ]
            out.append(("p", s * 100 + k, f"docs.brand{s}name.example", f"Using {name} – Brand{s}name", [f"Why {name} works"], "\n".join(text), "x"))
    return out


FURNITURE = [1, 2, 5, 8, 11, 12, 13, 14]


@pytest.mark.parametrize("sent", [10**6, 3])
def test_furniture(spark, sent):
    df = spark.createDataFrame(site_pages(), PAGE)
    got = boilerplate.furniture_lines(df, sent_paths=sent).collect()
    assert len(got) == 48 and all(r["lines"] == FURNITURE for r in got)


def test_articles(spark):
    a = {r["id"]: r["article"].split("\n") for r in boilerplate.articles(spark.createDataFrame(site_pages(), PAGE)).collect()}
    assert a[0][1] == "Using Topicaaword" and len(a[0]) == 6


def test_odd_pages(spark):
    odd = [("p", 1, None, None, None, "One line", "x"), ("p", 2, "s", None, [], "", "x"), ("p", 3, "s", "T", None, None, "x"), ("p", None, "s", "T", None, "x", "x"), ("p", 4, "s", "", [None, ""], " \n\t\n", "x"), ("p", 5, "s", "T", None, "word " * 50_000, "x")]
    got = {r["id"]: r["lines"] for r in boilerplate.furniture_lines(spark.createDataFrame(odd + odd[:1], PAGE)).collect()}
    assert got == {1: [], 2: [], 4: [], 5: []}
    assert boilerplate.furniture_lines(spark.createDataFrame([], PAGE)).count() == 0


def test_pages_in_scripts_without_blanks(spark):
    """Paragraphs under 160 characters are running text in Chinese, too."""
    pages = []
    for s in range(4):
        for k in range(12):
            # ideographs of their own for every page
            own = "".join(chr(0x4E00 + (s * 1200 + k * 97 + i) % 20000) for i in range(40))
            text = ["首页 · 文档 · 博客", f"关于{own[:6]}", f"{own[:12]}，这里有许多文字，读者可以慢慢看。", f"{own[12:30]}的设置写在文件里，每次都要保存好。{own[:6]}", "© 2024 版权所有"]
            pages.append(("p", s * 100 + k, f"brand{s}name.example", f"关于{own[:6]}", [], "\n".join(text), "x"))
    got = boilerplate.furniture_lines(spark.createDataFrame(pages, PAGE)).collect()
    assert len(got) == 48 and all(r["lines"] == [1, 5] for r in got)


def test_long_notices_are_voted_out(spark):
    notice = "We and our partners use cookies and similar means to store and read information on your device, to measure how pages are read, and to keep them safe; you can agree to all of it or choose what you allow, now or at any later time, in the settings that are linked at the foot of every page, and your choice is kept for a year. " + "It holds for all the pages of this place and of its branches elsewhere."
    pages = [(k, i, s, t, h, x + "\n" + notice, e) for k, i, s, t, h, x, e in site_pages()]
    got = boilerplate.furniture_lines(spark.createDataFrame(pages, PAGE)).collect()
    assert len(notice) > 380 and all(r["lines"] == [*FURNITURE, 15] for r in got)


def test_excerpts_of_other_text_are_judged_by_themselves(spark):
    pages = site_pages()
    bodies = spark.createDataFrame([(i, s, t, h, x) for _, i, s, t, h, x, _ in pages], "id bigint, site string, title string, headings array<string>, body_text string")
    _, i, s, t, h, x, _ = pages[0]
    other = "\n".join(["Skip to content", t.split(" – ")[0], x.split("\n")[6], "Advertisement"])
    extracted = spark.createDataFrame([(1, i, s, t, h, other), (2, 999, s, t, h, other)], "extract_id bigint, doc_id bigint, site string, title string, headings array<string>, excerpt string")
    got = {(r["record_id"], r["line_no"]) for r in boilerplate.found(bodies, extracted).where("record_table = 'extracted_documents'").collect()}
    assert got == {(1, 1), (1, 4), (2, 1), (2, 4)}


def test_excerpts_follow_their_bodies(spark):
    pages = site_pages()
    bodies = spark.createDataFrame([(i, s, t, h, x) for _, i, s, t, h, x, _ in pages], "id bigint, site string, title string, headings array<string>, body_text string")
    extracted = spark.createDataFrame([(1000 + i, i, s, t, h, "\n".join(x.split("\n")[:5]) + "…") for _, i, s, t, h, x, _ in pages] + [(1, None, "s", "T", [], "A sentence of a page that never came."), (2, 0, "s", "T", [], None)], "extract_id bigint, doc_id bigint, site string, title string, headings array<string>, excerpt string")
    got = {(r["record_table"], r["record_id"], r["line_no"]) for r in boilerplate.found(bodies, extracted).collect()}
    assert got == {("indexable_documents", i, n) for _, i, *_ in pages for n in FURNITURE} | {("extracted_documents", 1000 + i, n) for _, i, *_ in pages for n in (1, 2, 5)}


@pytest.mark.parametrize(
    ("text", "case"),
    [("Hello {{ name }}!", True), ("Welcome back, undefined!", True), ("the price is [Insert price here]", True), ("see #REF! there", True), ("Write `{{ name }}` there", False), ('it says "undefined is not a function"', False), ("a[0] = 1", False), ("{ color: red }", False), ("nullable", False), ("Dear <your name>,", True), ("100%% sure", False), ("%%count%% files", True)],
)
def test_slots(text, case):
    assert bool(residue.slots(text)) is case


@pytest.fixture(scope="module")
def natural():
    con = duckdb.connect()
    d = "/root/testdata/sf0.01"
    bodies = [r[0] for r in con.execute(f"SELECT body_text FROM '{d}/indexable_documents.parquet' WHERE body_text IS NOT NULL ORDER BY hash(id) LIMIT 600").fetchall()]
    titles = [r[0] for r in con.execute(f"SELECT title FROM '{d}/extracted_documents.parquet' WHERE title IS NOT NULL ORDER BY hash(extract_id) LIMIT 1000").fetchall()]
    return residue.Ratios(bodies + titles, ["Hopirami", "Balegule", "Zidemodu"])


@pytest.mark.parametrize(
    ("title", "case"),
    [("404 Not Found", True), ("Untitled document", True), ("Please enable JavaScript to view Kofizubi.", True), ("{{ page.title }}", True), ("Seite nicht gefunden", True), ("Lorem ipsum dolor", True), ("NaN", True), ("Handling 404 responses in Hopirami", False), ("Writing {{ mustache }} tags in Hopirami", False), ("Configuring Hopirami", False), ("The gateway behind Balegule", False), ("", False)],
)
def test_titles(natural, title, case):
    means, _, _ = natural.score([title])
    assert residue.title_is_residue(title, means[0], residue.slot_ratios(natural, [title], True)[0]) is case


ARTICLE = "Readers who match a codepoint rarely notice the image behind the old commands. The setting for manifests is compressed together with the signature in one segment of the file."


@pytest.mark.parametrize(
    ("body", "case"),
    [(f"Using X\n{ARTICLE}", False), ("Oops! Zidemodu is not here.\nPrivacy · Terms", True), (f"{ARTICLE}\nHello {{{{ name }}}}, welcome", True), ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor", True), (f"{ARTICLE}\nLorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", True), (f"{ARTICLE}\nA request is answered with status 404 and the words \"Page not found\".\n{ARTICLE}", False), ("\n \n", False)],
)
def test_bodies(natural, body, case):
    lines = body.split("\n")
    assert residue.body_is_residue(lines, *natural.score(lines), residue.slot_ratios(natural, lines)) is case


def test_residue_tables(spark):
    bodies = spark.createDataFrame([(1, ARTICLE, "x"), (2, "Hello {{ name }}", "x"), (2, "Hello {{ name }}", "x"), (3, None, "x"), (None, "Hello {{ name }}", "x"), (4, "", "x"), (5, "word " * 50_000, "x")], "id bigint, body_text string, text string")
    titles = spark.createDataFrame([(1, "s", "{{ title }}"), (2, None, "Fine words here"), (3, "s", None)], "extract_id bigint, site string, title string")
    got = {tuple(r) for r in residue.found(bodies, titles).collect()}
    assert got == {("indexable_documents", 2), ("extracted_documents", 1)}
    model = residue.fit(bodies, titles)
    assert sorted(str(r["id"]) for r in residue.without_residue(bodies, residue.residue_bodies(bodies, model), "id").collect()) == ["1", "3", "4", "5", "None"]
    none = bodies.limit(0)
    assert residue.found(none, titles.limit(0)).count() == 0


def test_every_text_is_counted(spark):
    """However many there are, and however they are dealt into parts."""
    import random

    import numpy as np

    rng = random.Random(4)
    own = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(5_000)]
    bodies = spark.createDataFrame([(i, f"{ARTICLE} {w}\n\nHello {{{{ name }}}}") for i, w in enumerate(own[:4_500])], "id bigint, body_text string")
    titles = spark.createDataFrame([(i, "s", f"Using {w}") for i, w in enumerate(own[4_500:])], "extract_id bigint, site string, title string")
    one, many = residue.fit(bodies.coalesce(1), titles.coalesce(1)), residue.fit(bodies.repartition(5), titles.repartition(3))
    for a, b in zip(one.tables, many.tables, strict=True):
        assert np.array_equal(a, b, equal_nan=True)
    u, _ = residue._bytes(own)
    h5, _ = residue._hashes(u)
    assert not np.isnan(one.tables[0][h5, 0].reshape(-1)[np.arange(len(own)) * 13 + 12]).any()  # a run within each word


def test_a_slot_that_all_titles_share(spark):
    """However often it comes, a slot doesn't count as natural text."""
    titles = spark.createDataFrame([(i, "s", "Welcome, [first name]" if i % 40 == 0 else f"Using the gateway {i}") for i in range(3_000)], "extract_id bigint, site string, title string")
    bodies = spark.createDataFrame([(i, f"{ARTICLE} {i}") for i in range(300)], "id bigint, body_text string")
    assert {r["record_id"] for r in residue.found(bodies, titles).collect()} == set(range(0, 3_000, 40))


def test_counts_add_up():
    """Each run counts; runs over the ends of lines don't depend on neighbours."""
    import numpy as np

    lines = ["Status 404 of  Kofi\tzubi", "", "  x ", "ÄÖÜ ٣7 ẞ", "Status 404 of Kofi zubi"] * 3
    whole = residue.Counts().add(lines)
    parts = [residue.Counts().add(lines[i : i + 2]) for i in range(0, len(lines), 2)]
    for n, k in (("n5", "k5"), ("n3", "k3")):
        assert np.array_equal(getattr(whole, n), sum(getattr(p, n) for p in parts))
        assert np.array_equal(getattr(whole, k), np.max([getattr(p, k) for p in parts], axis=0))
    again = residue.Counts.of_rows(*whole.rows())
    assert all(np.array_equal(getattr(whole, x), getattr(again, x)) for x in ("n5", "k5", "n3", "k3"))
    assert residue._normal(lines[:4]).decode() == "status \x01 of kofi zubi\n\nx\näöü 00 ss\n"
    assert residue._normal(["a\nb", "v1.404", "404, 4042 404"]).decode() == "a b\nv0.000\n000, 0000 \x01\n"


def test_spelling_tricks():
    w = severity.Words({"idiot", "fuck", "moron", "asshole", "vermin"})
    assert [w.sentence(s) for s in ("You i.diot!", "f u c k this", "M0r0n", "a$$h0le", "v****n", "mooooron", "іdіоt", "plain words, v3")] == [["you", "idiot"], ["fuck", "this"], ["moron"], ["asshole"], ["vermin"], ["moron"], ["idiot"], ["plain", "words", "v3"]]


def test_severity_of_held_out_documents():
    con = duckdb.connect()
    d = "/root/testdata/sf0.1"
    rows = con.execute(f"SELECT any_value(text), max(label <> 'fine'), any_value(label) FROM '{d}/review_labels.parquet' JOIN '{d}/documents.parquet' USING (doc_id) GROUP BY doc_id HAVING count(DISTINCT label) = 1 ORDER BY hash(doc_id)").fetchall()
    background = [r[0] for r in con.execute(f"SELECT text FROM '{d}/documents.parquet' WHERE text IS NOT NULL ORDER BY hash(doc_id + 1) LIMIT 500").fetchall()]
    train, test = rows[::2], rows[1::2]
    m = severity.Severity([(t, severity.GRADES.index(g)) for t, _, g in train], background)
    said = [m.grade(s)[1] > severity.FOUND_AT for s in m.worst_many([t for t, *_ in test])]
    hits = sum(a and b for a, (_, b, _) in zip(said, test, strict=True))
    assert hits >= 0.95 * sum(said) and hits >= 0.8 * sum(b for _, b, _ in test)  # some labels are wrong
    some = [t for t, *_ in test[:40]] + [None, "", "..."]
    assert m.worst_many(some) == pytest.approx([m.worst(t) for t in some])


def test_severity_tables(spark):
    docs = spark.createDataFrame([(1, "Shut up, you stupid idiot, and fix your own table.", "a", 0.0), (2, "The table has rows.", "a", 0.0), (3, None, None, 0.0), (4, "", "b", 0.0), (None, "You worthless moron.", "b", 0.0), (1, "Shut up, you stupid idiot, and fix your own table.", "a", 0.0), (5, "word " * 50_000, "b", 0.0)], "doc_id bigint, text string, source string, severity double")
    labels = spark.createDataFrame([(2, "fine"), (1, "abusive"), (1, "fine"), (None, "fine"), (2, None)], "doc_id bigint, label string")
    assert {r["doc_id"] for r in severity.found(docs, labels).collect()} == {1}
    scores = severity.severities(docs, severity.fit(docs, labels)).collect()
    assert len(scores) == 7 and {r["severity"] for r in scores if r["doc_id"] in (3, 4)} == {0.0}
    assert {r["source"]: (r["documents"], r["harmful"]) for r in severity.rates(docs, labels).collect()} == {"a": (3, 2), None: (1, 0), "b": (3, 1)}
    assert severity.found(docs.limit(0), labels.limit(0)).count() == 0


def test_tokens_of_many_words_are_read_whole():
    assert severity.Words(set())["x," * 300 + "last"] == ("x",) * 300 + ("last",)
