"""Term frequencies (problem 2) and repeated lines (problem 3)."""

import collections
import re

import pytest
import regex

from quarrymill.llm import repeated, terms

POSTING = "term string, doc_id bigint, field string, postings string, bucket int"


def brute_terms(data):
    seen = {(re.sub("[^a-z0-9]", "", t.lower()), d, f) for t, d, f, *_ in data if t is not None and d is not None}
    n, pages = collections.Counter(t for t, _, _ in seen), collections.defaultdict(set)
    for t, d, _ in seen:
        pages[t].add(d)
    return {t: (n[t], len(pages[t])) for t in n}


@pytest.mark.parametrize("sizes", [{}, {"leaf_rows": 40, "task_rows": 25}, {"leaf_rows": 3, "task_rows": 10_000}])
def test_frequencies_with_splits(spark, sizes):
    data = [("Hot", i, "body", "x", 1) for i in range(400)] + [("hot ", i, "title", "x", 1) for i in range(0, 400, 3)] + [(f"t{i % 37}", i % 11, None, "x", 1) for i in range(300)]
    data += [(None, 1, "body", "x", 1), ("a", None, "body", "x", 1), ("é!", 1, "body", "x", 1), ("x" * 20_000, 1, "body", "x", 1)] + [("hot", 5, "body", "x", 1)] * 20
    df = spark.createDataFrame(data, POSTING).repartition(6)
    assert {r["term"]: (r["postings"], r["pages"]) for r in terms.term_frequencies(df, **sizes).collect()} == brute_terms(data)


def test_marks(spark):
    data = [("common", i, "body", None, None) for i in range(26)] + [(f"some{i % 4}", i, "body", None, None) for i in range(100)] + [("rare", i, "body", None, None) for i in range(2)]
    marks = {r["term"]: r["mark"] for r in terms.marked_terms(spark.createDataFrame(data, POSTING)).collect()}
    assert marks["common"] == "common" and marks["rare"] == "rare" and marks["some1"] is None  # a quarter is not more than a quarter


def test_no_postings(spark):
    empty = spark.createDataFrame([], POSTING)
    assert terms.term_frequencies(empty).count() == 0 and terms.found(empty).count() == 0


PAGE = "id bigint, site string, body_text string, line_no int, k1 string"


def brute_lines(data, least=6):
    by = collections.defaultdict(set)
    where = []
    for i, site, text, *_ in data:
        if i is None or site is None or text is None:
            continue
        for n, line in enumerate(text.split("\n"), 1):
            if key := regex.sub(r"\P{L}+", "", line.lower()):
                by[site, key].add(i)
                where.append((i, n, site, key))
    return {(i, n, len(by[s, k])) for i, n, s, k in where if len(by[s, k]) >= least}


def test_repeated_lines(spark):
    data = [(i, "s1", f"Legal  notice {i}!\n\nbody of {chr(97 + i)}\r\nLEGAL notice", 0, "") for i in range(9)]
    data += [(i, "s2", "Five only", 0, "") for i in range(20, 25)] + [(20, "s2", "Five only", 0, "")] * 3
    data += [(30, None, "Legal notice", 0, ""), (None, "s1", "Legal notice", 0, ""), (31, "s1", None, 0, ""), (32, "s1", "", 0, ""), (33, "s1", "é" * 100_000 + "\nlegal notice", 0, "")]
    data += [(i, "s3", "ΣΟΦΟΣ ΑΣ\n1234", 0, "") for i in range(40, 46)]
    df = spark.createDataFrame(data, PAGE)
    got = {tuple(r) for r in repeated.repeated_lines(df).collect()}
    assert got == brute_lines(data)
    clean = {r["id"]: r["clean_text"] for r in repeated.without_lines(df, repeated.repeated_lines(df)).collect()}
    assert clean[3] == "\nbody of d\r" and clean[20] == "Five only" and clean[31] is None


def test_bitmaps_over_containers(spark, monkeypatch):
    import numpy as np

    low = np.arange(0, 60_000, 3, dtype="<u2")
    assert (repeated.unpack(repeated.pack(low)) == low).all() and len(repeated.pack(low)) == 8193
    assert (repeated.unpack(repeated.pack(low[:50])) == low[:50]).all()
    monkeypatch.setattr(repeated, "CHUNK_LINES", 7)
    monkeypatch.setattr(repeated, "ARRAY_MAX", 3)
    data = [(i * 40_000 - 80_000, "s", f"same line\nown {chr(97 + i)}", 0, "") for i in range(12)] + [(5, "s", "Same, line", 0, "")]
    df = spark.createDataFrame(data * 2, PAGE).repartition(5)
    assert {tuple(r) for r in repeated.repeated_lines(df).collect()} == brute_lines(data)


def test_no_lines(spark):
    assert repeated.repeated_lines(spark.createDataFrame([], PAGE)).count() == 0
