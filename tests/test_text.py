import random
import re

import pytest
from pyspark.sql import functions as F

from quarrymill.constants import STOPWORDS
from quarrymill.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("text", "options", "expected"),
    [
        ("STEEP it 3 minutes (never 30!) and then pour", {}, ["steep", "minutes", "never", "30", "pour"]),
        ("Rye rye oats barley", {"dedupe": True, "limit": 2}, ["rye", "oats"]),
        ("Rye rye", {}, ["rye", "rye"]),
        ("café naïve", {}, ["caf", "na", "ve"]),
        ("constructor __proto__", {}, ["constructor", "proto"]),
        ("", {}, []),
        (None, {}, []),
        ("one two", {"limit": 0}, ["one", "two"]),
    ],
)
def test_tokenize(spark, text, options, expected):
    assert one(spark, T.tokenize(F.col("t").cast("string"), **options), t=text) == expected


def test_negative_limits_are_refused():
    with pytest.raises(ValueError):
        T.tokenize(None, limit=-1)
    with pytest.raises(ValueError):
        T.query_tokens("x", -1)


def test_tokens_agree_with_a_plain_model(spark):
    rng = random.Random(3)
    alphabet = list("aAbB09é -_.\n") + ["the ", "and ", "kit ", "x1 "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", T.tokenize(F.col("t")).alias("a"), T.tokenize_field(F.col("t"), 5).alias("b")).collect():
        kept = [w for w in re.findall("[a-z0-9]+", texts[r["i"]].lower()) if len(w) > 1 and w not in STOPWORDS]
        assert r["a"] == kept
        assert r["b"] == list(dict.fromkeys(kept))[:5] == T.query_tokens(texts[r["i"]], 5)


def test_stopwords_are_a_set():
    assert len(STOPWORDS) == len(set(STOPWORDS)) == 124


@pytest.mark.parametrize(("place", "length"), [(120, 121), (100, 201), (101, 102)])
def test_excerpt_cut(spark, place, length):
    body = "a" * place + " " + "b" * 300
    assert len(one(spark, T.excerpt(F.col("b")), b=body)) == length


def test_excerpt_of_short_text(spark):
    assert one(spark, T.excerpt(F.col("b")), b="x" * 200) == "x" * 200


def test_white_space(spark):
    assert one(spark, T.normalize_ws(F.col("t")), t=" a \n b﻿ c ") == "a b c"


def test_escape_and_highlight(spark):
    assert one(spark, T.escape_html(F.col("t")), t="<a href=\"x\">'&'</a>") == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"
    mark = lambda t, words: one(spark, T.highlight(F.col("t"), F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")), t=t)
    assert mark("Zebra and zebras", ["zebra"]) == "<mark>Zebra</mark> and zebras"
    assert mark("café foo_bar", ["caf", "foo"]) == "<mark>caf</mark>é foo_bar"
    assert mark("a & b", ["amp"]) == "a &<mark>amp</mark>; b"
    assert mark("a.b axb", ["a.b"]) == "<mark>a.b</mark> axb"
    assert mark("<x>", []) == "&lt;x&gt;"
    assert mark("kit kitten", ["kit", "kitten"]) == "<mark>kit</mark> <mark>kitten</mark>"
