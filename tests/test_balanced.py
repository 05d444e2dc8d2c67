import collections

import pytest

from quarrymill.operators import balanced

POSTING = "term string, doc_id bigint, field string, shard string, pages bigint"


def brute(data):
    seen = {("".join(c for c in t.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789"), d, f) for t, d, f, *_ in data if t is not None and d is not None}
    out = collections.defaultdict(lambda: (set(), set(), set()))
    for t, d, f in seen:
        for s, x in zip(out[t[:2]], (t, (t, d, f), d), strict=True):
            s.add(x)
    return {k: tuple(len(s) for s in v) for k, v in out.items()}


def test_report_of_odd_rows(spark):
    data = [("Ab-C", 1, "title", "x", 0), ("abc", 1, "title", "x", 0), ("abc​", 1, "body", "x", 0), (None, 1, "body", "x", 0), ("abd", None, "body", "x", 0), ("é", 2, None, "x", 0), ("zz", 2, None, "x", 0), ("zz", 2, "body", "x", 0), ("a", 5, "body", "x", 0)]
    got = {r["shard"]: (r["terms"], r["postings"], r["pages"]) for r in balanced.shard_report(spark.createDataFrame(data, POSTING)).collect()}
    assert got == brute(data)


def test_hot_shard_in_small_chunks(spark, monkeypatch):
    data = [(f"se{i % 40}", i % 97, "body", None, None) for i in range(4000)] + [(f"t{chr(97 + i % 20)}x", i, "body", None, None) for i in range(300)]
    df = spark.createDataFrame(data, POSTING).repartition(5)
    monkeypatch.setattr(balanced, "CHUNK_ROWS", 50)
    for fan_in in (2, 16):
        got = {r["shard"]: (r["terms"], r["postings"], r["pages"]) for r in balanced.shard_report(df, fan_in=fan_in).collect()}
        assert got == brute(data)


def test_empty(spark):
    assert balanced.shard_report(spark.createDataFrame([], POSTING)).count() == 0
    assert balanced.hot_shards(spark.createDataFrame([], POSTING)).count() == 0


@pytest.mark.parametrize("partials", [1, 2, 5, 17])
def test_tree_sum(spark, partials):
    df = spark.createDataFrame([("k", c, 1) for c in range(partials)] + [("one", 0, 7)], "key string, chunk bigint, n bigint")
    assert {tuple(r) for r in balanced.tree_sum(df, ["key"], ["n"], "chunk", partials, 3).collect()} == {("k", partials), ("one", 7)}
