import json
import random

import pytest
from pyspark.sql import functions as F

from quarrymill import cli
from quarrymill.functions.text import query_tokens
from quarrymill.operators import indexer, shards
from quarrymill.operators.search import Engine, clear_search_cache, create_search
from quarrymill.sources import index_files, pages

DOC = "id bigint, url string, title string, headings array<string>, excerpt string, body_text string"


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), DOC)


#: Documents of a small library; the last has postings but is never stored.
LIBRARY = [
    (10, "/tea/green", "Green tea", ["Steeping"], "Leaves <and> water", "green leaves need cool water"),
    (11, "/tea/black", "Black tea", ["Steeping", "Milk"], "Strong", "black leaves with milk"),
    (12, "/mate", "Élan of mate", [], "", "mate herb brew"),
    (13, "/oolong", "oolong", ["Green or black"], None, "half black half green brew"),
    (14, "/gone", "Milk", ["Green milk"], "x", "milk milk"),
]


def test_field_weights(spark, rows):
    d = docs(spark, LIBRARY[1], (0, None, None, None, None, None))
    assert rows(indexer.build_postings(d)) == [("black", 11, 6), ("leaves", 11, 1), ("milk", 11, 4), ("steeping", 11, 3), ("tea", 11, 5)]
    summed = indexer.document_terms(d).groupBy("term", "doc_id").agg(F.sum("weight").alias("weight"))
    assert rows(summed) == rows(indexer.build_postings(d))


def test_nested_postings(spark, rows):
    p = spark.createDataFrame([("b", 2, 1), ("a", 3, 1), ("a", 1, 5)], "term string, doc_id bigint, weight bigint")
    assert rows(indexer.nest_postings(p)) == [("a", [[1, 5], [3, 1]]), ("b", [[2, 1]])]


def test_ids_follow_the_paths(spark, rows):
    names = [f"p{i:04d}" for i in range(500)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(n, n) for n in names], "path string, id string").repartition(7)
    got = indexer.assign_ids(df).select("id", "path").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(i, f"p{i:04d}") for i in range(500)]
    assert indexer.assign_ids(df.limit(0)).count() == 0


@pytest.mark.parametrize(("term", "key"), [("oolong", "oo"), ("TEA", "te"), ("7up", "7u"), ("q", "_other"), ("", "_other"), ("-x", "_other"), ("x-ray", "_other"), ("üb", "_other"), ("te\n", "te"), ("te ", "te"), ("t e", "_other")])
def test_shard_keys(spark, term, key):
    assert shards.shard_key_of(term) == key
    assert spark.range(1).select(shards.shard_key(F.lit(term))).first()[0] == key


def test_shards_and_stats(spark, rows):
    s = shards.build_shards(indexer.build_postings(docs(spark, *LIBRARY)).where("term in ('tea', 'oolong', 'brew', 'black', 'milk', 'mate')"))
    assert rows(shards.shard_terms(s)) == [("bl", 1), ("br", 1), ("ma", 1), ("mi", 1), ("oo", 1), ("te", 1)]
    assert tuple(shards.shard_stats(s).first()) == (6, 6, 1)
    wide = shards.build_shards(s.drop("shard"), 1)
    assert rows(shards.oversize_shards(wide, 1)) == [("b", 2), ("m", 2)] and not rows(shards.oversize_shards(wide, 0))
    assert tuple(shards.shard_stats(s.limit(0)).first()) == (0, 0, 0)


@pytest.mark.parametrize(("known", "path"), [(["te", "_other"], "inv/te.json"), (["mi", "_other"], "inv/_other.json"), (["mi"], None)])
def test_resolving_paths(spark, known, path):
    meta = shards.sharding_meta(known)
    assert shards.resolve_shard_path("tea", meta) == path
    catalog = spark.createDataFrame(list(meta["map"].items()), "shard string, path string")
    assert shards.resolve_shard_paths(spark.createDataFrame([("tea",)], "token string"), catalog).first()["path"] == path


def engine(spark, sharded=True, **options):
    stored, postings = indexer.build_index(docs(spark, *LIBRARY))
    stored = stored.where("id < 14")
    if not sharded:
        return Engine(stored, postings, None, **options)
    s = shards.build_shards(postings)
    return Engine(stored, s, shards.sharding_meta([r[0] for r in s.select("shard").distinct().collect()]), **options)


@pytest.mark.parametrize("sharded", [True, False])
def test_queries(spark, sharded):
    e = engine(spark, sharded)
    got = lambda q, **o: [(r["rank"], r["url"], r["score"]) for r in e.query(q, **o).collect()]
    assert got("green") == [(1, "/tea/green", 6), (2, "/oolong", 4)]
    assert got("green black") == [(1, "/oolong", 10), (2, "/tea/black", 6), (3, "/tea/green", 6)]  # equal scores by title
    assert got(["steeping", "leaves"]) == [(1, "/tea/black", 6), (2, "/tea/green", 6)]
    assert got("brew") == [(1, "/mate", 1), (2, "/oolong", 1)]  # accents don't count
    assert got("milk") == [(2, "/tea/black", 4)]  # the best has no stored document
    assert got("milk", limit=1) == [] and got("milk", limit=0) == [] and got("the of") == [] and got("constructor") == []
    assert got("green black", max_tokens=1) == got("green")
    with pytest.raises(ValueError):
        e.query("tea", limit=-1)
    assert e.query("cool leaves", highlight_matches=True).first()["excerpt"] == "<mark>Leaves</mark> &lt;and&gt; water"
    assert e.query("cool").first()["excerpt"] == "Leaves <and> water"
    e.prewarm("green milk")
    assert got("green") == [(1, "/tea/green", 6), (2, "/oolong", 4)]
    e.close()


def test_shards_that_are_kept(spark):
    e = engine(spark, max_shard_cache=2, keep=True)
    for q, kept in (("tea", ["te"]), ("milk", ["te", "mi"]), ("tea", ["mi", "te"]), ("brew", ["te", "br"]), ("green black milk", ["te", "br"])):
        assert e.query(q).count() and list(e._warm) == kept  # the one used longest ago goes; three don't fit and are read where they lie
    e.close()
    cold = engine(spark, max_shard_cache=0)
    cold.prewarm("tea")
    assert not cold._warm and cold.query("tea").count() == 2
    with pytest.raises(ValueError):
        engine(spark, max_shard_cache=-1)


def test_queries_at_the_same_time_read_a_shard_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    e = engine(spark, keep=True)
    reads = []
    scan = e.postings

    class Counted:
        sparkSession = scan.sparkSession

        def where(self, condition):
            reads.append(condition)
            return scan.where(condition)

    e.postings = Counted()
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda _: e.query("tea").count(), range(4))) == [2] * 4
    assert len(reads) == 1
    e.close()


@pytest.mark.parametrize("sent", [0, 100])
def test_a_batch_is_its_queries(spark, sent):
    e = engine(spark)
    texts = {1: "green black", 2: "milk", 3: "the", 4: "brew tea leaves", 5: None}
    q = spark.createDataFrame([*texts.items(), (None, "tea")], "query_id int, text string")
    batch = {(r["query_id"], r["rank"]): (r["url"], r["score"], r["excerpt"]) for r in e.batch_query(q, 2, True, sent_queries=sent).collect()}
    single = {(k, r["rank"]): (r["url"], r["score"], r["excerpt"]) for k, t in texts.items() if t for r in e.query(t, 2, True).collect()}
    assert batch == single


def test_search_model(spark):
    """Against a plain scoring loop."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    d = docs(spark, *[(i, f"/{i}", " ".join(rng.choices(words, k=2)), [rng.choice(words)], "x", " ".join(rng.choices(words, k=6))) for i in range(60)])
    stored, postings = indexer.build_index(d)
    titles = {r["id"]: r["title"] for r in d.collect()}
    known = {}
    for r in postings.collect():
        known.setdefault(r["term"], []).append((r["doc_id"], r["weight"]))
    e = Engine(stored, postings)
    for text in ("w1 w2 w3", "w5", "w4 w11 w0 w4"):
        score, first = {}, {}
        for pos, t in enumerate(query_tokens(text)):
            for doc, w in sorted(known.get(t, [])):
                n, s = score.get(doc, (0, 0))
                score[doc] = (n + 1, s + w)
                first.setdefault(doc, (pos, doc))
        want = sorted(((s + 2 * (n - 1), doc) for doc, (n, s) in score.items()), key=lambda x: (-x[0], titles[x[1]], first[x[1]]))[:10]
        assert [(r["score"], r["url"]) for r in e.query(text).collect()] == [(s, f"/{doc}") for s, doc in want]


@pytest.mark.parametrize("sharded", [True, False])
def test_json_round_trip(spark, tmp_path, sharded):
    quoted = (15, "/q", 'Pot "B" é', [], None, "cup\\saucer 1887")
    stored, postings = indexer.build_index(docs(spark, *LIBRARY, quoted))
    meta = index_files.write_json_index(stored, postings, str(tmp_path), sharded=sharded, generated_at="2025-06-07T08:09:10.000Z")
    on_disk = json.loads((tmp_path / "index.meta.json").read_text())
    assert on_disk == meta and on_disk["docCount"] == 6 and on_disk["version"] == (2 if sharded else 1)
    assert (tmp_path / "index.meta.json").read_text().startswith('{\n  "version"')
    saved = json.loads((tmp_path / "docs.json").read_text())
    assert [d["id"] for d in saved] == [10, 11, 12, 13, 14, 15] and saved[5] == {"id": 15, "url": "/q", "title": 'Pot "B" é', "headings": [], "excerpt": None}
    part = json.loads((tmp_path / ("inv/mi.json" if sharded else "index.inv.json")).read_text())
    assert part["terms"]["milk"] == [[11, 4], [14, 9]] and list(part["terms"]) == sorted(part["terms"])
    clear_search_cache()
    e = create_search(spark, str(tmp_path / "index.meta.json"))
    assert e is create_search(spark, str(tmp_path / "index.meta.json")) and e is not create_search(spark, str(tmp_path / "index.meta.json"), max_shard_cache=1)
    assert [(r["url"], r["score"]) for r in e.query("1887 milk").collect()] == [("/gone", 9), ("/tea/black", 4), ("/q", 1)]
    clear_search_cache()


class TextReader:
    """Reads rows and text, and remembers what it was asked for."""

    def __init__(self, spark):
        self.spark, self.asked = spark, []

    def __call__(self, paths, schema):
        self.asked += [(p.rpartition("/")[2], "rows") for p in paths]
        return self.spark.read.schema(schema).option("multiLine", True).json(paths)

    def text(self, paths, separator):
        self.asked += [(p.rpartition("/")[2], "text") for p in paths]
        return self.spark.read.option("lineSep", separator).text(paths)


ODD_TERMS = ["a", 'b"q', "c\\x", "é]]x", "]", "日本", "q,[[1", "}}"] + [f"w{i}" for i in range(40)]


def in_small_splits(spark, size):
    for key, value in {"maxPartitionBytes": size, "openCostInBytes": 1, "minPartitionNum": 1}.items():
        spark.conf.set(f"spark.sql.files.{key}", value)


@pytest.fixture
def splits(spark):
    yield lambda size: in_small_splits(spark, size)
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


@pytest.mark.parametrize("size", [97, 1 << 20])
def test_one_file_is_read_term_by_term(spark, tmp_path, splits, size):
    """No task holds more of an index of version 1 than a term's list."""
    postings = [(t, i * 37, i % 9 + 1) for k, t in enumerate(ODD_TERMS) for i in range(k % 5 + 1)]
    stored = indexer.stored_docs(docs(spark, *LIBRARY))
    index_files.write_json_index(stored, spark.createDataFrame(postings, "term string, doc_id bigint, weight bigint"), str(tmp_path), sharded=False)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["docs.json", "index.inv.json", "index.meta.json"]
    assert list(json.loads((tmp_path / "index.inv.json").read_text())["terms"])[-2:] == ["w9", "日本"]
    splits(size)
    got = index_files.open_index(spark, str(tmp_path / "index.meta.json"))[1]
    assert sorted(map(tuple, got.collect())) == sorted(postings)
    lists = [len(r["value"]) for r in spark.read.option("lineSep", index_files.LIST_END).text(str(tmp_path / "index.inv.json")).collect()]
    assert len(lists) == len(ODD_TERMS) + 1 and "FileScan text" in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() > 5 or size > 97


@pytest.mark.parametrize(
    "text",
    ['{"terms":{}}', '{"terms":{"a":[],"b":[[1,2]]}}', '{"terms":{"x]]y":[[1,2]],"b":[[3,4]]}}', '{ "terms": {"a": [[1, 2], [3, 4]], "b": [[5, 6]]}}\n', '{"version":1,"terms":{"a":[[1,2]]}}', '{"terms":{"a":[[1,2]]},"more":[[1]]}', '{"terms":{"a":[\n[1,2]\n],"b":[[1,\n2]\n]}}', '{"terms":{"a":[[1,2]],"b":[[3,4'],
)
def test_files_of_other_writers(spark, tmp_path, text):
    """As a JSON parser has them; of a file that is cut off, nothing."""
    (tmp_path / "i.json").write_text(text)
    try:
        want = sorted((t, *p) for t, pairs in json.loads(text)["terms"].items() for p in pairs)
    except ValueError:
        want = []
    reader = TextReader(spark)
    for r in (None, reader, reader.__call__):
        assert sorted(map(tuple, index_files.read_single(spark, str(tmp_path / "i.json"), r).collect())) == want


def test_a_reader_gives_text(spark, tmp_path):
    """Beside the manifest and the documents, no file is asked for by rows."""
    index_files.write_json_index(*indexer.build_index(docs(spark, *LIBRARY)), str(tmp_path), sharded=False)
    clear_search_cache()
    reader = TextReader(spark)
    assert [r["score"] for r in create_search(spark, str(tmp_path / "index.meta.json"), reader).query("brew").collect()] == [1, 1]
    assert reader.asked == [("index.meta.json", "rows"), ("docs.json", "rows"), ("index.inv.json", "text")]
    clear_search_cache()
    with pytest.raises(FileNotFoundError):
        index_files.read_single(spark, str(tmp_path / "none.json"), reader)


def test_an_empty_index(spark, tmp_path):
    stored, postings = indexer.build_index(docs(spark, *LIBRARY).limit(0))
    for sharded in (True, False):
        index_files.write_json_index(stored, postings, str(tmp_path / str(sharded)), sharded=sharded)
        assert create_search(spark, str(tmp_path / str(sharded) / "index.meta.json")).query("tea").count() == 0
    clear_search_cache()


def test_bad_manifests(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        index_files.read_meta(spark, str(tmp_path / "none.json"))
    (tmp_path / "m.json").write_text('{"version": 3}')
    with pytest.raises(ValueError):
        index_files.read_meta(spark, str(tmp_path / "m.json"))


def test_parquet_index_reads_one_shard(spark, tmp_path):
    from bench import scanned

    index_files.write_parquet_index(*indexer.build_index(docs(spark, *LIBRARY)), str(tmp_path))
    e = Engine(*index_files.open_parquet_index(spark, str(tmp_path)))
    assert [r["url"] for r in e.query("mate").collect()] == ["/mate"]
    found = e._lookup(["mate"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert scanned(found) == {"partitions": 1, "files": 1}


def site(folder):
    body = " ".join(f"filler{i}" for i in range(20))
    for name, text in {"index.html": f"<title>Home</title><main><h1>Home</h1>{body}</main>", "guide/intro/index.html": f"<main><h1>Intro</h1><h2>Scoring</h2>tokens {body}</main>", "about.html": f"<title>About\n</title>\n<body>\n{body}", "404.html": "<h1>404</h1>", "search/old.html": "<h1>Old</h1>", "notes.txt": "x"}.items():
        f = folder / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)


@pytest.mark.parametrize("sharded", [True, False])
def test_build_command(spark, tmp_path, sharded):
    site(tmp_path / "in put")
    said = []
    args = ["build", "--input", str(tmp_path / "in put"), "--output", str(tmp_path / "out"), "--baseUrl", "https://x.example/docs", "--maxShardTerms", "3", "--verbose", "--shard" if sharded else "--no-shard"]
    meta = cli.run_build(spark, cli.parser().parse_args(args), said.append)
    assert meta["docCount"] == 3 and meta["baseUrl"] == "/docs/"
    assert said[0] == "- skipped 404.html" and "Indexed 3 documents" in said and any(s.startswith("Warning") for s in said)
    saved = json.loads((tmp_path / "out/docs.json").read_text())
    assert [(d["id"], d["url"]) for d in saved] == [(0, "/docs/about"), (1, "/docs/guide/intro/"), (2, "/docs/")]


def test_build_command_to_parquet(spark, tmp_path):
    site(tmp_path / "in")
    said = []
    meta = cli.run_build(spark, cli.parser().parse_args(["build", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--format", "parquet"]), said.append)
    assert meta["docCount"] == 3 and said[-1].endswith("/postings")
    assert [r["url"] for r in Engine(*index_files.open_parquet_index(spark, str(tmp_path / "out"))).query("scoring").collect()] == ["/guide/intro/"]


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/*.html", "a.html", True), ("**/*.html", "x/y/a.html", True), ("*.html", "x/a.html", False), ("**/search/**", "search/a.html", True), ("**/search/**", "x/search/y/a", True), ("**/search/**", "research/a", False), ("{a,b}/?.htm", "b/c.htm", True), ("[ab].html", "c.html", False)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(pages.glob_pattern(glob), path)) is hit


def test_streaming_append(spark, tmp_path):
    from quarrymill.streaming.ingest import append_index

    source = tmp_path / "docs"
    for batch in (LIBRARY[:2], LIBRARY[2:4]):
        docs(spark, *batch).write.mode("append").parquet(str(source))
        append_index(spark.readStream.schema(DOC).parquet(str(source)), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    e = Engine(*index_files.open_parquet_index(spark, str(tmp_path / "index")))
    assert [r["url"] for r in e.query("black").collect()] == ["/tea/black", "/oolong"]


def test_paths_of_every_build(spark):
    builds = spark.createDataFrame([(1, "a", 2, "_other"), (2, "b", 3, "rest"), (2, "b", 3, "rest"), (3, "c", 2, "_other")], "build_id bigint, site string, shard_prefix_len int, fallback_shard string")
    catalog = spark.createDataFrame([(1, "ab", "1/ab"), (2, "abc", "2/abc"), (2, "rest", "2/rest"), (2, None, "x")], "build_id bigint, shard string, path string")
    tokens = spark.createDataFrame([("a", "abc"), ("a", "abc"), ("a", "zz"), ("b", "ABCd"), ("b", "ab"), ("c", "abc"), ("d", "abc"), ("a", None)], "site string, token string")
    got = sorted(map(tuple, shards.resolve_build_paths(tokens, builds, catalog).collect()))
    assert got == [(1, "abc", "1/ab"), (1, "zz", None), (2, "ABCd", "2/abc"), (2, "ab", "2/rest"), (3, "abc", None)]
