"""The queries of the core: name -> callable(spark, sf_dir), and their SQL.

The corpus is the pages of indexable_documents, each counted once; HTML pages
are made from extracted_documents, whose titles come from an h1, a title
element or the file's name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.constants import FIELD_TOKEN_LIMITS, STOPWORDS
from quarrymill.functions import text as T
from quarrymill.functions import urls
from quarrymill.operators import balanced, html, indexer, shards
from quarrymill.operators.search import Engine, clear_search_cache, create_search
from quarrymill.session import is_stored, shared_path, table
from quarrymill.sources import index_files, pages


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return balanced.hot_shards(table(spark, d, "postings"))


def p6_shards(spark: SparkSession, d: str) -> DataFrame:
    return balanced.shard_report(table(spark, d, "postings")).select("shard", "terms", "postings", "pages")


_SHARDS = r"""WITH p AS (SELECT DISTINCT regexp_replace(lower(term), '[^a-z0-9]+', '', 'g') AS term, doc_id, field
    FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL),
    s AS (SELECT left(term, 2) AS shard, count(DISTINCT term) AS terms, count(*) AS postings, count(DISTINCT doc_id) AS pages FROM p GROUP BY 1)"""


ONE, MANY, MARKED = "gateway", "search settings of the slow cluster", "limits and files"


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexable_documents").select("id", "url", "title", "headings", "excerpt", "body_text").dropDuplicates(["id"])


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(extract_id, path, html) of every extraction, with the whole body of its
    page where it has one, in markup of four kinds."""
    e = table(spark, d, "extracted_documents").select("extract_id", "doc_id", "file_path", "title", "title_source", "headings", "excerpt").dropDuplicates(["extract_id"])
    e = e.join(table(spark, d, "indexable_documents").select(F.col("id").alias("doc_id"), "body_text").dropDuplicates(["doc_id"]), "doc_id", "left")
    title, body = T.escape_html(F.coalesce("title", F.lit(""))), T.escape_html(F.coalesce("body_text", "excerpt", F.lit("")))
    kind = F.pmod("extract_id", F.lit(4))
    by_kind = lambda *parts: F.element_at(F.array(*map(F.lit, parts)), (kind + 1).cast("int"))
    named = F.coalesce(F.col("title_source"), F.lit("")) != "filename"
    heads = F.transform(F.coalesce("headings", F.array().cast("array<string>")), lambda h: F.concat(by_kind("<h2>", "<h3 class=a>", "<H2>", "<h3>"), T.escape_html(h), by_kind("</h2>", "</h3>", "</H2>", "</h3>")))
    parts = [
        "<!doctype html><html><head>", F.when(named, F.concat(F.lit("<title>"), title, by_kind("", " <b>x</b>", "", ""), F.lit("</title>"))).otherwise(""), "<style>p{}</style></head><body><nav>menu</nav>",
        by_kind("<main class=page><aside>side</aside>", "<iframe><h1>frame</h1></iframe><textarea><main></textarea><article>", "<aside><h1>side</h1></aside>", "<article>teaser<h1>teaser</h1></article><main><svg><title>drawing</title></svg>"),
        F.when(F.col("title_source") == "h1", F.concat(F.lit("<h1>"), title, F.lit("</h1>"))).otherwise(""), F.array_join(heads, ""), "<p>", body, "<p class='note no-search'>not this<p data-search-exclude>nor this</p>",
        by_kind("</main>", "</article>", "<script>if (a < b) {}</script>", "</main><main>second</main>"), "<footer>foot</footer></body></html>",
    ]
    page = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return e.select("extract_id", F.coalesce("file_path", F.lit("/build/none.html")).alias("path"), page.alias("html"))


def tokenize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


def tokenize_dedupe_limit(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokenize_field(F.col("text"), 20), " ").alias("tokens"))


def stopword_anti_join(spark, d):
    runs = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("term"))
    stop = spark.createDataFrame([(w,) for w in STOPWORDS], "term string")
    return runs.join(F.broadcast(stop), "term", "left_anti").groupBy("term").agg(F.count("*").alias("n"))


def normalize_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_ws(F.col("text")).alias("text"))


def excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt(T.normalize_ws(F.col("text"))).alias("excerpt"))


def escape_html(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape_html(F.col("text")).alias("text"))


def highlight_excerpt(spark, d):
    short = T.excerpt(T.normalize_ws(F.col("text")))
    return table(spark, d, "documents").select("doc_id", T.highlight(short, T.tokenize_query(F.lit(MARKED))).alias("excerpt"))


def extract_pages(spark, d):
    pages = _pages(spark, d)
    docs = html.extract_all(pages.select("path", "html"), input_root="/build")
    return docs.select("path", "url", "title", F.array_join("headings", "|").alias("headings"), F.length("body_text").cast("bigint").alias("body_chars"), "excerpt", "title_source", "skipped").distinct()


def page_title_sources(spark, d):
    docs = html.extract_documents(_pages(spark, d), input_root="/build")
    return docs.groupBy("title_source").agg(F.count("*").alias("pages"))


def skipped_pages(spark, d):
    return html.extract_all(_pages(spark, d), input_root="/build").where("skipped").groupBy("title").agg(F.count("*").alias("pages"))


def base_urls(spark, d):
    b = table(spark, d, "shard_builds").select("base_url").distinct()
    return b.select("base_url", urls.normalize_base_url_col(F.col("base_url")).alias("path"))


def _mapped(spark, d, mode):
    files = table(spark, d, "extracted_documents").where("file_path is not null").select("file_path").distinct()
    return files.select("file_path", urls.file_url(F.regexp_replace("file_path", "^/build/[^/]*/", ""), "https://x.example/docs", mode).alias("url"))


def map_urls_pretty(spark, d):
    return _mapped(spark, d, "pretty")


def map_urls_html(spark, d):
    return _mapped(spark, d, "html")


def doc_ids(spark, d):
    paths = table(spark, d, "extracted_documents").where("file_path is not null").select(F.col("file_path").alias("path")).distinct()
    return indexer.assign_ids(paths).select("id", "path")


def field_weights(spark, d):
    return indexer.document_terms(_corpus(spark, d)).groupBy("field", "weight").agg(F.count("*").alias("tokens"), F.countDistinct("term").alias("terms"))


def postings(spark, d):
    return indexer.build_postings(_corpus(spark, d)).select("term", "doc_id", "weight")


def postings_nested(spark, d):
    nested = indexer.nest_postings(indexer.build_postings(_corpus(spark, d)))
    return nested.select("term", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p[0].cast("string"), p[1].cast("string"))), " ").alias("postings"))


def stored_docs(spark, d):
    return indexer.stored_docs(_corpus(spark, d)).select("id", "url", "title", F.array_join("headings", "|").alias("headings"), "excerpt")


def shard_keys(spark, d):
    terms = table(spark, d, "postings").where("term is not null").select("term").distinct()
    return terms.select("term", shards.shard_key(F.col("term")).alias("shard"))


def shard_term_counts(spark, d):
    return shards.shard_terms(shards.build_shards(indexer.build_postings(_corpus(spark, d))))


def index_stats(spark, d):
    return shards.shard_stats(shards.build_shards(indexer.build_postings(_corpus(spark, d))))


def oversize_shards(spark, d):
    return shards.oversize_shards(shards.build_shards(indexer.build_postings(_corpus(spark, d))), 100)


def shard_map(spark, d):
    keys = shards.build_shards(indexer.build_postings(_corpus(spark, d))).select("shard").distinct()
    return keys.select("shard", shards.shard_path(F.col("shard")).alias("path"))


def resolve_shard_paths(spark, d):
    terms = table(spark, d, "postings").where("term is not null").select(F.col("term").alias("token")).distinct()
    catalog = table(spark, d, "shard_map").where("shard is not null").select("shard").distinct().withColumn("path", shards.shard_path(F.col("shard")))
    return shards.resolve_shard_paths(terms, catalog).select("token", "path")


def resolve_build_paths(spark, d):
    terms = table(spark, d, "postings").select("site", F.col("term").alias("token"))
    catalog = table(spark, d, "shard_map").withColumn("path", shards.shard_path(F.col("shard")))
    return shards.resolve_build_paths(terms, table(spark, d, "shard_builds"), catalog)


_BUILT: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, d: str) -> str:
    """The Parquet index of the corpus, built once per session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if not is_stored(spark, _BUILT.get(key)):
        docs, found = indexer.build_index(_corpus(spark, d))
        path = shared_path(spark, "index")
        index_files.write_parquet_index(docs, found, path)
        _BUILT[key] = path
    return _BUILT[key]


def _engine(spark, d, docs: DataFrame | None = None) -> Engine:
    stored, found, sharding = index_files.open_parquet_index(spark, _index(spark, d))
    return Engine(stored if docs is None else docs, found, sharding)


def search_single(spark, d):
    return _engine(spark, d).query(ONE)


def search_multi_bonus(spark, d):
    return _engine(spark, d).query(MANY, limit=25)


def search_highlight(spark, d):
    return _engine(spark, d).query(MARKED, highlight_matches=True)


def search_limit(spark, d):
    return _engine(spark, d).query(MANY, limit=3, max_tokens=2)


def search_stopwords_only(spark, d):
    return _engine(spark, d).query("the and of")


def search_unknown_term(spark, d):
    return _engine(spark, d).query(f"constructor qqzzxx {ONE}")


def search_orphan_postings(spark, d):
    docs = indexer.stored_docs(_corpus(spark, d)).where("title is not null and title < 'N'")
    return _engine(spark, d, docs).query(MANY, limit=50)


def batch_search(spark, d):
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    return _engine(spark, d).batch_query(items)


def _json_index(spark, d, sharded: bool) -> str:
    docs, found = indexer.build_index(_corpus(spark, d))
    folder = shared_path(spark, "json-index")
    index_files.write_json_index(docs, found, folder, sharded=sharded, generated_at="2024-01-01T00:00:00.000Z")
    return folder


def v1_roundtrip(spark, d):
    return Engine(*index_files.open_index(spark, f"{_json_index(spark, d, False)}/index.meta.json")).query(MANY, limit=25)


def v2_roundtrip(spark, d):
    return Engine(*index_files.open_index(spark, f"{_json_index(spark, d, True)}/index.meta.json")).query(MANY, limit=25)


def parquet_index_search(spark, d):
    docs, found = indexer.build_index(_corpus(spark, d))
    folder = shared_path(spark, "index")
    index_files.write_parquet_index(docs, found, folder)
    return Engine(*index_files.open_parquet_index(spark, folder)).query(MANY, limit=25)


def search_prewarmed(spark, d):
    """Opened once, prewarmed, with room for one shard at a time, then forgotten."""
    meta = f"{_json_index(spark, d, True)}/index.meta.json"
    engine = create_search(spark, meta, max_shard_cache=1)
    engine.prewarm(ONE)
    found = create_search(spark, meta, max_shard_cache=1).query(ONE)
    clear_search_cache()
    return found


def search_with_reader(spark, d):
    """The index read by a reader of one's own."""
    class Reader:
        def __call__(self, paths: list[str], schema: str) -> DataFrame:
            return spark.read.schema(schema).option("multiLine", True).json(paths)

        def text(self, paths: list[str], separator: str) -> DataFrame:
            return spark.read.option("lineSep", separator).text(paths)

    return create_search(spark, f"{_json_index(spark, d, False)}/index.meta.json", Reader()).query(MANY, limit=25)


def index_term_order(spark, d):
    """(shard, place, term): the order of the terms in the files of an index."""
    files = spark.read.text(f"{_json_index(spark, d, True)}/inv", wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("shard"), F.get_json_object("value", "$.terms").alias("terms"))
    return files.select("shard", F.posexplode(F.json_object_keys("terms")).alias("place", "term"))


def build_report(spark, d):
    docs, found = indexer.build_index(_corpus(spark, d))
    return spark.createDataFrame([(line,) for line in index_files.build_report(docs, found, 100)], "line string")


def escape_regex(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape_regex(F.col("text")).alias("text"))


def html_dir_pages(spark, d):
    """A folder with a file per build of a site, read back by the globs of a build."""
    folder = shared_path(spark, "site")
    files = index_files._Files(spark, folder)
    for r in table(spark, d, "shard_builds").select("build_id", "site", "total_terms").distinct().toLocalIterator():
        part = "search/" if r["build_id"] % 5 == 0 else ""
        files.write(f"{r['site']}/{part}{r['build_id']}.{'htm' if r['build_id'] % 7 == 0 else 'html'}", [f"<h1>{r['site']}</h1>\n<p>{r['total_terms']} terms"])
    return pages.read_html_dir(spark, folder).select("path", "html")


def html_table_pages(spark, d):
    folder = shared_path(spark, "pages")
    _pages(spark, d).select(F.col("path").alias("file"), F.col("html").alias("markup"), "extract_id").write.parquet(folder)
    docs = html.extract_all(pages.read_html_table(spark, folder, "file", "markup"), input_root="/build")
    return docs.groupBy("title_source", "skipped").agg(F.count("*").alias("pages"), F.sum(F.length("body_text")).alias("chars"))


_QUERIES = (
    p6_found, p6_shards, tokenize_documents, tokenize_dedupe_limit, stopword_anti_join, normalize_whitespace, excerpt, escape_html, highlight_excerpt, extract_pages, page_title_sources, skipped_pages, base_urls, map_urls_pretty, map_urls_html, doc_ids,
    field_weights, postings, postings_nested, stored_docs, shard_keys, shard_term_counts, index_stats, oversize_shards, shard_map, resolve_shard_paths, resolve_build_paths, search_single, search_multi_bonus, search_highlight, search_limit, search_stopwords_only, search_unknown_term,
    search_orphan_postings, batch_search, v1_roundtrip, v2_roundtrip, parquet_index_search, search_prewarmed, search_with_reader, index_term_order, build_report, escape_regex, html_dir_pages, html_table_pages,
)


# ---- SQL

_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_WS_SQL = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def _tokens(text: str, limit: int | None = None, dedupe: bool = True) -> str:
    kept = f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({_STOP_SQL}, x))"
    if dedupe:
        kept = f"list_transform(list_filter(list_transform({kept}, lambda x, i: {{'x': x, 'i': i}}), lambda e: list_position({kept}, e.x) = e.i), lambda e: e.x)"
    return f"({kept})[1:{limit}]" if limit else kept


def _norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS_SQL}', ' ', 'g'))"


def _excerpt(x: str) -> str:
    head, last = f"substr({x}, 1, 200)", f"(201 - strpos(reverse(substr({x}, 1, 200)), ' '))"
    return f"CASE WHEN length({x}) <= 200 THEN {x} WHEN strpos({head}, ' ') > 0 AND {last} > 101 THEN substr({head}, 1, {last} - 1) || '…' ELSE {head} || '…' END"


def _escape(x: str) -> str:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{sign}', '{entity}')"
    return x


def _marked(x: str, words: list[str]) -> str:
    alternatives = "|".join(sorted(words, key=len, reverse=True))
    return rf"regexp_replace({_escape(x)}, '\b({alternatives})\b', '<mark>\1</mark>', 'gi')"


_C = "c AS (SELECT id, any_value(url) AS url, any_value(title) AS title, any_value(headings) AS headings, any_value(excerpt) AS excerpt, any_value(body_text) AS body_text FROM indexable_documents GROUP BY id)"
_F = rf"""{_C},
    run AS (SELECT id AS doc_id, field, weight, most, i, term FROM (SELECT id, field, weight, most, generate_subscripts(runs, 1) AS i, unnest(runs) AS term FROM (
        SELECT id, 'title' AS field, 5 AS weight, {FIELD_TOKEN_LIMITS["title"]} AS most, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+') AS runs FROM c UNION ALL
        SELECT id, 'headings', 3, {FIELD_TOKEN_LIMITS["headings"]}, regexp_extract_all(lower(coalesce(array_to_string(headings, ' '), '')), '[a-z0-9]+') FROM c UNION ALL
        SELECT id, 'body', 1, {FIELD_TOKEN_LIMITS["body"]}, regexp_extract_all(lower(coalesce(body_text, '')), '[a-z0-9]+') FROM c)) WHERE length(term) > 1 AND NOT list_contains({_STOP_SQL}, term)),
    f AS (SELECT doc_id, field, weight::BIGINT AS weight, term FROM (SELECT doc_id, field, weight, most, term, min(i) AS i FROM run GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY i) <= most)"""
_P = f"{_F}, p AS (SELECT term, doc_id, sum(weight)::BIGINT AS weight FROM f GROUP BY term, doc_id)"
_S = f"{_P}, s AS (SELECT left(term, 2) AS shard, count(DISTINCT term) AS terms FROM p GROUP BY 1)"


def _search(words: list[str], limit: int, docs: str = "c", shown: str = "excerpt") -> str:
    tokens = ", ".join(f"('{w}', {i})" for i, w in enumerate(words))
    return f"""WITH {_P}, q(term, pos) AS (VALUES {tokens}),
    m AS (SELECT doc_id, sum(weight) + (count(*) - 1) * 2 AS score, min(pos) AS pos FROM p JOIN q USING (term) GROUP BY doc_id),
    r AS (SELECT row_number() OVER (ORDER BY score DESC, coalesce(title, '') COLLATE en, pos, doc_id) AS rank, d.id, url, title, excerpt, score FROM m LEFT JOIN {docs} d ON d.id = m.doc_id)
    SELECT rank::INT AS rank, url, title, {shown} AS excerpt, score::BIGINT AS score FROM r WHERE rank <= {limit} AND id IS NOT NULL"""


_PAGE = f"""b AS (SELECT id, any_value(body_text) AS body_text FROM indexable_documents GROUP BY id),
    e AS (SELECT path, title, source, headings, kind, coalesce(body_text, excerpt, '') AS body FROM (SELECT extract_id % 4 AS kind, any_value(doc_id) AS doc_id, any_value(coalesce(file_path, '/build/none.html')) AS path, any_value(title) AS title, any_value(title_source) AS source,
        any_value(headings) AS headings, any_value(excerpt) AS excerpt FROM extracted_documents GROUP BY extract_id) LEFT JOIN b ON b.id = doc_id),
    n AS (SELECT path, CASE WHEN source = 'h1' THEN {_norm("coalesce(title, '')")} ELSE '' END AS h1, CASE WHEN coalesce(source, '') <> 'filename' THEN {_norm("(coalesce(title, '') || CASE WHEN kind = 1 THEN ' <b>x</b>' ELSE '' END)")} ELSE '' END AS tag,
        list_filter(list_transform(coalesce(headings, []), lambda h: {_norm("h")}), lambda h: h <> '') AS heads,
        {_norm("(CASE WHEN source = 'h1' THEN coalesce(title, '') ELSE '' END) || array_to_string(coalesce(headings, []), '') || body")} AS body FROM e),
    x AS (SELECT path, CASE WHEN h1 <> '' THEN h1 WHEN tag <> '' THEN tag ELSE coalesce(nullif(trim(translate(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.html$', ''), '-_', '  ')), ''), 'Untitled') END AS title,
        CASE WHEN h1 <> '' THEN 'h1' WHEN tag <> '' THEN 'title' ELSE 'filename' END AS title_source, (list_filter(heads, lambda h, i: list_position(heads, h) = i))[1:20] AS headings, body FROM n),
    y AS (SELECT path, title, title_source, headings, body, regexp_matches(title, '\\b404\\b') OR (length(body) < 50 AND len(headings) = 0 AND title_source = 'filename') AS skipped FROM x)"""


def _url(rel: str, base: str, pretty: bool = True) -> str:
    if not pretty:
        return f"'{base}' || CASE WHEN {rel} LIKE '%.html' THEN {rel} ELSE '' END"
    return f"'{base}' || CASE WHEN {rel} = 'index.html' THEN '' WHEN {rel} LIKE '%/index.html' THEN {rel}[:-11] WHEN {rel} LIKE '%.html' THEN {rel}[:-6] ELSE '' END"


_MANY = T.query_tokens(MANY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    body = _norm("text")
    file = "regexp_replace(file_path, '^/build/[^/]*/', '')"
    files = "FROM (SELECT DISTINCT file_path FROM extracted_documents WHERE file_path IS NOT NULL)"
    many = _search(_MANY, 25)
    return {
        "p6_found": f"{_SHARDS} SELECT shard FROM s WHERE postings >= 0.03 * (SELECT sum(postings) FROM s)",
        "p6_shards": f"{_SHARDS} SELECT shard, terms, postings, pages FROM s",
        "tokenize_documents": f"SELECT doc_id, array_to_string({_tokens('text', dedupe=False)}, ' ') AS tokens FROM documents",
        "tokenize_dedupe_limit": f"SELECT doc_id, array_to_string({_tokens('text', 20)}, ' ') AS tokens FROM documents",
        "stopword_anti_join": f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) WHERE length(term) > 1 AND NOT list_contains({_STOP_SQL}, term) GROUP BY term",
        "normalize_whitespace": f"SELECT doc_id, {body} AS text FROM documents",
        "excerpt": f"SELECT doc_id, {_excerpt('t')} AS excerpt FROM (SELECT doc_id, {body} AS t FROM documents)",
        "escape_html": f"SELECT doc_id, {_escape('text')} AS text FROM documents",
        "highlight_excerpt": f"SELECT doc_id, {_marked('x', T.query_tokens(MARKED))} AS excerpt FROM (SELECT doc_id, {_excerpt('t')} AS x FROM (SELECT doc_id, {body} AS t FROM documents))",
        "extract_pages": f"WITH {_PAGE} SELECT DISTINCT path, {_url('path[8:]', '/')} AS url, title, array_to_string(headings, '|') AS headings, length(body) AS body_chars, {_excerpt('body')} AS excerpt, title_source, skipped FROM y",
        "page_title_sources": f"WITH {_PAGE} SELECT title_source, count(*) AS pages FROM y WHERE NOT skipped GROUP BY title_source",
        "skipped_pages": f"WITH {_PAGE} SELECT title, count(*) AS pages FROM y WHERE skipped GROUP BY title",
        "base_urls": r"""SELECT base_url, CASE WHEN p IN ('', '/') THEN '/' ELSE (CASE WHEN p LIKE '/%' THEN '' ELSE '/' END) || p || (CASE WHEN p LIKE '%/' THEN '' ELSE '/' END) END AS path
            FROM (SELECT DISTINCT base_url, CASE WHEN regexp_matches(trim(base_url), '^(https?:)?//') THEN coalesce(nullif(regexp_extract(trim(base_url), '^(?:https?:)?//[^/?#]*([^?#]*)', 1), ''), '/') ELSE trim(base_url) END AS p FROM shard_builds)""",
        "map_urls_pretty": f"SELECT file_path, {_url(file, '/docs/')} AS url {files}",
        "map_urls_html": f"SELECT file_path, {_url(file, '/docs/', False)} AS url {files}",
        "doc_ids": f"SELECT row_number() OVER (ORDER BY file_path) - 1 AS id, file_path AS path {files}",
        "field_weights": f"WITH {_F} SELECT field, weight, count(*) AS tokens, count(DISTINCT term) AS terms FROM f GROUP BY field, weight",
        "postings": f"WITH {_P} SELECT term, doc_id, weight FROM p",
        "postings_nested": f"WITH {_P} SELECT term, string_agg(doc_id || ':' || weight, ' ' ORDER BY doc_id) AS postings FROM p GROUP BY term",
        "stored_docs": f"WITH {_C} SELECT id, url, title, array_to_string(headings, '|') AS headings, excerpt FROM c",
        "shard_keys": "SELECT DISTINCT term, CASE WHEN regexp_matches(substr(lower(term), 1, 2), '^[a-z0-9]{2}$') THEN substr(lower(term), 1, 2) ELSE '_other' END AS shard FROM postings WHERE term IS NOT NULL",
        "shard_term_counts": f"WITH {_S} SELECT shard, terms FROM s",
        "index_stats": f"WITH {_S} SELECT sum(terms)::BIGINT AS total_terms, count(*) AS shard_count, max(terms) AS largest_shard_terms FROM s",
        "oversize_shards": f"WITH {_S} SELECT shard, terms FROM s WHERE terms > 100",
        "shard_map": f"WITH {_S} SELECT shard, 'inv/' || shard || '.json' AS path FROM s",
        "resolve_shard_paths": """WITH k AS (SELECT DISTINCT term AS token, CASE WHEN regexp_matches(substr(lower(term), 1, 2), '^[a-z0-9]{2}$') THEN substr(lower(term), 1, 2) ELSE '_other' END AS shard FROM postings WHERE term IS NOT NULL),
            m AS (SELECT DISTINCT shard FROM shard_map WHERE shard IS NOT NULL)
            SELECT token, CASE WHEN m.shard IS NOT NULL THEN 'inv/' || m.shard || '.json' WHEN EXISTS (SELECT 1 FROM m WHERE shard = '_other') THEN 'inv/_other.json' END AS path FROM k LEFT JOIN m USING (shard)""",
        "resolve_build_paths": """WITH b AS (SELECT DISTINCT build_id, site, shard_prefix_len AS n, fallback_shard AS other FROM shard_builds),
            k AS (SELECT DISTINCT build_id, other, term AS token, CASE WHEN length(substr(lower(term), 1, n)) = n AND regexp_full_match(substr(lower(term), 1, n), '[a-z0-9]+') THEN substr(lower(term), 1, n) ELSE other END AS shard
                FROM postings JOIN b USING (site) WHERE term IS NOT NULL),
            m AS (SELECT DISTINCT build_id, shard FROM shard_map WHERE shard IS NOT NULL)
            SELECT DISTINCT k.build_id, token, 'inv/' || coalesce(m.shard, o.shard) || '.json' AS path FROM k LEFT JOIN m ON m.build_id = k.build_id AND m.shard = k.shard LEFT JOIN m o ON o.build_id = k.build_id AND o.shard = k.other""",
        "search_single": _search(T.query_tokens(ONE), 10),
        "search_multi_bonus": many,
        "search_highlight": _search(T.query_tokens(MARKED), 10, shown=_marked("excerpt", T.query_tokens(MARKED))),
        "search_limit": _search(_MANY[:2], 3),
        "search_stopwords_only": _search(["the"], 0),
        "search_unknown_term": _search(["constructor", "qqzzxx", *T.query_tokens(ONE)], 10),
        "search_orphan_postings": _search(_MANY, 50, "(SELECT * FROM c WHERE title < 'N')"),
        "batch_search": f"""WITH {_P}, qr AS (SELECT item_id AS query_id, generate_subscripts(r, 1) AS i, unnest(r) AS term FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS r FROM eval_items)),
            qd AS (SELECT query_id, term, min(i) AS i FROM qr WHERE length(term) > 1 AND NOT list_contains({_STOP_SQL}, term) GROUP BY ALL),
            q AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY i) AS pos FROM qd QUALIFY pos <= 10),
            m AS (SELECT query_id, doc_id, sum(weight) + (count(*) - 1) * 2 AS score, min(pos) AS pos FROM p JOIN q USING (term) GROUP BY ALL),
            r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(title, '') COLLATE en, pos, doc_id) AS rank, c.id, url, title, excerpt, score FROM m LEFT JOIN c ON c.id = m.doc_id)
            SELECT query_id, rank::INT AS rank, url, title, excerpt, score::BIGINT AS score FROM r WHERE rank <= 10 AND id IS NOT NULL""",
        "v1_roundtrip": many,
        "v2_roundtrip": many,
        "parquet_index_search": many,
        "search_prewarmed": _search(T.query_tokens(ONE), 10),
        "search_with_reader": many,
        "index_term_order": f"WITH {_P}, t AS (SELECT DISTINCT term FROM p) SELECT left(term, 2) AS shard, (row_number() OVER (PARTITION BY left(term, 2) ORDER BY term) - 1)::INT AS place, term FROM t",
        "build_report": f"""WITH {_S} SELECT 'Indexed ' || (SELECT count(*) FROM c) || ' documents' AS line UNION ALL SELECT 'Indexed ' || sum(terms) || ' terms' FROM s UNION ALL SELECT 'Shards ' || count(*) || ' (largest ' || max(terms) || ' terms)' FROM s
            UNION ALL SELECT 'Warning: the largest shard has more than 100 terms (--maxShardTerms)' FROM s HAVING max(terms) > 100""",
        "escape_regex": r"SELECT doc_id, regexp_replace(text, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS text FROM documents",
        "html_dir_pages": """SELECT DISTINCT site || '/' || build_id || '.html' AS path, '<h1>' || site || '</h1>' || chr(10) || '<p>' || total_terms || ' terms' AS html FROM shard_builds WHERE build_id % 5 <> 0 AND build_id % 7 <> 0""",
        "html_table_pages": f"WITH {_PAGE} SELECT title_source, skipped, count(*) AS pages, sum(length(body))::BIGINT AS chars FROM y GROUP BY ALL",
    }
