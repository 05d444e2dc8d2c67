"""SQL for the queries that DuckDB can compute on whole tables."""

from __future__ import annotations

#: White space.
_WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"

_COUNTED = r"""p AS (SELECT DISTINCT regexp_replace(lower(term), '[^a-z0-9]+', '', 'g') AS term, doc_id, field
    FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL)"""

_TERMS = f"""WITH {_COUNTED},
    t AS (SELECT term, count(*) AS postings, count(DISTINCT doc_id) AS pages FROM p GROUP BY term),
    a AS (SELECT count(DISTINCT doc_id) AS n FROM p),
    m AS (SELECT term, postings, pages, CASE WHEN pages < 3 THEN 'rare' WHEN pages > 0.25 * n THEN 'common' END AS mark FROM t, a)"""


def _repeated(table: str, col: str, name: str) -> str:
    return rf"""{name}l AS (SELECT DISTINCT id, site, generate_subscripts(parts, 1) AS line_no, regexp_replace(lower(unnest(parts)), '\P{{L}}+', '', 'g') AS key
        FROM (SELECT id, site, string_split({col}, chr(10)) AS parts FROM {table} WHERE id IS NOT NULL AND site IS NOT NULL AND {col} IS NOT NULL)),
    {name}k AS (SELECT site, key FROM {name}l WHERE key <> '' GROUP BY site, key HAVING count(DISTINCT id) >= 6),
    {name} AS (SELECT '{table}' AS record_table, id AS record_id, line_no::INT AS line_no FROM {name}l SEMI JOIN {name}k USING (site, key))"""


def _cleaned(table: str, col: str) -> str:
    return rf"""WITH {_repeated(table, col, "r")}, d AS (SELECT DISTINCT id, {col} AS text FROM {table}),
    g AS (SELECT record_id AS id, list(DISTINCT line_no) AS gone FROM r GROUP BY record_id)
    SELECT d.id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS clean_text
    FROM d LEFT JOIN g USING (id)"""


#: Words: longest runs of letters and digits.
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

_NEAR = rf"""w AS (SELECT DISTINCT id, {_WORDS.format("body_text")} AS w FROM indexable_documents WHERE body_text IS NOT NULL AND id IS NOT NULL),
    s AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    c AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
    near AS (SELECT a, b FROM c JOIN n u ON u.id = a JOIN n v ON v.id = b WHERE k / (u.n + v.n - k) >= 0.6)"""

_URLS = r"""u AS (SELECT DISTINCT id, site, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*', ''), '(?s)[?#].*$', '')), '(index\.html|\.html)$', ''), '/+$', '') AS k
        FROM search_documents WHERE url IS NOT NULL AND site IS NOT NULL AND id IS NOT NULL),
    same AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.site = y.site AND x.k = y.k AND x.id < y.id)"""

_GROUPS = rf"""{_NEAR}, {_URLS},
    i AS (SELECT DISTINCT id FROM indexable_documents WHERE id IS NOT NULL),
    g AS (SELECT id, list_sort(list(s)) AS k FROM s GROUP BY id),
    h AS (SELECT id, array_to_string(w, ' ') AS k FROM w WHERE len(w) BETWEEN 1 AND 2),
    k AS (SELECT id, min(id) OVER (PARTITION BY k) AS class_id FROM g UNION ALL SELECT id, min(id) OVER (PARTITION BY k) FROM h),
    e AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    l AS (SELECT e.a AS id, count(DISTINCT y.class_id) AS links FROM e JOIN k x ON x.id = e.a JOIN k y ON y.id = e.b WHERE x.class_id <> y.class_id GROUP BY e.a),
    p AS (SELECT id, min(least) AS url_id FROM (SELECT id, min(id) OVER (PARTITION BY site, k) AS least FROM u) GROUP BY id)"""

_GRAMS = rf"""d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
    e AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE text IS NOT NULL),
    dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
    eg AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
    hits AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_markup": rf"SELECT DISTINCT id, trim(regexp_replace(coalesce(title, '') || ' ' || body_text, '{_WS}', ' ', 'g')) AS article FROM indexable_documents WHERE body_text IS NOT NULL AND site IS NOT NULL",
        "p2_found": f"{_TERMS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p2_terms": f"{_TERMS} SELECT term, postings, pages, mark FROM m",
        "p3_found": f"WITH {_repeated('indexable_documents', 'body_text', 'a')}, {_repeated('search_documents', 'excerpt', 'b')} SELECT * FROM a UNION ALL SELECT * FROM b",
        "p3_clean_bodies": _cleaned("indexable_documents", "body_text"),
        "p3_clean_excerpts": _cleaned("search_documents", "excerpt"),
        "p5_found": f"WITH {_NEAR}, {_URLS} SELECT a AS id_a, b AS id_b FROM near UNION SELECT a AS id_a, b AS id_b FROM same",
        "p5_groups": f"WITH {_GROUPS} SELECT i.id, coalesce(class_id, i.id) AS class_id, coalesce(links, 0) AS links, coalesce(url_id, i.id) AS url_id FROM i LEFT JOIN k USING (id) LEFT JOIN l USING (id) LEFT JOIN p USING (id)",
        "p8_found": f"WITH {_GRAMS} SELECT doc_id, item_id FROM hits",
        "p8_items": f"WITH {_GRAMS} SELECT item_id, count(*) AS documents FROM hits GROUP BY item_id",
    }
