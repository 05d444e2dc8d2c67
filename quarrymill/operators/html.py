"""Documents from HTML pages.

Only reading the markup needs Python (one Arrow pass over path and html); what
follows are Column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.constants import ASCII_BOUNDARY, MAX_HEADINGS, THIN_PAGE_CHARS
from quarrymill.functions.text import excerpt, normalize_ws
from quarrymill.functions.urls import file_url

# What is never part of the content, with all that is in it.
EXCLUDED = frozenset(("nav", "footer", "aside", "script", "style", "noscript", "svg"))
EXCLUDED_ATTRIBUTE, EXCLUDED_CLASS = "data-search-exclude", "no-search"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Elements whose text holds no markup: with entities, or as it stands.
_TEXT_ONLY, _RAW_TEXT = ("title", "textarea"), ("script", "style", "iframe", "xmp", "noembed", "noframes")
_SCOPES = frozenset("html body table td th ul ol dl select caption template svg button object".split())


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Tree(HTMLParser):
    CDATA_CONTENT_ELEMENTS = _TEXT_ONLY + _RAW_TEXT
    RCDATA_CONTENT_ELEMENTS = ()

    def set_cdata_mode(self, elem, **how):
        if elem in ("script", "style") or not any(n.tag in ("svg", "math") for n in self.open):  # foreign elements of these names hold markup
            super().set_cdata_mode(elem, **how)

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root, self.head, self.body = _Node("html", {}), _Node("head", {}), _Node("body", {})
        self.root.kids = [self.head, self.body]
        self.open = [self.head]
        self.in_body = False

    def _enter_body(self):
        if not self.in_body:
            self.in_body, self.open = True, [self.body]

    def _close(self, tags, stop):
        """End the innermost open element of ``tags``, unless one of ``stop`` lies between."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("html", "head"):
            return
        if tag == "body":
            self._enter_body()
            self.body.attrs.update(a)
            return
        if not self.in_body and tag not in _HEAD_ONLY and len(self.open) == 1:
            self._enter_body()
        if tag in _CLOSES_P:
            self._close({"p"}, _SCOPES)
        if tag in _SIBLINGS:
            for _ in range(3):
                self._close(_SIBLINGS[tag], _SCOPES - {"td", "th"} if tag in ("tr", "thead", "tbody", "tfoot", "td", "th") else _SCOPES)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and len(self.open) > 1 and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.pop()
        node = _Node(tag, a)
        self.open[-1].kids.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and len(self.open) > 1 and self.open[-1].tag == tag and any(n.tag == "svg" for n in self.open):
            self.open.pop()  # only foreign elements close themselves

    def handle_endtag(self, tag):
        if tag == "head":
            if not self.in_body:
                self.open = [self.head]
        elif tag not in ("html", "body"):
            self._close({tag}, {"td", "th", "table"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else set())

    def handle_data(self, data):
        if self.cdata_elem in _TEXT_ONLY:
            data = unescape(data)
        if not self.in_body and len(self.open) == 1:
            if not data.strip():
                return
            self._enter_body()
        self.open[-1].kids.append(data)


def _walk(node: _Node) -> Iterator[_Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [k for k in reversed(n.kids) if isinstance(k, _Node)]


def _text(node: _Node) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo += reversed(n.kids)
    return "".join(out)


def _excluded(n: _Node) -> bool:
    return n.tag in EXCLUDED or EXCLUDED_ATTRIBUTE in n.attrs or EXCLUDED_CLASS in (n.attrs.get("class") or "").split()


def parse(html: str | None) -> _Node:
    """The body of a page: nodes with ``tag``, ``attrs`` and ``kids``, which are nodes and texts."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.body


def read_markup(html: str | None) -> dict:
    """Raw texts of a page: first h1 and body of the content, all h2 and h3, the title."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = list(_walk(tree.root))
    root = next((n for t in ("main", "article") for n in nodes if n.tag == t), tree.body)
    for n in _walk(root):
        n.kids = [k for k in n.kids if isinstance(k, str) or not _excluded(k)]
    inside = list(_walk(root))[1:]
    return {
        "h1": next((_text(n) for n in inside if n.tag == "h1"), ""),
        "title": next((_text(n) for n in _walk(tree.root) if n.tag == "title"), ""),
        "heads": [_text(n) for n in inside if n.tag in ("h2", "h3")],
        "body": _text(root),
    }


_RAW = "path string, h1 string, title string, heads array<string>, body string"


def _parse(batches: Iterator) -> Iterator:
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("h1", pa.string()), ("title", pa.string()), ("heads", pa.list_(pa.string())), ("body", pa.string())])
    for b in batches:
        rows = [{"path": p} | read_markup(h) for p, h in zip(b["path"].to_pylist(), b["html"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def file_title(path: Column) -> Column:
    """A title from the file's name."""
    name = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "\\.html$", "")
    return F.coalesce(F.nullif(F.trim(F.translate(name, "-_", "  ")), F.lit("")), F.lit("Untitled"))


def is_missing_page(title: Column) -> Column:
    """Titles with 404 as a word."""
    return title.rlike(f"{ASCII_BOUNDARY}404{ASCII_BOUNDARY}")


def extract_all(pages: DataFrame, input_root: str = "", base_url: str = "/", url_mode: str = "pretty") -> DataFrame:
    """(path, url, title, headings, body_text, excerpt, title_source, skipped)
    of every page of ``pages`` (path, html).  ``skipped`` marks pages about
    missing pages and pages with next to nothing.

    Defined cases: a null html is an empty page; a null path has no url; rows
    repeat as in the input; further columns are ignored.
    """
    raw = pages.select(F.col("path").cast("string"), F.col("html").cast("string")).mapInArrow(_parse, _RAW)
    clean = raw.select("path", normalize_ws(F.col("h1")).alias("h1"), normalize_ws(F.col("title")).alias("tag"), F.transform("heads", normalize_ws).alias("heads"), normalize_ws(F.col("body")).alias("body_text"))
    root = input_root.rstrip("/") + "/" if input_root else ""
    relative = F.when(F.col("path").startswith(root), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.col("path")) if root else F.col("path")
    headings = F.slice(F.array_distinct(F.filter("heads", lambda h: h != "")), 1, MAX_HEADINGS)
    source = F.when(F.col("h1") != "", "h1").when(F.col("tag") != "", "title").otherwise("filename")
    title = F.when(F.col("h1") != "", F.col("h1")).when(F.col("tag") != "", F.col("tag")).otherwise(file_title(F.col("path")))
    docs = clean.select("path", file_url(relative, base_url, url_mode).alias("url"), title.alias("title"), headings.alias("headings"), "body_text", excerpt(F.col("body_text")).alias("excerpt"), source.alias("title_source"))
    thin = (F.length("body_text") < THIN_PAGE_CHARS) & (F.size("headings") == 0) & (F.col("title_source") == "filename")
    return docs.withColumn("skipped", is_missing_page(F.col("title")) | thin)


def extract_documents(pages: DataFrame, **options) -> DataFrame:
    """``extract_all`` without the skipped pages."""
    return extract_all(pages, **options).where(~F.col("skipped")).drop("skipped")
