"""Main content of HTML pages, by consensus of tag-class paths per host.

Where pages come as markup, their containers are elements.  Each has a
generalised path, the tags and classes from the body down with figures masked.
The pages of a host vote on every path: how much of its text stands in links,
how much of it is running text, and in how many different texts it comes.  A
path whose text is mostly links, or comes in few texts on many pages, wins as
furniture.  Pages are then extracted again without the containers on winning
paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.boilerplate import SENT_PATHS, path_hash
from quarrymill.operators.html import parse
from quarrymill.session import stored

#: Elements that hold parts of a page, those that are never content, and those whose text stands in lines of its own.
CONTAINERS = frozenset("div section article main aside nav header footer ul ol dl table form details fieldset".split())
NEVER = frozenset("script style noscript svg template iframe textarea select button".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote tr td th figure figcaption hr br address summary body".split())
#: Pages of a host from which a path can win; part of its text in links, or of different texts among its pages, by which it does.
HOST_PAGES, LINK_PART, TEXT_PART = 3, 0.5, 0.34
_FIGURES = re.compile(r"\d+")


def step(node) -> str:
    """A container's tag and classes, figures masked."""
    classes = sorted({_FIGURES.sub("0", c) for c in (node.attrs.get("class") or "").split()})
    return ".".join([node.tag, *classes])


class Container:
    """A container of a page: its path, its own and inner texts, characters and those in links."""

    __slots__ = ("path", "texts", "chars", "links")

    def __init__(self, path: str):
        self.path, self.texts, self.chars, self.links = path, [], 0, 0


def containers(body) -> list[Container]:
    """Every container of a page with text, the body first."""
    out, todo = [], [(body, (), False, "body")]
    while todo:
        node, inside, in_link, path = todo.pop()
        if isinstance(node, str):
            if text := " ".join(node.split()):
                for c in inside:
                    c.texts.append(text)
                    c.chars += len(text)
                    c.links += len(text) * in_link
            continue
        if node.tag in NEVER:
            continue
        if node is body or node.tag in CONTAINERS:
            path = path if node is body else f"{path}>{step(node)}"
            out.append(c := Container(path))
            inside = (*inside, c)
        todo += [(k, inside, in_link or node.tag == "a", path) for k in reversed(node.kids)]
    return [c for c in out if c.texts]


def article(body, is_furniture) -> str:
    """The text of a page without the containers on whose paths
    ``is_furniture`` is true, a line for each block."""
    out, todo = [""], [(body, "body")]
    while todo:
        node, path = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        if node.tag in NEVER:
            continue
        if node.tag in CONTAINERS:
            path = f"{path}>{step(node)}"
            if is_furniture(path):
                continue
        if node.tag in BLOCKS:
            out.append("\0")
            todo.append(("\0", path))
        todo += [(k, path) for k in reversed(node.kids)]
    lines = (" ".join(x.split()) for x in "".join(out).split("\0"))
    return "\n".join(x for x in lines if x)


def _votes(batches: Iterator) -> Iterator:
    """(site, path, text, pages, chars, links) of a batch's containers; ``text`` is a hash."""
    import pyarrow as pa
    import xxhash

    for b in batches:
        votes: dict = {}
        for site, html in zip(b["site"].to_pylist(), b["html"].to_pylist(), strict=True):
            for c in containers(parse(html))[1:]:
                key = (site, c.path, xxhash.xxh3_64_intdigest("\0".join(c.texts)) - (1 << 63))
                v = votes.setdefault(key, [0, 0, 0])
                v[0] += 1
                v[1] += c.chars
                v[2] += c.links
        cols = list(zip(*((*k, *v) for k, v in votes.items()), strict=True)) or [()] * 6
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["site", "path", "text", "pages", "chars", "links"])


def furniture_paths(pages: DataFrame) -> DataFrame:
    """(site, path) of the winning furniture paths of each host."""
    votes = pages.mapInArrow(_votes, "site string, path string, text bigint, pages bigint, chars bigint, links bigint")
    texts = votes.groupBy("site", "path", "text").agg(*(F.sum(c).alias(c) for c in ("pages", "chars", "links")))
    paths = texts.groupBy("site", "path").agg(F.count("*").alias("texts"), *(F.sum(c).alias(c) for c in ("pages", "chars", "links")))
    wins = (F.col("links") > LINK_PART * F.col("chars")) | (F.col("texts") < TEXT_PART * F.col("pages"))
    return paths.where((F.col("pages") >= HOST_PAGES) & wins).select("site", "path")


def _hashed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([path_hash(s, p) for s, p in zip(b["site"].to_pylist(), b["path"].to_pylist(), strict=True)], pa.int64())], names=["won"])


def _asked(batches: Iterator) -> Iterator:
    """(page, won): the hash of every path of a page."""
    import pyarrow as pa

    for b in batches:
        for page, site, html in zip(b["page"].to_pylist(), b["site"].to_pylist(), b["html"].to_pylist(), strict=True):
            hashes = list({path_hash(site, c.path) for c in containers(parse(html))})
            yield pa.RecordBatch.from_arrays([pa.array([page] * len(hashes), pa.int64()), pa.array(hashes, pa.int64())], names=["page", "won"])


def _extract(sent):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            known = None if sent is None else sent.value
            won = [known] * b.num_rows if sent is not None else [frozenset(x or ()) for x in b["won"].to_pylist()]
            texts = [article(parse(h), lambda p, s=s, w=w: path_hash(s, p) in w) for s, h, w in zip(b["site"].to_pylist(), b["html"].to_pylist(), won, strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(texts, pa.string())], names=["id", "article"])

    return run


def markup_articles(pages: DataFrame, sent_paths: int = SENT_PATHS) -> DataFrame:
    """(id, article): the text of the main content of every page of ``pages``
    (id, site, html), a line for each block.

    Winning paths are sent to the executors up to ``sent_paths``; beyond, the
    paths that a page asks for are joined, so a host with most pages is spread.

    Defined cases: rows with a null id or html are left out; pages of a null
    site, and of hosts with fewer than HOST_PAGES pages on a path, lose
    nothing; a page without text has an empty article; repeated rows give
    repeated rows; an empty table gives none; pages are read whole; further
    columns are ignored.
    """
    pages = pages.where("id is not null and html is not null").select(F.col("id").cast("bigint").alias("id"), F.col("site").cast("string").alias("site"), F.col("html").cast("string").alias("html"))
    paths = stored(furniture_paths(pages.where("site is not null")).mapInArrow(_hashed, "won bigint").distinct(), "markup-paths")
    if paths.count() <= sent_paths:
        sent = pages.sparkSession.sparkContext.broadcast(frozenset(paths.toArrow()["won"].to_pylist()))
        return pages.mapInArrow(_extract(sent), "id bigint, article string")
    pages = pages.withColumn("page", F.xxhash64("id", "site", "html"))
    asked = pages.mapInArrow(_asked, "page bigint, won bigint").join(paths, "won").groupBy("page").agg(F.collect_set("won").alias("won"))
    return pages.join(asked, "page", "left").mapInArrow(_extract(None), "id bigint, article string")
