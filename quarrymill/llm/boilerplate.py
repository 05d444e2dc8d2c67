"""Main content of pages, by consensus host paths.

A page's lines are scored as its containers: a headline or heading, running
sentences, list items and code speak for content, everything outside the span
of the article or without such a form against it.  Every line also has a
generalised path, the form it shares with lines of other pages: brand and
numbers masked, what follows a label or a breadcrumb dropped.  In one pass the
pages of a host vote on its paths; paths of furniture win on many pages and
hosts, those of an article on few.  In a second pass each page is extracted
again with the winning paths of its host and of the web.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import stored

#: A path is furniture on a host from so many pages, or anywhere from so many hosts, if content is under this part of its votes.
HOST_PAGES, WEB_HOSTS, CONTENT_PART = 3, 3, 0.34
#: Lines that read as sentences of some length and don't name the site need so many pages or hosts: copies of an article repeat them too.
SENTENCE_PAGES, SENTENCE_CHARS = 8, 45
#: Characters from which a line's path is a hash of it and wins like that of a sentence.
LONG_CHARS = 160
#: Winning paths whose hashes may be sent to the executors (64 MB); beyond, the paths that a page asks for are joined.
SENT_PATHS = 8_000_000
#: Characters of a body that are compared with its excerpt; a longer excerpt is judged by itself.
HEAD_CHARS = 256

#: Month names in English, German, French and Spanish.
_MONTHS = """january february march april may june july august september october november december
januar februar märz april mai juni juli august september oktober november dezember
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre""".split()
_MONTH = re.compile(rf"(?<=0)(\W+(?:de )?)(?:{'|'.join(sorted(set(_MONTHS), key=len, reverse=True))})(?=\W+(?:de )?0)")
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad]+")
_BULLET = re.compile(r"^(?:[-*•–+]|\(?\d{1,3}[.)])\s+(?=\S)")
_QUOTES = ("»", ">", "›")
_QUOTE = re.compile(r"^[»>›]+\s+")
_LABEL = re.compile(r"^(\W*\w+(?:[ '’-]\w+){0,2}) ?: +\S")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_SIGNS = "·|›•→←"
_PARTS = re.compile(rf"\s*[{_SIGNS}/]\s*|\s{{2,}}")
_SUFFIX = re.compile(r"\s+(?:[–—|·:-]|::|»|«)\s+")
_END = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
_WORD = re.compile(r"\w+")
#: Letters of scripts written without blanks: kana, ideographs, Thai, Lao, Burmese, Khmer.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
_CODE = re.compile(r"[=(){}<>`$\\_]|--|://|\w\.\w+\(|^\W*#")


def canon(line: str) -> str:
    """A line without invisible signs, extra white space, quote marks and letter case."""
    if not line.isascii():
        line = _INVISIBLE.sub("", line)
    s = " ".join(line.split())
    return (_QUOTE.sub("", s) if s[:1] in _QUOTES else s).casefold()


@lru_cache(maxsize=20_000)
def brand(site: str | None) -> re.Pattern | None:
    """What names the site in its own lines: the longer parts of its host name."""
    labels = (site or "").casefold().split(".")
    words = {w for x in (labels[:-1] or labels) for w in [x, *x.split("-")] if len(w) > 4}
    return re.compile("|".join(rf"\b{re.escape(w)}\b" for w in sorted(words, key=len, reverse=True))) if words else None


def path(c: str, mark: re.Pattern | None) -> str:
    """The generalised path of a canonical line."""
    if len(c) > LONG_CHARS:
        import xxhash

        return "¶" + xxhash.xxh3_64_hexdigest(mark.sub("§", c) if mark else c)
    s = _BULLET.sub("", c)
    if mark:
        s = mark.sub("§", s)
    if (t := _NUMBER.sub("0", s)) != s:
        s = _MONTH.sub(r"\1month", t)
    if ":" in s and not _END.search(s) and (m := _LABEL.match(s)):
        return m[1] + ": *"
    if "›" in s:
        return "›".join(s.split("›")[:2]).strip() + " › *"
    return s


def headline_forms(title: str | None, mark: re.Pattern | None) -> list[str]:
    """A title, and first what is left of it without the name of the site at its end."""
    if not title or not (c := canon(title)):
        return []
    parts = _SUFFIX.split(c)
    if len(parts) > 1 and mark and mark.search(parts[-1]):
        return [c[: len(c) - len(parts[-1])].rstrip(" –—|·:-»«"), c]
    return [c]


def align(lines: list[str], title: str | None, headings: list[str] | None, mark: re.Pattern | None) -> tuple[int | None, set[int]]:
    """The line of the headline, and those of the headings, which stand in order."""
    forms = headline_forms(title, mark)
    start = next((i for i, c in enumerate(lines) if c in forms), None)
    at, where = -1 if start is None else start, set()
    for h in headings or ():
        if not h or not (h := canon(h)):
            continue
        i = next((i for i in range(at + 1, len(lines)) if lines[i] == h or lines[i].startswith(h) and len(lines[i]) > len(h) + 12), None)
        if i is not None:
            where.add(i)
            at = i
    return start, where


def size(c: str) -> int:
    """Words of a line; in scripts without blanks two letters count as one."""
    words = c.count(" ") + 1
    return words if c.isascii() else words + sum(map(len, _UNSPACED.findall(c))) // 2


def words_over(x: str, least: int) -> list[str]:
    """Words of more than ``least`` letters; of scripts without blanks, neighbouring letters."""
    words = [w for w in _WORD.findall(x) if len(w) > least]
    if x.isascii() or not (runs := _UNSPACED.findall(x)):
        return words
    return [w for w in words if not _UNSPACED.search(w)] + [r[i : i + 2] for r in runs for i in range(len(r) - 1)]


def running(c: str) -> bool:
    """Does a canonical line read as a paragraph, a sentence, a list item or code?"""
    if len(c) > LONG_CHARS:
        return True
    words = size(c)
    if _BULLET.match(c):
        return words > 4
    if _END.search(c):
        return words > 2
    return words > 7 or words > 1 and bool(_CODE.search(c))


def topics(lines: list[str], runs: list[bool], title: str | None, headings: list[str] | None) -> set[str]:
    """What the page is about: the longer words most frequent in its title and
    headings, if they return in its sentences, lists or code."""
    words = Counter(w for x in (title, *(headings or ())) if x for w in set(words_over(canon(x), 5)))
    if not words:
        return set()
    text = [c for c, run in zip(lines, runs, strict=True) if run]
    counts = {w: sum(w in c for c in text) for w in words}
    most = max((words[w] for w in words if counts[w] > 1), default=0)
    return {w for w in words if words[w] == most and counts[w] > 1}


def alike(a: str, b: str) -> bool:
    """Are two short lines the same but for edits?"""
    if a == b or abs(len(a) - len(b)) >= 0.5 * max(len(a), len(b)):
        return a == b
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() > 0.66 and m.quick_ratio() > 0.66 and m.ratio() > 0.66


def _read(b, k: int) -> tuple[list[str], str | None, list[str] | None, re.Pattern | None]:
    text = b["text"][k]
    return [canon(x) for x in text.split("\n")] if text else [], b["title"][k], b["headings"][k], brand(b["site"][k])


def _votes(batches: Iterator) -> Iterator:
    """(site, path, pages, content, first, last): a batch's votes, and the least and greatest hash of the titles they come from."""
    import pyarrow as pa
    import xxhash

    def out(votes):
        cols = list(zip(*((s, p, *v) for (s, p), v in votes.items()), strict=True))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["site", "path", "pages", "content", "first", "last"])

    votes: dict = {}
    for batch in batches:
        b = batch.to_pydict()
        for k in range(batch.num_rows):
            lines, title, headings, mark = _read(b, k)
            start, heads = align(lines, title, headings, mark)
            forms = headline_forms(title, mark) or [canon(h) for h in (headings or ())[:1] if h]
            from_title = xxhash.xxh3_64_intdigest(forms[0] if forms else "") >> 1
            seen: dict[str, int] = {}
            runs = list(map(running, lines))
            bare = not heads and sum(run and (len(c) > LONG_CHARS or not (mark and mark.search(c))) for c, run in zip(lines, runs, strict=True)) < 4
            own = set(words_over(forms[0], 5)) if bare and forms else topics(lines, runs, title, headings)
            for i, c in enumerate(lines):
                if not c:
                    continue
                good = i == start or i in heads or ((bare or runs[i]) and any(t in c for t in own) and not (mark and mark.search(c)))
                p = path(c, mark)
                seen[p] = seen.get(p, 0) | good
            for p, good in seen.items():
                v = votes.get(key := (b["site"][k], p))
                if v is None:
                    votes[key] = [1, good, from_title, from_title]
                else:
                    v[0] += 1
                    v[1] += good
                    v[2], v[3] = min(v[2], from_title), max(v[3], from_title)
        if len(votes) > 100_000:
            yield out(votes)
            votes = {}
    if votes:
        yield out(votes)


def host_paths(pages: DataFrame) -> DataFrame:
    """(site, path) of the winning furniture paths of each host; site is '*'
    for those that win on the web as a whole.  ``pages``: (site, title,
    headings, text)."""
    votes = pages.mapInArrow(_votes, "site string, path string, pages bigint, content bigint, first bigint, last bigint")
    by_host = votes.groupBy("site", "path").agg(*(F.sum(c).alias(c) for c in ("pages", "content")), F.min("first").alias("first"), F.max("last").alias("last"))
    by_host = stored(by_host, "host-votes")  # read twice below
    reads = F.col("path").startswith("¶") | F.col("path").rlike(r"[.!?…。！？]$") & (F.length("path") >= SENTENCE_CHARS) & ~F.col("path").contains("§")
    web = by_host.groupBy("path").agg(F.count("*").alias("hosts"), *(F.sum(c).alias(c) for c in ("pages", "content")), F.min("first").alias("first"), F.max("last").alias("last"))
    wins = (F.col("content") < CONTENT_PART * F.col("pages")) & (F.col("first") < F.col("last"))
    web = web.where((F.col("hosts") >= F.when(reads, SENTENCE_PAGES).otherwise(WEB_HOSTS)) & wins).select(F.lit("*").alias("site"), "path")
    return by_host.where((F.col("pages") >= F.when(reads, SENTENCE_PAGES).otherwise(HOST_PAGES)) & wins & F.col("site").isNotNull()).select("site", "path").unionByName(web)


def paths_of(c: str, mark: re.Pattern | None) -> tuple[str, list[str]]:
    """The path of a line, and those of the entries that it lists."""
    if not c:
        return "", []
    if len(c) > LONG_CHARS and all(c.count(sign) < 3 for sign in _SIGNS):
        return path(c, mark), []  # a paragraph lists nothing
    parts = [p for p in _PARTS.split(_BULLET.sub("", c)) if p] if _PARTS.search(c) else ()
    return path(c, mark), [path(p, mark) for p in parts] if len(parts) > 1 else []


def path_hash(site: str | None, p: str) -> int:
    """Of a host's path, or with site '*' of a path of the web."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{site}\0{p}") - (1 << 63)


def furniture(lines: list[str], title: str | None, headings: list[str] | None, mark: re.Pattern | None, voted, paths=None) -> list[int]:
    """The non-blank lines outside the article, by index.  ``voted(path)``
    tells whether a path won as furniture on the host or the web; ``paths``
    has ``paths_of`` each line where that is known."""
    start, heads = align(lines, title, headings, mark)

    def lost(i: int) -> bool:
        whole, parts = paths[i] if paths else paths_of(lines[i], mark)
        return bool(whole) and (voted(whole) or len(parts) > 1 and all(map(voted, parts)))

    gone = {i for i, c in enumerate(lines) if c and i not in heads and i != start and lost(i)}
    runs = list(map(running, lines))
    own = topics(lines, runs, title, headings)
    first = min([*heads, *(i for i, c in enumerate(lines) if c and i not in gone and runs[i])], default=len(lines))
    if start is None or start > first:  # no line is the title as it stands
        above = [i for i in range(first) if lines[i] and i not in gone]
        forms = headline_forms(title, mark)
        start = next((i for i in above if any(alike(lines[i], f) for f in forms)), None)
        if start is None:
            start = next((i for i in above if any(t in lines[i] for t in own)), above[0] if above else first)
    there = {lines[i] for i in heads}
    missing = [h for h in map(canon, filter(None, headings or ())) if h not in there]
    said = {w for i, c in enumerate(lines) if i >= start and i not in gone and runs[i] for w in words_over(c, 6)} if not (headings or own) else set()
    out: list[int] = []
    for i, c in enumerate(lines):
        if not c:
            continue
        if i in gone or i < start:
            out.append(i)
        elif not (i == start or i in heads or runs[i]):
            if headings:
                good = any(alike(c, h) for h in missing)
            elif own:
                good = any(t in c for t in own)
            else:
                good = any(w in said for w in words_over(c, 6))
            if not good:
                out.append(i)
    return out


def _hashed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        sites = b["site"].to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([path_hash(s, p) for s, p in zip(sites, b["path"].to_pylist(), strict=True)], pa.int64())], names=["won"])


def _asked_paths(part):
    """Pages as read, the paths of their lines, and the hash of every (site, path) that they ask for, the web's included."""
    b = part.to_pydict()
    pages = [_read(b, k) for k in range(part.num_rows)]
    paths = [[paths_of(c, mark) for c in lines] for lines, _, _, mark in pages]
    asked: dict = {}
    for site, page in zip(b["site"], paths, strict=True):
        for whole, parts in page:
            for p in (whole, *parts):
                if p:
                    asked[site, p] = asked["*", p] = 0
    return b, pages, paths, {key: path_hash(*key) for key in asked}


def _ask(batches: Iterator) -> Iterator:
    """(page, won): every path that a page asks for."""
    import pyarrow as pa

    for whole in batches:
        for k in range(whole.num_rows):
            hashes = list(_asked_paths(whole.slice(k, 1))[3].values())
            yield pa.RecordBatch.from_arrays([pa.array([whole["page"][k].as_py()] * len(hashes), pa.int64()), pa.array(hashes, pa.int64())], names=["page", "won"])


def _extract(sent, texts: bool):
    """(kind, id, lines, head) of pages, or (kind, id, article); the winning
    paths are sent, or those that a page asks for come with it."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                b, pages, paths, asked = _asked_paths(part)
                if sent is None:
                    own = [set(x or ()) for x in b["won"]]
                else:
                    hashes, known = np.fromiter(asked.values(), "int64", len(asked)), sent.value
                    near = np.searchsorted(known, hashes)
                    own = [set(hashes[known[np.minimum(near, len(known) - 1)] == hashes].tolist()) if len(known) else set()] * len(pages)
                found = []
                for k, (lines, title, headings, mark) in enumerate(pages):
                    site, won = b["site"][k], own[k]
                    found.append([i + 1 for i in furniture(lines, title, headings, mark, lambda p, site=site, won=won: asked["*", p] in won or asked[site, p] in won, paths[k])])
                if texts:
                    kept = ["\n".join([x for n, x in enumerate(t.split("\n"), 1) if n not in gone]) for t, gone in zip(b["text"], map(set, found), strict=True)]
                    yield pa.RecordBatch.from_arrays([part["kind"], part["id"], pa.array(kept, pa.string())], names=["kind", "id", "article"])
                else:
                    head = pc.utf8_slice_codeunits(part["text"], 0, HEAD_CHARS)
                    yield pa.RecordBatch.from_arrays([part["kind"], part["id"], pa.array(found, pa.list_(pa.int32())), head], names=["kind", "id", "lines", "head"])

    return run


def page_rows(docs: DataFrame, kind: str, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(
        *more,
        F.lit(kind).alias("kind"),
        F.col(id_col).cast("bigint").alias("id"),
        *(F.col(c).cast("string").alias(c) for c in ("site", "title")),
        F.col("headings").cast("array<string>").alias("headings"),
        F.col(text_col).cast("string").alias("text"),
    ).where("id is not null and text is not null")


def winning_paths(voters: DataFrame) -> DataFrame:
    """(won): the hashes of the winning paths of hosts and of the web, stored."""
    voters = voters.where("id is not null and text is not null").select("site", "title", "headings", "text")
    return stored(host_paths(voters).mapInArrow(_hashed, "won bigint").distinct(), "host-paths")


def furniture_lines(pages: DataFrame, voters: DataFrame | None = None, sent_paths: int = SENT_PATHS, texts: bool = False, paths: DataFrame | None = None) -> DataFrame:
    """(kind, id, lines, head): the lines outside the article, as numbers from
    1, of every page of ``pages`` (kind, id, site, title, headings, text), and
    its first HEAD_CHARS characters.  The paths are voted on by ``voters``, by
    default the pages themselves, or are given by ``winning_paths``.

    Defined cases: rows with a null id or text are left out; a null site votes
    only on the web as a whole; null titles and headings are unknown, an empty
    list of headings says that the article has none; blank lines are never
    returned; a page without furniture, or of blanks only, has an empty list;
    repeated rows give repeated rows; an empty table gives none; texts are
    read whole; further columns are ignored.
    """
    import numpy as np

    pages = pages.where("id is not null and text is not null").select("kind", "id", "site", "title", "headings", "text")
    paths = winning_paths(pages if voters is None else voters) if paths is None else paths
    schema = "kind string, id bigint, " + ("article string" if texts else "lines array<int>, head string")
    if paths.count() <= sent_paths:
        sent = pages.sparkSession.sparkContext.broadcast(np.sort(paths.toArrow()["won"].to_numpy()))
        return pages.mapInArrow(_extract(sent, texts), schema)
    # by page, so that a host with most pages is spread; equal pages ask for the same
    pages = pages.withColumn("page", F.xxhash64("kind", "id", "site", "title", "headings", "text"))
    asked = pages.mapInArrow(_ask, "page bigint, won bigint").join(paths, "won").groupBy("page").agg(F.collect_set("won").alias("won"))
    return pages.join(asked, "page", "left").mapInArrow(_extract(None, texts), schema)


def articles(pages: DataFrame, **options) -> DataFrame:
    """(kind, id, article): each page's text with the lines of its article
    only, blank ones kept; cases as in ``furniture_lines``."""
    return furniture_lines(pages, texts=True, **options)


def found(indexable: DataFrame, extracted: DataFrame) -> DataFrame:
    """p1_found: (record_table, record_id, line_no).

    An excerpt that is its body's beginning, but for a cut marked by "…", has
    the body's lines outside the article; any other is judged by itself."""
    bodies = page_rows(indexable, "indexable_documents", "id", "body_text")
    paths = winning_paths(bodies)
    lines = stored(furniture_lines(bodies, paths=paths).distinct(), "furniture")
    e = page_rows(extracted, "extracted_documents", "extract_id", "excerpt", F.col("doc_id").cast("bigint").alias("doc"))
    same = F.col("head").startswith(F.regexp_replace("text", "…\\z", "")) & (F.length("text") < HEAD_CHARS)
    met = e.where("doc is not null").join(lines.select(F.col("id").alias("doc"), "head", F.col("lines").alias("body_lines")), "doc", "left").withColumn("same", F.coalesce(same, F.lit(False)))
    met = stored(met, "excerpts")
    inside = met.where("same").select("kind", "id", F.split("text", "\n", -1).alias("parts"), F.explode("body_lines").alias("line_no"))
    inside = inside.where((F.col("line_no") <= F.size("parts")) & (F.trim(F.try_element_at("parts", F.col("line_no"))) != "")).select("kind", "id", "line_no")
    alone = furniture_lines(met.where("not same").select(*e.columns).unionByName(e.where("doc is null")), paths=paths)
    numbered = lines.unionByName(alone).select("kind", "id", F.explode("lines").alias("line_no"))
    return numbered.unionByName(inside).select(F.col("kind").alias("record_table"), F.col("id").alias("record_id"), "line_no").distinct()
