"""Text functions as Column expressions; they stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.constants import ASCII_BOUNDARY, EXCERPT_CHARS, EXCERPT_MIN_CUT, FIELD_TOKEN_LIMITS, QUERY_MAX_TOKENS, STOPWORDS, WEB_SPACE

_STOP = frozenset(STOPWORDS)


def _checked(limit: int | None) -> int | None:
    if limit is not None and limit < 0:
        raise ValueError(f"a limit can't be negative: {limit}")
    return limit or None  # 0 means none


def normalize_ws(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, WEB_SPACE, " "))


def tokenize(text: Column, dedupe: bool = False, limit: int | None = None) -> Column:
    """Lower-case runs of a-z and 0-9 of two characters or more that aren't
    stopwords, in order; with ``dedupe`` the first of each, and of these the
    first ``limit`` (0 or None: all).  A null text has no tokens."""
    limit = _checked(limit)
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    stop = F.array(*map(F.lit, STOPWORDS))
    # array_except looks up in a hash set and keeps the first of each in order
    kept = F.array_except(runs, stop) if dedupe else F.filter(runs, lambda x: ~x.isin(*STOPWORDS))
    kept = F.coalesce(kept, F.array().cast("array<string>"))
    return F.slice(kept, 1, limit) if limit else kept


def tokenize_field(text: Column, limit: int) -> Column:
    """Distinct tokens of a field."""
    return tokenize(text, True, limit)


def field_tokens(title: Column, headings: Column, body: Column) -> dict[str, Column]:
    """Distinct tokens of a document's three fields within their limits."""
    texts = {"title": title, "headings": F.array_join(headings, " "), "body": body}
    return {f: tokenize_field(t, FIELD_TOKEN_LIMITS[f]) for f, t in texts.items()}


def tokenize_query(text: Column, max_tokens: int = QUERY_MAX_TOKENS) -> Column:
    """Distinct tokens of a query; an array of strings is joined first."""
    return tokenize(text, True, max_tokens)


def query_tokens(text: str | list[str], max_tokens: int = QUERY_MAX_TOKENS) -> list[str]:
    """``tokenize_query`` of one query on the driver."""
    max_tokens = _checked(max_tokens)
    text = text if isinstance(text, str) else " ".join(text)
    kept = [t for t in re.findall("[a-z0-9]{2,}", text.lower()) if t not in _STOP]
    return list(dict.fromkeys(kept))[:max_tokens]


def excerpt(body: Column, chars: int = EXCERPT_CHARS) -> Column:
    """A text of at most ``chars`` characters whole; else its first ``chars``,
    cut at the last blank if that lies far enough, and an ellipsis."""
    head = F.substring(body, 1, chars)
    blank = F.lit(chars + 1) - F.instr(F.reverse(head), " ")  # place of the last blank, from 1
    cut = F.when((F.instr(head, " ") > 0) & (blank > EXCERPT_MIN_CUT + 1), F.substring(head, F.lit(1), blank - 1)).otherwise(head)
    return F.when(F.length(body) <= chars, body).otherwise(F.concat(cut, F.lit("…")))


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def escape_regex(text: Column) -> Column:
    """A backslash before every sign that means something in a pattern."""
    return F.regexp_replace(text, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def highlight(text: Column, tokens: Column) -> Column:
    """Escaped text with ``<mark>`` around whole words that are tokens, whatever
    their case; longer tokens first.  Without tokens only escaped.  Marks can
    fall inside entities (token ``amp``), since the text is escaped first."""
    longest = F.array_sort(F.array_distinct(tokens), lambda a, b: F.length(b) - F.length(a))
    words = F.array_join(F.transform(longest, escape_regex), "|")
    pattern = F.concat(F.lit(f"(?i){ASCII_BOUNDARY}("), words, F.lit(f"){ASCII_BOUNDARY}"))
    safe = escape_html(text)
    return F.when(F.coalesce(F.size(tokens), F.lit(0)) < 1, safe).otherwise(F.regexp_replace(safe, pattern, F.lit("<mark>$1</mark>")))
