"""URL functions: on the driver for one value, as Columns for many."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.constants import URL_MODES

_DOT, _DOTS = re.compile(r"(?:\.|%2e)\Z", re.I), re.compile(r"(?:\.|%2e){2}\Z", re.I)
# Signs that a path shows percent-encoded, and those that no host has.
_ENCODED, _NO_HOST = frozenset(' "#<>?^`{}'), re.compile(r"[\x00-\x20\x7f#%/:<>?@\[\\\]^|]")


def _pathname(url: str) -> str:
    """The path of an absolute http(s) url as browsers have it: dot segments
    resolved, blanks and other signs percent-encoded.  Raises ValueError for
    no url."""
    s = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    rest = s.split(":", 1)[1].lstrip("/\\")
    host, path = re.match(r"([^/\\?#]*)([^?#]*)", rest).groups()
    m = re.fullmatch(r"(\[[0-9a-fA-F:.]+\]|[^:]*)(?::(\d*))?", host.rpartition("@")[2])
    name, port = m.groups() if m else ("", None)
    if not name or int(port or 0) > 65535 or (name[0] != "[" and _NO_HOST.search(name)):
        raise ValueError(f"no url: {url}")
    out: list[str] = []
    parts = re.split(r"[/\\]", path)[1:] or [""]
    for i, part in enumerate(parts):
        if _DOT.match(part) or _DOTS.match(part):
            if _DOTS.match(part) and out:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append("".join(c if " " < c < "\x7f" and c not in _ENCODED else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in part))
    return "/" + "/".join(out)


def normalize_base_url(base: str) -> str:
    """The path of a base URL between slashes; ``/`` for none."""
    path = base.strip()
    absolute = "https:" + path if path.startswith("//") else path
    if absolute.startswith(("http://", "https://")):
        try:
            path = _pathname(absolute)
        except ValueError:
            pass  # stays as it is
    if path in ("", "/"):
        return "/"
    return "/" * (not path.startswith("/")) + path + "/" * (not path.endswith("/"))


def normalize_base_url_col(base: Column) -> Column:
    """``normalize_base_url`` of a column, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def paths(values):
        return values.map(normalize_base_url, na_action="ignore")

    return paths(base)


def file_url(relative: Column, base_url: str = "/", mode: str = "pretty") -> Column:
    """The URL of a file under the input folder.  ``pretty`` drops
    ``index.html`` and ``.html``; ``html`` keeps them; other files map to the
    base itself."""
    if mode not in URL_MODES:
        raise ValueError(f"unknown URL mode: {mode}")
    base = normalize_base_url(base_url)
    if mode == "html":
        path = F.when(relative.endswith(".html"), relative).otherwise("")
    else:
        path = (
            F.when(relative == "index.html", "")
            .when(relative.endswith("/index.html"), F.regexp_replace(relative, "index\\.html$", ""))
            .when(relative.endswith(".html"), F.regexp_replace(relative, "\\.html$", ""))
            .otherwise("")
        )
    return F.concat(F.lit(base), path)
