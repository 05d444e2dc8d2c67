"""HTML pages from folders and tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INCLUDE, EXCLUDE = "**/*.html", "**/search/**"


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob over relative paths: ``**`` spans
    folders, ``*`` and ``?`` stay in one, ``{a,b}`` and ``[...]`` are choices."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1 if glob[i + 1] == "!" else 0) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def read_html_dir(spark: SparkSession, folder: str, include: str = INCLUDE, exclude: str | None = EXCLUDE) -> DataFrame:
    """(path, html): one row per file whose path under ``folder`` matches
    ``include`` and not ``exclude``.  Paths are relative.  Files whose names
    begin with a dot or underscore are hidden from Spark and left out."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    full = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = raw.select(full.alias("full"), F.col("value").alias("html"))
    base = folder.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    rows = rows.select(F.expr("substring(full, locate(base, full) + length(base))".replace("base", "'" + base.replace("\\", "\\\\").replace("'", "\\'") + "'")).alias("path"), "html")
    rows = rows.where(F.col("path").rlike(glob_pattern(include)))
    return rows.where(~F.col("path").rlike(glob_pattern(exclude))) if exclude else rows


def read_html_table(spark: SparkSession, path: str, path_col: str = "path", html_col: str = "html") -> DataFrame:
    """(path, html) from a Parquet table of pages."""
    return spark.read.parquet(path).select(F.col(path_col).alias("path"), F.col(html_col).alias("html"))
