"""Command line: ``python -m quarrymill.cli build --input site --output index``."""

from __future__ import annotations

import argparse
import sys

from quarrymill import __version__
from quarrymill.constants import MAX_SHARD_TERMS, SHARD_PREFIX_LEN, URL_MODES
from quarrymill.sources.pages import EXCLUDE, INCLUDE


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrymill", description="Full-text indexes on Spark")
    p.add_argument("-V", "--version", action="version", version=__version__)
    build = p.add_subparsers(dest="command", required=True).add_parser("build", help="index a folder of HTML files")
    build.add_argument("--input", required=True, help="folder with HTML files")
    build.add_argument("--output", required=True, help="folder for the index")
    build.add_argument("--baseUrl", default="/", help="prefix of all URLs")
    build.add_argument("--shard", action=argparse.BooleanOptionalAction, default=True, help="one file per shard, or one in all")
    build.add_argument("--urlMode", default="pretty", choices=URL_MODES)
    build.add_argument("--shardPrefixLen", type=int, default=SHARD_PREFIX_LEN, choices=(SHARD_PREFIX_LEN,))
    build.add_argument("--maxShardTerms", type=int, default=MAX_SHARD_TERMS, help="warn of shards with more terms; 0: never")
    build.add_argument("--include", default=INCLUDE)
    build.add_argument("--exclude", default=EXCLUDE)
    build.add_argument("--format", default="json", choices=("json", "parquet"), help="json: files for web pages; parquet: written by the executors, for large collections")
    build.add_argument("--verbose", action="store_true", help="name the skipped pages")
    return p


def run_build(spark, o: argparse.Namespace, say=print) -> dict:
    """Build the index that the options ask for; returns its manifest."""
    from pyspark.sql import functions as F

    from quarrymill.functions.urls import normalize_base_url
    from quarrymill.operators.html import extract_all
    from quarrymill.operators.indexer import assign_ids, build_index
    from quarrymill.session import ship, stored
    from quarrymill.sources.index_files import build_report, write_json_index, write_parquet_index
    from quarrymill.sources.pages import read_html_dir

    ship(spark)
    pages = stored(extract_all(read_html_dir(spark, o.input, o.include, o.exclude), base_url=o.baseUrl, url_mode=o.urlMode), "pages")  # markup is read once
    if o.verbose:
        for r in pages.where("skipped").select("path").orderBy("path").toLocalIterator():
            say(f"- skipped {r['path']}")
    docs, postings = build_index(assign_ids(pages.where(~F.col("skipped")).drop("skipped")))
    postings = stored(postings, "postings")
    if o.format == "parquet":
        meta, names = write_parquet_index(docs, postings, o.output, base_url=normalize_base_url(o.baseUrl)), ("docs", "postings")
    else:
        meta, names = write_json_index(docs, postings, o.output, normalize_base_url(o.baseUrl), o.shard), ("index.meta.json", "docs.json", "inv" if o.shard else "index.inv.json")
    for line in build_report(docs, postings, o.maxShardTerms, o.shard):
        say(line)
    out = o.output.rstrip("/")
    for name in names:
        say(f"Wrote {out}/{name}")
    return meta


def main(argv: list[str] | None = None) -> int:
    options = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quarrymill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run_build(spark, options)
    except Exception as e:  # noqa: BLE001
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
