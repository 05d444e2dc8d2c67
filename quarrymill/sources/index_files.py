"""Index files: Parquet for large collections, JSON for exchange.

The JSON layouts are a manifest ``index.meta.json``, the stored documents
``docs.json`` and either one ``index.inv.json`` (version 1) or one
``inv/<shard>.json`` per shard (version 2).  Files go through Hadoop's file
systems, so any folder that Spark can reach will do.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from itertools import groupby

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.indexer import nest_postings
from quarrymill.operators.shards import build_shards, shard_stats, sharding_meta

META, DOCS, SINGLE = "index.meta.json", "docs.json", "index.inv.json"
DOC_SCHEMA = "id bigint, url string, title string, headings array<string>, excerpt string"
TERMS_SCHEMA = "terms map<string, array<array<bigint>>>"
#: Where the text of a version 1 index is cut: what ends a term's list, and nothing else in the format.
LIST_END = "]]"
META_SCHEMA = "version int, generatedAt string, baseUrl string, docCount bigint, docs struct<path: string>, inv struct<path: string, sharding: struct<strategy: string, shardPrefixLen: int, fallbackShard: string, map: map<string, string>>>"


def resolve_path(base: str, part: str) -> str:
    """A part's path relative to the manifest's."""
    return part if "://" in part or part.startswith("/") else posixpath.join(posixpath.dirname(base), part)


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


# ---- JSON


def read_json(spark: SparkSession, path: str | list[str], schema: str, reader=None) -> DataFrame:
    """JSON files with a schema.  ``reader(paths, schema)`` may replace the
    read; see ``read_single`` for its ``text``.  Raises FileNotFoundError where
    a path can't be loaded."""
    paths = [path] if isinstance(path, str) else path
    try:
        return reader(paths, schema) if reader else spark.read.schema(schema).option("multiLine", True).json(paths)
    except AnalysisException as e:
        raise FileNotFoundError(f"Failed to load {', '.join(paths)}: {e.getCondition()}") from e


def read_meta(spark: SparkSession, path: str, reader=None) -> dict:
    row = read_json(spark, path, META_SCHEMA, reader).first()
    if row is None or row["version"] is None:
        raise ValueError(f"no manifest in {path}")
    if row["version"] not in (1, 2):
        raise ValueError(f"unknown version of an index: {row['version']}")
    return row.asDict(recursive=True)


def long_postings(nested: DataFrame) -> DataFrame:
    """(term, doc_id, weight) from rows of ``TERMS_SCHEMA``."""
    terms = nested.select(F.explode("terms").alias("term", "pairs"))
    pairs = terms.select("term", F.explode("pairs").alias("p"))
    return pairs.select("term", F.col("p")[0].alias("doc_id"), F.col("p")[1].alias("weight"))


_BLANK = r"[ \t\r\n]*"
_OPENED = rf'\{{{_BLANK}"terms"{_BLANK}:{_BLANK}\{{'
#: A term and the beginning of its list, after a comma or what opens the file.
_HEAD = rf'^{_BLANK}(?:{_OPENED}|,){_BLANK}("[^"\\]*+(?:\\.[^"\\]*+)*+"){_BLANK}:{_BLANK}\[{_BLANK}(?=\[)'
_TAIL = rf"^{_BLANK}(?:{_OPENED}{_BLANK})?\}}{_BLANK}\}}{_BLANK}\z"


def read_single(spark: SparkSession, path: str, reader=None) -> DataFrame:
    """(term, doc_id, weight) of the one file of version 1.

    The text is read in pieces of a term each, by as many tasks as the file
    has splits, so that no more than a term's list is held.  A file that can't
    be cut so (white space within the ends of lists, further keys, empty
    lists, brackets in terms) is parsed as a whole; which it is, one pass over
    the text tells.  ``reader.text(paths, separator)`` may replace the read by
    rows (value), the text between separators; a reader without it gives the
    file by one row, so no more than fits there."""
    if reader and not hasattr(reader, "text"):
        return long_postings(read_json(spark, path, TERMS_SCHEMA, reader))
    try:
        pieces = reader.text([path], LIST_END) if reader else spark.read.option("lineSep", LIST_END).text(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"Failed to load {path}: {e.getCondition()}") from e
    value = F.col("value")
    is_list = value.rlike(_HEAD) & ~F.regexp_replace(value, _HEAD, "").rlike(r"[^0-9,\[\] \t\r\n-]")
    is_end = value.rlike(_TAIL)
    opens = value.rlike(rf"^{_BLANK}{_OPENED}")
    seen = pieces.where(~value.rlike(rf"^{_BLANK}\z")).agg(F.count_if(~is_list & ~is_end).alias("odd"), F.count_if(is_end).alias("ends"), F.count_if(opens).alias("begins")).first()
    if (seen["odd"], seen["ends"], seen["begins"]) != (0, 1, 1):
        return long_postings(read_json(spark, path, TERMS_SCHEMA, reader))
    key = F.from_json(F.concat(F.lit('{"t":'), F.regexp_extract(value, _HEAD, 1), F.lit("}")), "t string")["t"]
    terms = pieces.where(value.rlike(_HEAD)).select(key.alias("term"), F.concat(F.lit("["), F.regexp_replace(value, _HEAD, ""), F.lit(LIST_END)).alias("list"))
    pairs = terms.select("term", F.explode(F.from_json("list", "array<array<bigint>>")).alias("p"))
    return pairs.select("term", F.col("p")[0].alias("doc_id"), F.col("p")[1].alias("weight"))


def open_index(spark: SparkSession, meta_path: str, reader=None) -> tuple[DataFrame, DataFrame, dict | None]:
    """(docs, postings, sharding) of a JSON index of either version.  Only the
    manifest is read now, and of version 1 the text once."""
    meta = read_meta(spark, meta_path, reader)
    docs = read_json(spark, resolve_path(meta_path, meta["docs"]["path"]), DOC_SCHEMA, reader)
    if meta["version"] == 1:
        return docs, read_single(spark, resolve_path(meta_path, meta["inv"]["path"]), reader), None
    sharding = meta["inv"]["sharding"]
    sharding["map"] = sharding["map"] or {}
    parts = [resolve_path(meta_path, p) for p in sharding["map"].values()]
    if not parts:
        return docs, spark.createDataFrame([], "term string, doc_id bigint, weight bigint, shard string"), sharding
    raw = read_json(spark, parts, TERMS_SCHEMA, reader)
    # the file tells the shard; a filter on it prunes files before they are read
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1) if reader is None else F.lit(None).cast("string")
    shards = {posixpath.basename(p).removesuffix(".json"): s for s, p in sharding["map"].items()}
    terms = raw.select(name.alias("__file"), F.explode("terms").alias("term", "pairs"))
    pairs = terms.select("__file", "term", F.explode("pairs").alias("p"))
    if reader is None:
        shard = F.create_map(*(F.lit(x) for kv in shards.items() for x in kv))[F.col("__file")] if any(k != v for k, v in shards.items()) else F.col("__file")
    else:
        from quarrymill.operators.shards import shard_key

        shard = shard_key(F.col("term"), sharding["shardPrefixLen"], sharding["fallbackShard"])
        shard = F.when(shard.isin(sorted(sharding["map"])), shard).otherwise(sharding["fallbackShard"])
    return docs, pairs.select("term", F.col("p")[0].alias("doc_id"), F.col("p")[1].alias("weight"), shard.alias("shard")), sharding


class _Files:
    """Text files in any of Hadoop's file systems, written by the driver piece by piece."""

    CHUNK = 1 << 20

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.setWriteChecksum(False)

    def write(self, name: str, pieces: Iterable[str]) -> None:
        out, held, size = self.fs.create(self.path(f"{self.folder}/{name}"), True), [], 0
        try:
            for p in pieces:
                held.append(p)
                size += len(p)
                if size > self.CHUNK:
                    out.write(bytearray("".join(held).encode("utf-8", "replace")))
                    held, size = [], 0
            out.write(bytearray("".join(held).encode("utf-8", "replace")))
        finally:
            out.close()

    def write_joined(self, name: str, head: str, parts: str, tail: str) -> None:
        """The text files in the folder ``parts`` one after the other, without
        their first character, between ``head`` and ``tail``.  Their bytes
        pass the driver in Hadoop's small buffer only."""
        conf, hadoop = self.fs.getConf(), self.jvm.org.apache.hadoop.io
        codecs = hadoop.compress.CompressionCodecFactory(conf)
        found = sorted((f.getPath().getName() for f in self.fs.listStatus(self.path(f"{self.folder}/{parts}"))), key=lambda n: (len(n), n))
        out, begun = self.fs.create(self.path(f"{self.folder}/{name}"), True), False
        try:
            out.write(bytearray(head.encode()))
            for n in found:
                if not n.startswith("part-"):
                    continue
                path = self.path(f"{self.folder}/{parts}/{n}")
                part, codec = self.fs.open(path), codecs.getCodec(path)
                text = codec.createInputStream(part) if codec else part
                try:
                    if begun or text.read() != -1:
                        begun = True
                        hadoop.IOUtils.copyBytes(text, out, conf, False)
                finally:
                    text.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()

    def clear(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.folder}/{name}"), True)


def _listed(texts: Iterable[str]) -> Iterator[str]:
    """Texts with commas between them."""
    for i, t in enumerate(texts):
        yield f",{t}" if i else t


def _write_docs(files: _Files, docs: DataFrame) -> int:
    rows = docs.orderBy("id").select(F.to_json(F.struct("id", "url", "title", "headings", "excerpt"), {"ignoreNullFields": "false"}).alias("j"))
    count = 0

    def pieces():
        nonlocal count
        yield "["
        for piece in _listed(r["j"] for r in rows.toLocalIterator()):
            count += 1
            yield piece
        yield "]"

    files.write(DOCS, pieces())
    return count


def _terms(rows: Iterable) -> Iterator[str]:
    """The text of a file of terms, from rows (term, j) in their order."""
    yield '{"terms":{'
    yield from _listed(f"{json.dumps(r['term'], ensure_ascii=False)}:{r['j']}" for r in rows)
    yield "}}"


def _write_single(files: _Files, nested: DataFrame) -> None:
    """The one file of version 1.  The executors write its text in the order of
    the terms, in pieces as ``read_single`` reads them: brackets in terms are
    escaped, so that nothing else ends as a list does."""
    parts = f".{SINGLE}-parts"
    term = F.regexp_extract(F.to_json(F.struct("term")), r'^\{"term":(.*)\}\z', 1)
    ordered = nested.where("term is not null").orderBy(F.collate("term", "UNICODE"))
    pieces = ordered.select(F.concat(F.lit(","), F.replace(term, F.lit("]"), F.lit("\\u005d")), F.lit(":"), F.expr(f"substr(j, 1, length(j) - {len(LIST_END)})")).alias("value"))
    try:
        pieces.write.mode("overwrite").option("lineSep", LIST_END).option("compression", "gzip").text(f"{files.folder}/{parts}")
        files.write_joined(SINGLE, '{"terms":{', parts, "}}")
    finally:
        files.clear(parts)


def write_json_index(docs: DataFrame, postings: DataFrame, folder: str, base_url: str = "/", sharded: bool = True, generated_at: str | None = None) -> dict:
    """Write an index of version 2 (``sharded``) or 1 and return its manifest.
    Documents and, of version 2, terms pass the driver one after the other, in
    the order of the files, terms and shards in collated order; none but a
    term's list is held as a whole.  Stale shard files of an earlier index are removed.  The
    format suits what a web page can load; see ``write_parquet_index`` for
    more."""
    files = _Files(docs.sparkSession, folder)
    count = _write_docs(files, docs)
    meta: dict = {"version": 2 if sharded else 1, "generatedAt": generated_at or now(), "baseUrl": base_url, "docCount": count}
    nested = nest_postings(postings).withColumn("j", F.to_json("postings"))
    if sharded:
        files.clear("inv")
        rows = build_shards(nested).orderBy(F.collate("shard", "UNICODE"), F.collate("term", "UNICODE")).select("shard", "term", "j").toLocalIterator()
        keys = []
        for shard, terms in groupby(rows, key=lambda r: r["shard"]):
            files.write(f"inv/{shard}.json", _terms(terms))
            keys.append(shard)
        meta |= {"docs": {"path": DOCS}, "inv": {"sharding": sharding_meta(keys)}}
    else:
        _write_single(files, nested)
        meta |= {"inv": {"path": SINGLE}, "docs": {"path": DOCS}}
    files.write(META, [json.dumps(meta, ensure_ascii=False, indent=2)])
    return meta


# ---- Parquet


def write_parquet_index(docs: DataFrame, postings: DataFrame, folder: str, prefix_len: int = 2, base_url: str = "/", generated_at: str | None = None) -> dict:
    """``docs`` and ``postings`` as Parquet, the latter a folder per shard, and
    what a manifest says of them.  Rows are rebalanced by shard, which splits a
    hot shard over several files and joins small ones, and sorted so that a
    term's rows lie together."""
    docs.write.mode("overwrite").parquet(f"{folder}/docs")
    sharded = build_shards(postings, prefix_len).hint("rebalance", "shard").sortWithinPartitions("shard", "term", "doc_id")
    sharded.write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/postings")
    return {"version": 2, "generatedAt": generated_at or now(), "baseUrl": base_url, "docCount": docs.sparkSession.read.parquet(f"{folder}/docs").count()}


def open_parquet_index(spark: SparkSession, folder: str, prefix_len: int = 2) -> tuple[DataFrame, DataFrame, dict]:
    """(docs, postings, sharding) of a Parquet index."""
    postings = spark.read.schema("term string, doc_id bigint, weight bigint, shard string").parquet(f"{folder}/postings")
    keys = [r["shard"] for r in postings.select("shard").distinct().collect()]  # from folder names, at most 36 ** prefix_len and one
    return spark.read.parquet(f"{folder}/docs"), postings, sharding_meta(sorted(keys), prefix_len)


def build_report(docs: DataFrame, postings: DataFrame, max_shard_terms: int, sharded: bool = True) -> list[str]:
    """Lines that sum up a build."""
    stats = shard_stats(build_shards(postings)).first()
    shards, largest = (stats["shard_count"], stats["largest_shard_terms"]) if sharded else (1, stats["total_terms"])
    lines = [f"Indexed {docs.count()} documents", f"Indexed {stats['total_terms']} terms", f"Shards {shards} (largest {largest} terms)"]
    if 0 < max_shard_terms < largest:
        lines.append(f"Warning: the largest shard has more than {max_shard_terms} terms (--maxShardTerms)")
    return lines
