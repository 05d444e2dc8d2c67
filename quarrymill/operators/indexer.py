"""Weighted inverted index from documents (id, title, headings, body_text, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.constants import FIELD_WEIGHTS
from quarrymill.functions.text import field_tokens
from quarrymill.session import stored


def assign_ids(docs: DataFrame, by: str = "path", out: str = "id") -> DataFrame:
    """Dense ids from 0 in binary order of ``by``.

    The rows are range-partitioned, sorted and numbered within their parts,
    and stored; then each part's first id follows from the parts' sizes, one
    small row per part.  No task sees all rows."""
    ranged = docs.repartitionByRange(F.col(by)).sortWithinPartitions(by)
    placed = stored(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranged")
    first, total = {}, 0
    for r in placed.groupBy("__part").count().orderBy("__part").collect():
        first[r["__part"]] = total
        total += r["count"]
    if not first:
        return placed.select(F.lit(0).cast("bigint").alias(out), *docs.columns)
    start = F.create_map(*(F.lit(x) for kv in first.items() for x in kv))
    return placed.select((start[F.col("__part")] + F.col("__at")).cast("bigint").alias(out), *[c for c in docs.columns if c != out])


def document_terms(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """(doc_id, term, field, weight): a row per distinct token of each field."""
    fields = field_tokens(F.col("title"), F.col("headings"), F.col("body_text"))
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(FIELD_WEIGHTS[f]).cast("bigint").alias("weight"), t.alias("tokens")) for f, t in fields.items()))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.explode(parts).alias("p"))
    return rows.select("doc_id", F.explode("p.tokens").alias("term"), "p.field", "p.weight")


def build_postings(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """(term, doc_id, weight): the summed field weights of every token of a
    document, computed within its row, so without a shuffle.

    Defined cases: null fields have no tokens; documents without tokens have
    no postings; a document that repeats repeats its postings.
    """
    f = field_tokens(F.col("title"), F.col("headings"), F.col("body_text"))
    few = F.array_union(f["title"], f["headings"])  # bounded by the fields' limits

    def weight(x):
        return sum((F.array_contains(f[k], x).cast("bigint") * w for k, w in FIELD_WEIGHTS.items()), F.lit(0).cast("bigint"))

    heavy = F.transform(few, lambda x: F.struct(x.alias("term"), weight(x).alias("weight")))
    light = F.transform(F.array_except(f["body"], few), lambda x: F.struct(x.alias("term"), F.lit(FIELD_WEIGHTS["body"]).cast("bigint").alias("weight")))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.explode(F.concat(heavy, light)).alias("p"))
    return rows.select("p.term", "doc_id", "p.weight")


def nest_postings(postings: DataFrame) -> DataFrame:
    """(term, postings): each term's [doc_id, weight] pairs by doc_id, as the
    JSON files have them.  A term's list is one value by the format; tables
    for large collections keep the long form."""
    pair = F.struct("doc_id", "weight")
    return postings.groupBy("term").agg(F.transform(F.sort_array(F.collect_list(pair)), lambda p: F.array(p["doc_id"], p["weight"])).alias("postings"))


def stored_docs(docs: DataFrame) -> DataFrame:
    """What results need of a document; the body is dropped."""
    return docs.select(F.col("id").cast("bigint").alias("id"), "url", "title", "headings", "excerpt")


def build_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored docs, postings)."""
    return stored_docs(docs), build_postings(docs)
