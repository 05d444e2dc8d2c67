"""The queries of this subpackage: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import escape_html, normalize_ws
from quarrymill.llm import boilerplate, containers, leaks, neardup, repeated, residue, severity, terms, tokens
from quarrymill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.found(table(spark, d, "indexable_documents"), table(spark, d, "extracted_documents"))


def p1_articles(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.articles(boilerplate.page_rows(table(spark, d, "indexable_documents"), "indexable_documents", "id", "body_text")).select("id", "article").distinct()


def p1_markup(spark: SparkSession, d: str) -> DataFrame:
    """Bodies as paragraphs of markup, between a menu, a notice and a footer of their site."""
    docs = table(spark, d, "indexable_documents").where("body_text is not null and site is not null").select("id", "site", "title", "body_text").distinct()
    title, body, site = (escape_html(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "body_text", "site"))
    parts = [
        F.lit('<body><div class="top"><ul><li><a href="/">Home</a><li><a href="/docs/">Docs of '), site, F.lit('</a></ul></div><div class="notice">We use cookies on '), site, F.lit('.</div><div class="wrap"><div class="post post-'), F.col("id").cast("string"), F.lit('"><h1>'), title, F.lit("</h1><p>"), body,
        F.lit('</p></div><div class="side"><h3>Related</h3><ul><li><a href="/a/">Another page</a></ul></div></div><footer class="foot">© '), site, F.lit("</footer></body>"),
    ]
    return containers.markup_articles(docs.select("id", "site", F.concat(*parts).alias("html"))).select("id", normalize_ws(F.col("article")).alias("article"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.found(table(spark, d, "postings"))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "postings"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated.found(spark, d, table)


def p3_clean_bodies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "indexable_documents").select("id", "site", "body_text")
    return repeated.without_lines(docs.dropDuplicates(["id"]), repeated.repeated_lines(docs)).select("id", "clean_text")


def p3_clean_excerpts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "search_documents").select("id", "site", "excerpt")
    return repeated.without_lines(docs.dropDuplicates(["id"]), repeated.repeated_lines(docs, text_col="excerpt"), text_col="excerpt").select("id", "clean_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "indexable_documents"), table(spark, d, "extracted_documents"))


def p4_kept_bodies(spark: SparkSession, d: str) -> DataFrame:
    bodies = table(spark, d, "indexable_documents")
    model = residue.fit(bodies, table(spark, d, "extracted_documents"))
    return residue.without_residue(bodies, residue.residue_bodies(bodies, model), "id").select("id", "site", "body_text").distinct()


def p4_kept_titles(spark: SparkSession, d: str) -> DataFrame:
    extracted = table(spark, d, "extracted_documents")
    model = residue.fit(table(spark, d, "indexable_documents"), extracted)
    return residue.without_residue(extracted, residue.residue_titles(extracted, model), "extract_id").select("extract_id", "site", "title").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "indexable_documents"), table(spark, d, "search_documents"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.page_groups(table(spark, d, "indexable_documents"), table(spark, d, "search_documents"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_words(spark: SparkSession, d: str) -> DataFrame:
    return tokens.word_table(table(spark, d, "documents")).select("word", "n", "ids")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    hits = leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.groupBy("item_id").agg(F.count("*").alias("documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return severity.found(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return severity.severities(documents, severity.fit(documents, table(spark, d, "review_labels"))).select("doc_id", "source", "severity", "harmful")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return severity.rates(table(spark, d, "documents"), table(spark, d, "review_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_articles, p1_markup, p2_found, p2_terms, p3_found, p3_clean_bodies, p3_clean_excerpts, p4_found, p4_kept_bodies, p4_kept_titles, p5_found, p5_groups, p7_ids, p7_words, p7_decoded, p8_found, p8_leaks, p8_items, p9_found, p9_scores, p9_rates)}
