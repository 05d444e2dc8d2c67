"""Per-key results over skewed keys by multi-level tree aggregation.

A few shards hold most postings.  The work never follows the shard: input
chunks of fixed size are combined where they are read, a page's terms of a
field packed into one text, rows then meet by page (fine keys of bounded
weight) in partitions of a counted size, each chunk of a partition yields one
partial state per shard, and the partial states merge through rounds of
bounded fan-in.  No task ever receives all partials of a hot shard.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.session import stored

#: Rows that one map-side chunk combines at once; bounds a worker's memory.
CHUNK_ROWS = 400_000
#: Input rows of a partition in which pages meet, and the most partitions; beyond, partitions grow, in chunks.
PART_ROWS, MOST_PARTS = 1_000_000, 20_000
#: Partial states that one merge takes together in a round.
FAN_IN = 16


def normal_term(term: Column) -> Column:
    """Lower case, then everything but a-z and 0-9 dropped; null stays null."""
    return F.when(term.rlike(r"^[a-z0-9]*\z"), term).otherwise(F.regexp_replace(F.lower(term), "[^a-z0-9]+", ""))  # most are as they should be


def counted_postings(postings: DataFrame) -> DataFrame:
    """(term, doc_id, field) of the rows that count: term and doc_id not null.
    Other columns of the input, whatever their names, are ignored."""
    p = postings.where(F.col("term").isNotNull() & F.col("doc_id").isNotNull())
    return p.select(normal_term(F.col("term")).alias("term"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("field").cast("string").alias("field"))


def chunks(batches: Iterator, rows: int):
    """Arrow tables of about ``rows`` rows from a stream of record batches."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _combine_by_page(batches: Iterator) -> Iterator:
    """One row per page, field and chunk: its distinct terms, one per line."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for t in chunks(batches, CHUNK_ROWS):
        t = t.group_by(["doc_id", "field", "term"]).aggregate([]).group_by(["doc_id", "field"]).aggregate([("term", "list")])
        lines = pc.binary_join(t["term_list"].combine_chunks().cast(pa.list_(pa.string())), "\n")
        yield from pa.table({"doc_id": t["doc_id"], "field": t["field"], "terms": lines}).combine_chunks().to_batches(max_chunksize=50_000)


def _partial_states(prefix: int):
    """(shard, chunk, postings, pages, terms) of chunks of whole pages."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def states(t: pa.Table, chunk: int):
            lists = pc.split_pattern(t["terms"].combine_chunks(), "\n")
            owner = pc.list_parent_indices(lists)
            flat = pa.table({"doc_id": t["doc_id"].combine_chunks().take(owner), "field": t["field"].combine_chunks().take(owner), "term": lists.flatten()})
            rows = flat.group_by(["doc_id", "field", "term"]).aggregate([])
            rows = rows.append_column("shard", pc.utf8_slice_codeunits(rows["term"], 0, prefix))
            postings = rows.group_by("shard").aggregate([([], "count_all")])
            pages = rows.group_by(["shard", "doc_id"]).aggregate([]).group_by("shard").aggregate([([], "count_all")])
            terms = rows.group_by(["shard", "term"]).aggregate([]).group_by("shard").aggregate([("term", "list")])
            pages, terms = (x.take(pc.index_in(postings["shard"], x["shard"].combine_chunks())) for x in (pages, terms))  # in the same order
            columns = [postings["shard"], pa.array([chunk] * len(postings), pa.int64()), postings["count_all"], pages["count_all"], terms["term_list"]]
            return pa.table(columns, names=["shard", "chunk", "postings", "pages", "terms"]).combine_chunks().to_batches()[0]

        # rows come sorted by page, so a chunk ends only where a page ends
        held, n, chunk, last = [], 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            docs = b["doc_id"]
            if n >= CHUNK_ROWS:
                first = docs[0].as_py()
                cut = 0 if first != last else next((i for i, d in enumerate(docs.to_pylist()) if d != last), b.num_rows)
                if cut < b.num_rows:
                    if cut:
                        held.append(b.slice(0, cut))
                    yield states(pa.Table.from_batches(held), chunk)
                    held, n, chunk, b = [], 0, chunk + 1, b.slice(cut)
            held.append(b)
            n += pc.sum(pc.count_substring(b["terms"], "\n")).as_py() + b.num_rows
            last = b["doc_id"][-1].as_py()
        if held:
            yield states(pa.Table.from_batches(held), chunk)

    return run


def tree_sum(states: DataFrame, keys: list[str], sums: list[str], chunk: str, partials: int, fan_in: int = FAN_IN) -> DataFrame:
    """Sum partial states per key through rounds of fan-in ``fan_in``.

    ``states`` has one row per key and ``chunk`` (0 .. partials-1).  In every
    round at most ``fan_in`` states of a key meet in a group, and after
    ceil(log(partials, fan_in)) rounds one is left, so a key with very many
    partials never sends them all to one reducer."""
    while partials > 1:
        partials = -(-partials // fan_in)
        states = states.withColumn(chunk, F.floor(F.col(chunk) / fan_in)).groupBy(*keys, chunk).agg(*(F.sum(c).alias(c) for c in sums))
    return states.drop(chunk)


def shard_report(postings: DataFrame, prefix: int = 2, fan_in: int = FAN_IN) -> DataFrame:
    """(shard, terms, postings, pages, share) of every shard.

    A posting is a distinct (term, doc_id, field) after ``normal_term``; its
    shard is the first ``prefix`` characters of the term; ``share`` is the
    shard's part of all postings.

    Defined cases: rows with a null term or doc_id don't count; a null field
    is a value of its own; a term without any of a-z0-9 falls into shard '';
    repeated rows count once; an empty table gives no rows; columns beyond
    term, doc_id and field are ignored.
    """
    rows = counted_postings(postings)
    parts = min(MOST_PARTS, -(-postings.count() // PART_ROWS) or 1)
    combined = rows.mapInArrow(_combine_by_page, "doc_id bigint, field string, terms string")
    met = combined.repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    states = met.mapInArrow(_partial_states(prefix), "shard string, chunk bigint, postings bigint, pages bigint, terms array<string>")
    states = stored(states.withColumn("part", F.spark_partition_id()), "shard-states")
    # one row in all: it numbers the chunks and gives the total
    whole = states.agg(F.coalesce(F.max("part"), F.lit(0)).alias("parts"), F.coalesce(F.max("chunk"), F.lit(0)).alias("chunks"), F.sum("postings").alias("postings")).first()
    width = whole["chunks"] + 1
    numbered = states.select("shard", (F.col("part") * width + F.col("chunk")).alias("chunk"), "postings", "pages")
    sums = tree_sum(numbered, ["shard"], ["postings", "pages"], "chunk", (whole["parts"] + 1) * width, fan_in)
    # a term lies in one shard, so distinct terms add up once equal terms have met
    spread = FAN_IN * FAN_IN
    terms = states.select(F.explode("terms").alias("term")).distinct().select(F.substring("term", 1, prefix).alias("shard"), F.pmod(F.xxhash64("term"), F.lit(spread)).alias("chunk"))
    terms = terms.groupBy("shard", "chunk").agg(F.count("*").alias("terms"))
    terms = tree_sum(terms, ["shard"], ["terms"], "chunk", spread, fan_in)
    return sums.join(terms, "shard").select("shard", "terms", "postings", "pages", (F.col("postings") / F.lit(whole["postings"] or 1)).alias("share"))


def hot_shards(postings: DataFrame, share: float = 0.03) -> DataFrame:
    """(shard) of the shards that hold at least ``share`` of all postings."""
    return shard_report(postings).where(F.col("share") >= share).select("shard")
