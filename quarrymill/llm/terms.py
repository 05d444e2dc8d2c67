"""Frequency of every distinct term, by recursive radix spilling.

Rows are combined in fixed chunks where they are read, partitioned by bits of
the term's hash, and each partition is aggregated out-of-core by DuckDB.  A
bucket of hash bits that holds too many rows is split further: by bits of the
page's hash between tasks (counts of disjoint pages add up, so even one term
that holds a third of all rows is spread), and by more bits of the term's hash
within a task, on the disk that Spark spills to, until each piece fits.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.balanced import CHUNK_ROWS, chunks, counted_postings
from quarrymill.session import scratch_dir

#: Bits of the term's hash in the first split; bounds the table of counts.
BUCKET_BITS = 12
#: Postings of a leaf beyond which its bucket is split further between tasks.
LEAF_ROWS = 4_000_000
#: Postings that DuckDB aggregates at once in a task; more are spilled by hash bits.
TASK_ROWS = 2_000_000
RADIX_BITS, MAX_DEPTH = 4, 6
DUCKDB_MEMORY = "300MB"


def term_bucket(term: Column, bits: int = BUCKET_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(term), 64 - bits).cast("int")


def _combine(slices: dict[int, int]):
    """Distinct pages of each (term, field) of a chunk, by leaf."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = np.ones(1 << BUCKET_BITS, dtype="int64")
        for b, n in slices.items():
            table[b] = n
        for t in chunks(batches, CHUNK_ROWS):
            bucket = t["bucket"].to_numpy()
            if slices:
                mixed = (t["doc_id"].to_numpy().astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                part = (mixed % table[bucket].astype("uint64")).astype("int64")
            else:
                part = np.zeros(len(bucket), dtype="int64")
            t = t.drop_columns("bucket").append_column("leaf", pa.array((bucket.astype("int64") << 32) | part))
            g = t.group_by(["leaf", "term", "field"]).aggregate([("doc_id", "distinct")])
            yield from g.select(["leaf", "term", "field", "doc_id_distinct"]).rename_columns(["leaf", "term", "field", "docs"]).combine_chunks().to_batches(max_chunksize=20_000)

    return run


_COUNT = """
    SELECT term, sum(fields)::BIGINT AS postings, count(*)::BIGINT AS pages
    FROM (SELECT term, doc, count(*) AS fields
          FROM (SELECT DISTINCT term, field, doc FROM (SELECT term, field, unnest(docs) AS doc FROM {rows}))
          GROUP BY term, doc)
    GROUP BY term"""


def _aggregate(task_rows: int):
    def run(batches: Iterator) -> Iterator:
        import duckdb
        import pyarrow as pa
        import pyarrow.compute as pc

        folder = tempfile.mkdtemp(prefix="radix-", dir=scratch_dir())
        con = duckdb.connect(config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False})
        spilled = 0

        def out(query: str):
            return con.sql(query).to_arrow_table().cast(pa.schema([("term", pa.string()), ("postings", pa.int64()), ("pages", pa.int64())])).to_batches(max_chunksize=20_000)

        def spill(rows: str, depth: int, name: str) -> None:
            """Write rows to disk by the next bits of the term's hash."""
            con.execute(f"COPY (SELECT *, ((hash(term) >> {RADIX_BITS * depth}) & {(1 << RADIX_BITS) - 1})::INT AS radix FROM {rows}) TO '{folder}/{name}' (FORMAT parquet, PARTITION_BY (radix), OVERWRITE_OR_IGNORE, FILENAME_PATTERN 'x{{uuid}}')").fetchall()

        def settle(name: str, depth: int):
            import os

            for part in sorted(os.listdir(f"{folder}/{name}")):
                rows = f"read_parquet('{folder}/{name}/{part}/*.parquet', hive_partitioning=false)"
                n = con.sql(f"SELECT coalesce(sum(len(docs)), 0) FROM {rows}").fetchall()[0][0]
                if n > task_rows and depth < MAX_DEPTH:
                    spill(rows, depth, sub := f"{name}_{part[6:]}")
                    yield from settle(sub, depth + 1)
                    shutil.rmtree(f"{folder}/{sub}")
                else:  # small enough, or one term's hash: DuckDB goes out-of-core by itself
                    yield from out(_COUNT.format(rows=rows))

        try:
            held, n = [], 0
            for b in batches:
                if not b.num_rows:
                    continue
                held.append(b)
                n += pc.sum(pc.list_value_length(b["docs"])).as_py() or 0
                if n > task_rows:
                    piece = pa.Table.from_batches(held)
                    con.register("piece", piece)
                    spill("piece", 0, "s")
                    con.unregister("piece")
                    held, n, spilled = [], 0, spilled + 1
            if held:
                piece = pa.Table.from_batches(held)
                con.register("piece", piece)
                if spilled:
                    spill("piece", 0, "s")
                else:
                    yield from out(_COUNT.format(rows="piece"))
                con.unregister("piece")
            if spilled:
                yield from settle("s", 1)
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


def term_frequencies(postings: DataFrame, leaf_rows: int = LEAF_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(term, postings, pages) of every distinct term.

    Terms are lower-cased and reduced to a-z0-9.  ``postings`` counts distinct
    (term, doc_id, field), ``pages`` distinct doc_ids, exactly.

    Defined cases: rows with a null term or doc_id don't count; a null field
    is a value of its own; terms without any of a-z0-9 make the term ''; rows
    delivered again, in whatever spelling, count once; an empty table gives no
    rows; further columns are ignored.
    """
    rows = counted_postings(postings)
    rows = rows.withColumn("bucket", term_bucket(F.col("term")))
    # at most 2**BUCKET_BITS counts, whatever the input
    sizes = rows.groupBy("bucket").count().where(F.col("count") > leaf_rows).collect()
    slices = {r["bucket"]: -(-r["count"] // leaf_rows) for r in sizes}
    combined = rows.mapInArrow(_combine(slices), "leaf bigint, term string, field string, docs array<bigint>")
    partial = combined.repartition("leaf").mapInArrow(_aggregate(task_rows), "term string, postings bigint, pages bigint")
    return partial.groupBy("term").agg(F.sum("postings").alias("postings"), F.sum("pages").alias("pages"))


def marked_terms(postings: DataFrame, rare_below: int = 3, common_above: float = 0.25, **sizes) -> DataFrame:
    """(term, postings, pages, mark): ``rare`` below ``rare_below`` distinct
    pages, ``common`` above ``common_above`` of all distinct pages of the
    counted rows, else null.  A term that is both (a tiny table) is rare."""
    pages = postings.where(F.col("term").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct().count()
    mark = F.when(F.col("pages") < rare_below, "rare").when(F.col("pages") > common_above * pages, "common")
    return term_frequencies(postings, **sizes).withColumn("mark", mark)


def found(postings: DataFrame) -> DataFrame:
    """p2_found: (term, mark) of the marked terms."""
    return marked_terms(postings).where(F.col("mark").isNotNull()).select("term", "mark")
