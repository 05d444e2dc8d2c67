"""An extension: a growing folder of documents kept indexed as it grows.

A full build reads everything again; this appends the postings of new
documents in micro-batches.  Documents must not come twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarrymill.operators.indexer import build_postings, stored_docs
from quarrymill.operators.shards import build_shards


def append_index(docs: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that appends a stream of documents (id, url, title,
    headings, excerpt, body_text) to the Parquet index in ``folder``.  Each
    batch writes its own subfolder, replaced if the batch is run again after a
    failure, so that every document is indexed once."""

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        stored_docs(batch).write.mode("overwrite").parquet(f"{folder}/docs/batch={n}")
        sharded = build_shards(build_postings(batch)).hint("rebalance", "shard").sortWithinPartitions("shard", "term", "doc_id")
        sharded.write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/postings/batch={n}")
        batch.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
