"""Queries over an index: prune shards, look up postings, score, rank."""

from __future__ import annotations

import threading
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.constants import MAX_SHARD_CACHE, MULTI_MATCH_BONUS, QUERY_LIMIT, QUERY_MAX_TOKENS
from quarrymill.functions.text import highlight, query_tokens, tokenize_query
from quarrymill.operators.shards import resolve_shard_path, shard_key, shard_key_of

#: Queries of a batch up to which their tokens are sent to the executors; beyond, tokens and postings meet by shuffle.
SENT_QUERIES = 50_000

RESULT = "rank int, url string, title string, excerpt string, score bigint"


def _ranked_order():
    title = F.collate(F.coalesce(F.col("title"), F.lit("")), "UNICODE")
    return [F.desc("score"), title.asc(), F.asc("first_pos"), F.asc("doc_id")]


def score_matches(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, first_pos) of matches (keys, weight, pos): summed weights
    and a bonus for every match after the first."""
    scored = matches.groupBy(*keys).agg(F.sum("weight").alias("__sum"), F.count("*").alias("__n"), F.min("pos").alias("first_pos"))
    bonus = F.greatest(F.lit(0), F.col("__n") - 1) * MULTI_MATCH_BONUS
    return scored.select(*keys, (F.col("__sum") + bonus).cast("bigint").alias("score"), "first_pos")


class Engine:
    """An opened index.

    ``docs``: (id, url, title, headings, excerpt); of ids that repeat one row
    is used.  ``postings``: (term, doc_id, weight) with ``shard`` where the
    index has shards.  ``sharding``: the catalog of shards, or None for an
    index without; terms of shards that it lacks are looked for in its fallback.

    At most ``max_shard_cache`` shards stay in the executors' storage, those
    used last (0: none); an index without shards is one.  With ``keep`` every
    query keeps the shards that it reads, else only ``prewarm`` does.  A query
    of more shards than fit reads them where they lie, so results never depend
    on the cache.
    """

    def __init__(self, docs: DataFrame, postings: DataFrame, sharding: dict | None = None, max_shard_cache: int = MAX_SHARD_CACHE, keep: bool = False):
        if max_shard_cache < 0:
            raise ValueError(f"a limit can't be negative: {max_shard_cache}")
        self.docs = docs.select(F.col("id").alias("doc_id"), "url", "title", "excerpt").dropDuplicates(["doc_id"])
        self.postings, self.sharding, self.max_shard_cache, self.keep = postings, sharding, max_shard_cache, keep
        self._warm: OrderedDict[str | None, DataFrame] = OrderedDict()
        self._lock = threading.Lock()  # queries at the same time read a shard once

    def _cached(self, shards: list[str | None], load: bool) -> list[DataFrame] | None:
        """The kept frames of the shards, loaded where that is asked for; None if some aren't kept."""
        if len(shards) > self.max_shard_cache or not shards:
            return None
        with self._lock:
            if not load and not set(shards) <= set(self._warm):
                return None
            for s in shards:
                if s not in self._warm:
                    part = self.postings if s is None else self.postings.where(F.col("shard") == s)
                    self._warm[s] = part.persist()
                    part.count()
                self._warm.move_to_end(s)
            frames = [self._warm[s] for s in shards]
            while len(self._warm) > self.max_shard_cache:
                self._warm.popitem(last=False)[1].unpersist()
            return frames

    def _shards(self, tokens: list[str]) -> set[str]:
        """Keys of the shards that hold the tokens; those of the fallback for others."""
        s = self.sharding
        fallback = s["fallbackShard"]
        paths = {t: resolve_shard_path(t, s) for t in tokens}
        keys = {t: shard_key_of(t, s["shardPrefixLen"], fallback) for t in tokens}
        return {keys[t] if keys[t] in s["map"] else fallback for t in tokens if paths[t] is not None}

    def _lookup(self, tokens: list[str]) -> DataFrame:
        """Postings of the tokens: both predicates reach the scan, the shard's as a partition filter."""
        wanted = F.col("term").isin(tokens)
        shards = [None] if self.sharding is None else sorted(self._shards(tokens))
        if parts := self._cached(shards, self.keep):
            found = parts[0]
            for p in parts[1:]:
                found = found.unionByName(p)
            return found.where(wanted)
        return self.postings.where(wanted if self.sharding is None else F.col("shard").isin(shards) & wanted)

    def query(self, text: str | list[str], limit: int = QUERY_LIMIT, highlight_matches: bool = False, max_tokens: int = QUERY_MAX_TOKENS) -> DataFrame:
        """(rank, url, title, excerpt, score), best first.

        Ties go by title (collated), by the first matching token, by doc id.
        Documents are limited before those without a stored row are dropped,
        so orphan postings use up places.  ``limit`` 0 gives no rows,
        ``max_tokens`` 0 sets no bound; negative values raise ValueError.
        """
        if limit < 0:
            raise ValueError(f"a limit can't be negative: {limit}")
        spark, tokens = self.postings.sparkSession, query_tokens(text, max_tokens)
        if not tokens or not limit:
            return spark.createDataFrame([], RESULT)
        place = F.array_position(F.array(*map(F.lit, tokens)), F.col("term"))
        scored = score_matches(self._lookup(tokens).select("doc_id", "weight", place.alias("pos")), ["doc_id"])
        # only rows that can be among the best meet the documents; the tie's titles decide the rest
        least = scored.orderBy(F.desc("score")).limit(limit).agg(F.min("score").alias("least"))
        least = least.first()["least"]
        if least is None:
            return spark.createDataFrame([], RESULT)
        top = scored.where(F.col("score") >= least).join(self.docs.withColumn("matched", F.lit(True)), "doc_id", "left")
        top = top.orderBy(*_ranked_order()).limit(limit)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*_ranked_order()))).where("matched")  # at most ``limit`` rows
        shown = highlight(F.col("excerpt"), F.array(*map(F.lit, tokens))) if highlight_matches else F.col("excerpt")
        return ranked.select("rank", "url", "title", shown.alias("excerpt"), "score").orderBy("rank")

    def batch_query(self, queries: DataFrame, limit: int = QUERY_LIMIT, highlight_matches: bool = False, max_tokens: int = QUERY_MAX_TOKENS, sent_queries: int = SENT_QUERIES) -> DataFrame:
        """(query_id, rank, url, title, excerpt, score) of many queries
        (query_id, text), each as ``query``.  Queries with a null id or without
        tokens give no rows."""
        if limit < 0:
            raise ValueError(f"a limit can't be negative: {limit}")
        q = queries.where("query_id is not null").select("query_id", tokenize_query(F.col("text"), max_tokens).alias("tokens"))
        terms = q.select("query_id", F.posexplode("tokens").alias("pos", "term"))
        on = ["term"]
        if self.sharding is not None:
            s = self.sharding
            key = shard_key(F.col("term"), s["shardPrefixLen"], s["fallbackShard"])
            terms, on = terms.withColumn("shard", F.when(key.isin(sorted(s["map"])), key).otherwise(s["fallbackShard"])), ["shard", "term"]
        side = F.broadcast(terms) if queries.count() <= sent_queries else terms
        scored = score_matches(self.postings.join(side, on).select("query_id", "doc_id", "weight", "pos"), ["query_id", "doc_id"])
        mine = Window.partitionBy("query_id")
        top = scored.withColumn("__r", F.rank().over(mine.orderBy(F.desc("score")))).where(F.col("__r") <= limit)  # a limit per group, before titles are fetched
        top = top.join(self.docs.withColumn("matched", F.lit(True)), "doc_id", "left")
        ranked = top.withColumn("rank", F.row_number().over(mine.orderBy(*_ranked_order()))).where((F.col("rank") <= limit) & F.col("matched"))
        if highlight_matches:
            ranked = ranked.join(q, "query_id").withColumn("excerpt", highlight(F.col("excerpt"), F.col("tokens")))
        return ranked.select("query_id", "rank", "url", "title", "excerpt", "score")

    def prewarm(self, text: str | list[str]) -> None:
        """Keep the postings that a query would read in the executors' storage."""
        if tokens := query_tokens(text):
            self._cached([None] if self.sharding is None else sorted(self._shards(tokens)), True)

    def close(self) -> None:
        for df in self._warm.values():
            df.unpersist()
        self._warm.clear()


_OPEN: dict[tuple, Engine] = {}


def create_search(spark: SparkSession, meta_path: str, reader=None, max_shard_cache: int = MAX_SHARD_CACHE) -> Engine:
    """The engine of the JSON index at ``meta_path``, which keeps what its
    queries parse; opened once per path and options until
    ``clear_search_cache``.  Failed openings aren't kept."""
    from quarrymill.sources.index_files import open_index

    key = (spark.sparkContext.applicationId, meta_path, reader, max_shard_cache)
    if key not in _OPEN:
        _OPEN[key] = Engine(*open_index(spark, meta_path, reader), max_shard_cache, True)
    return _OPEN[key]


def clear_search_cache() -> None:
    for engine in _OPEN.values():
        engine.close()
    _OPEN.clear()
