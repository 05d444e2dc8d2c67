"""Shards: postings by the prefix of their term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.constants import FALLBACK_SHARD, MAX_SHARD_TERMS, SHARD_PREFIX_LEN, STRATEGY


def shard_key(term: Column, prefix_len: int = SHARD_PREFIX_LEN, fallback: str = FALLBACK_SHARD) -> Column:
    """The first characters of the lower-cased term; ``fallback`` where it is
    shorter, null, or begins otherwise than with a-z and 0-9."""
    prefix = F.substring(F.lower(term), 1, prefix_len)
    return F.when(prefix.rlike(f"^[a-z0-9]{{{prefix_len}}}\\z"), prefix).otherwise(fallback)


def shard_key_of(term: str, prefix_len: int = SHARD_PREFIX_LEN, fallback: str = FALLBACK_SHARD) -> str:
    """``shard_key`` of one term on the driver."""
    prefix = term.lower()[:prefix_len]
    return prefix if len(prefix) == prefix_len and prefix.isascii() and prefix.isalnum() else fallback


def build_shards(postings: DataFrame, prefix_len: int = SHARD_PREFIX_LEN, fallback: str = FALLBACK_SHARD) -> DataFrame:
    """``postings`` with their shard."""
    return postings.withColumn("shard", shard_key(F.col("term"), prefix_len, fallback))


def shard_terms(sharded: DataFrame) -> DataFrame:
    """(shard, terms): distinct terms per shard."""
    return sharded.select("shard", "term").distinct().groupBy("shard").agg(F.count("*").alias("terms"))


def shard_stats(sharded: DataFrame) -> DataFrame:
    """One row: total_terms, shard_count, largest_shard_terms (0 without any)."""
    totals = (F.coalesce(f, F.lit(0)).cast("bigint") for f in (F.sum("terms"), F.count("*"), F.max("terms")))
    names = ("total_terms", "shard_count", "largest_shard_terms")
    return shard_terms(sharded).agg(*(t.alias(n) for t, n in zip(totals, names, strict=True)))


def oversize_shards(sharded: DataFrame, max_terms: int = MAX_SHARD_TERMS) -> DataFrame:
    """(shard, terms) of shards with more than ``max_terms`` terms; 0 finds none."""
    return shard_terms(sharded).where((F.lit(max_terms) > 0) & (F.col("terms") > max_terms))


def shard_path(shard: Column) -> Column:
    return F.concat(F.lit("inv/"), shard, F.lit(".json"))


def sharding_meta(shards: dict[str, str] | list[str], prefix_len: int = SHARD_PREFIX_LEN, fallback: str = FALLBACK_SHARD) -> dict:
    """The catalog of shards: a map of keys to paths, or keys with the usual paths."""
    paths = shards if isinstance(shards, dict) else {s: f"inv/{s}.json" for s in shards}
    return {"strategy": STRATEGY, "shardPrefixLen": prefix_len, "fallbackShard": fallback, "map": paths}


def resolve_shard_path(token: str, sharding: dict) -> str | None:
    """The path of a token's shard, else of the fallback shard, else None."""
    key = shard_key_of(token, sharding["shardPrefixLen"], sharding["fallbackShard"])
    return sharding["map"].get(key, sharding["map"].get(sharding["fallbackShard"]))


def resolve_shard_paths(tokens: DataFrame, catalog: DataFrame, prefix_len: int = SHARD_PREFIX_LEN, fallback: str = FALLBACK_SHARD) -> DataFrame:
    """``tokens`` (token, ...) with ``path`` from ``catalog`` (shard, path), as ``resolve_shard_path``."""
    other = catalog.where(F.col("shard") == fallback).agg(F.max("path")).first()[0]
    known = catalog.select(F.col("shard").alias("__shard"), F.col("path").alias("__path"))
    joined = tokens.join(known, shard_key(F.col("token"), prefix_len, fallback) == F.col("__shard"), "left")
    return joined.withColumn("path", F.coalesce("__path", F.lit(other))).drop("__shard", "__path")


def resolve_build_paths(tokens: DataFrame, builds: DataFrame, catalog: DataFrame) -> DataFrame:
    """(build_id, token, path): ``tokens`` (site, token) resolved in the catalog
    (build_id, shard, path) of each build of their site, else as that build's
    fallback shard, else null.  ``builds``: (build_id, site, shard_prefix_len,
    fallback_shard).  Tokens of sites without a build are left out."""
    prefix = F.substring(F.lower("token"), F.lit(1), F.col("shard_prefix_len"))
    key = F.when((F.length(prefix) == F.col("shard_prefix_len")) & prefix.rlike(r"^[a-z0-9]+\z"), prefix).otherwise(F.col("fallback_shard"))
    paths = catalog.where("shard is not null").groupBy("build_id", "shard").agg(F.max("path").alias("path"))
    other = paths.select("build_id", F.col("shard").alias("fallback_shard"), F.col("path").alias("__other"))
    known = builds.select("build_id", "site", "shard_prefix_len", "fallback_shard").distinct().join(other, ["build_id", "fallback_shard"], "left")
    # a site may hold most tokens, so that they don't meet their build by a shuffle
    side = F.broadcast(known) if builds.count() <= 200_000 else known
    asked = tokens.where("token is not null").join(side, "site").select("build_id", "token", key.alias("shard"), "__other").distinct()
    return asked.join(paths, ["build_id", "shard"], "left").select("build_id", "token", F.coalesce("path", "__other").alias("path"))
