"""Work done once for equal inputs: representatives, fan-out, and memo tables before expensive functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def representatives(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A row a key: the least order value's row, and how many rows share the key. Hashes combine before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, order)]
    first = F.min(F.struct(order, *rest))
    return rows.groupBy(key).agg(first.alias("__first"), F.count("*").alias("n_members")).select(key, F.col("__first")[order].alias(order), *[F.col("__first")[c].alias(c) for c in rest], "n_members")


def fan_out(results: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Each member with the result of its key's representative."""
    return members.join(results, key)


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no result yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def look_up(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows with the cached columns and hit, whether their key is cached; the cache has a row a key."""
    marked = cache.withColumn("__hit", F.lit(True))
    return rows.join(marked, key, "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def upsert(cache: DataFrame, new: DataFrame, key: str = "cache_key") -> DataFrame:
    """The cache after new rows: they replace rows of the same key, whose hit_count stays; latest created_at wins."""
    old = cache.withColumn("__new", F.lit(0))
    added = new.withColumn("hit_count", F.lit(0).cast("bigint")).withColumn("__new", F.lit(1)).select(*old.columns)
    both = old.unionByName(added)
    newest = W.partitionBy(key).orderBy(F.desc("__new"), F.desc("created_at"))
    kept = both.withColumn("hit_count", F.max("hit_count").over(W.partitionBy(key))).withColumn("__r", F.row_number().over(newest))
    return kept.where("__r = 1").drop("__r", "__new")


def count_hits(cache: DataFrame, looked_up: DataFrame, key: str = "cache_key") -> DataFrame:
    """The cache with the hits of a run added."""
    hits = looked_up.where("hit").groupBy(key).agg(F.count("*").alias("__hits"))
    return cache.join(hits, key, "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("__hits", F.lit(0))).drop("__hits")


def migrate_keys(cache: DataFrame, old_hash: str, new_hash: str, key: str = "cache_key") -> DataFrame:
    """Keys '<image>:<old hash>' renamed to the new hash; where the new key is there already, the old row goes."""
    if old_hash == new_hash:
        return cache
    suffix = F.substring_index(key, ":", -1)
    renamed = cache.where(suffix == old_hash).withColumn(key, F.concat(F.substring_index(key, ":", 1), F.lit(":" + new_hash)))
    stays = cache.where(suffix != old_hash)
    return stays.unionByName(renamed.join(stays.select(key), key, "left_anti").select(*stays.columns))


def memo_map(rows: DataFrame, key: str, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Results by key, computed for keys that the cache lacks only, each once.

    compute: distinct missing keys -> key and result columns, as the cache has them. Returns the
    rows with their results, and what is new for the cache; write the latter before using both, so
    that an expensive function runs once.
    """
    missing = rows.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")
    new = compute(missing)
    return rows.join(cache.unionByName(new.select(*cache.columns)), key, "left"), new
