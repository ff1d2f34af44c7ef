"""Counters and ratios of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recognition_counters(results: DataFrame) -> DataFrame:
    """results: video_id, status, blocks -> a row a video: n_samples, n_failed, n_no_text, n_blocks."""
    blocks = F.coalesce(F.size("blocks"), F.lit(0))
    ok = F.coalesce(F.col("status") != "failed", F.lit(True))
    return results.groupBy("video_id").agg(
        F.count("*").alias("n_samples"), F.count_if(~ok).alias("n_failed"), F.count_if(ok & (blocks == 0)).alias("n_no_text"), F.sum(F.greatest(blocks, F.lit(0))).cast("bigint").alias("n_blocks")
    )


def hit_ratio(looked_up: DataFrame) -> DataFrame:
    """hits, misses and hit_rate (null without lookups) of rows with hit."""
    counted = looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return counted.withColumn("hit_rate", F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")))


def reduction(samples: DataFrame, facts: DataFrame) -> DataFrame:
    """Samples taken of each video as a share of its frames; null where no duration or rate is known."""
    taken = samples.groupBy("video_id").agg(F.count("*").alias("n_samples"))
    joined = facts.join(taken, "video_id", "left")
    n = F.coalesce("n_samples", F.lit(0))
    return joined.select("video_id", n.alias("n_samples"), F.try_divide(n, F.nullif(F.col("duration") * F.col("fps"), F.lit(0.0))).alias("share"))


def outcomes(results: DataFrame) -> DataFrame:
    """How many results each status has."""
    return results.groupBy("status").agg(F.count("*").alias("n"))
