"""Counting rows of re-delivered samples, and the blocks they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_KEY = ["video_id", "sample_index"]


def counting_rows(samples: DataFrame, keep: list[str] | None = None, arrived: str | None = None) -> DataFrame:
    """One row per (video_id, sample_index): the delivery with the latest ingested_at.

    A partial aggregate runs before the shuffle, so a sample delivered very often never meets in
    one task in full. Rows without a key are dropped, a null ingested_at loses against any time,
    ties fall to the greatest remaining fields, so the result does not depend on row order. The
    delivery's time comes out under the name arrived, if one is given.
    """
    keep = keep or [c for c in samples.columns if c not in (*SAMPLE_KEY, "ingested_at")]
    rank = F.struct(F.col("ingested_at"), *[F.col(c) for c in keep])
    best = samples.where(F.col("video_id").isNotNull() & F.col("sample_index").isNotNull())
    best = best.groupBy(*SAMPLE_KEY).agg(F.max(rank).alias("__best"))
    time = [F.col("__best")["ingested_at"].alias(arrived)] if arrived else []
    return best.select(*SAMPLE_KEY, *time, *[F.col("__best")[c].alias(c) for c in keep])


def block_key(video_id: Column, block_id: Column) -> Column:
    return F.concat(F.lit("b:"), video_id.cast("string"), F.lit(":"), block_id)


def counting_blocks(samples: DataFrame, *fields: str) -> DataFrame:
    """Blocks of the counting rows: video_id, sample_index, block_id and the named block fields."""
    slim = samples.select(
        *SAMPLE_KEY,
        "ingested_at",
        F.transform(
            F.col("blocks"),
            lambda b: F.struct(b["id"].alias("block_id"), *[b[f].alias(f) for f in fields]),
        ).alias("blocks"),
    )
    rows = counting_rows(slim, ["blocks"])
    return rows.select(*SAMPLE_KEY, F.explode("blocks").alias("b")).select(*SAMPLE_KEY, "b.*")


def region_of(bbox: Column) -> Column:
    """top, middle or bottom by the middle of the box; null where the box is."""
    mid = (bbox["y0"] + bbox["y1"]) / 2
    return F.when(mid < F.lit(1) / 3, "top").when(mid > F.lit(2) / 3, "bottom").when(mid.isNotNull(), "middle")
