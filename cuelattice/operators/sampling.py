"""The grid of samples of a video, and facts of probed streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.functions.parse import fraction, quarter_turns, sample_count
from cuelattice.operators.ordinals import numbered


def sample_grid(videos: DataFrame, interval: float | None = None) -> DataFrame:
    """A row for each planned sample: sample_index from 1, timestamp_s = (index - 1) * interval, at most the duration."""
    step = F.lit(interval) if interval is not None else F.col("sample_interval")
    planned = videos.select("video_id", "duration", step.alias("step"), sample_count(F.col("duration"), step).alias("n")).where("n > 0")
    rows = planned.select("video_id", "duration", "step", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("sample_index"))
    time = F.bround(F.least((F.col("sample_index") - 1) * F.col("step"), F.col("duration")), 3)
    return rows.select("video_id", "sample_index", time.alias("timestamp_s"), F.lit("pending").alias("status"))


def number_frames(frames: DataFrame) -> DataFrame:
    """frames: video_id, path -> sample_index by path; a video's frames are files of one folder."""
    bucket = F.regexp_extract("path", r"^(?:.*/)?.{0,5}", 0)
    return numbered(frames, "sample_index", "video_id", bucket, ["path"])


def display_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """Width and height as shown, exchanged by a quarter turn."""
    turned = quarter_turns(rotation).isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def probe_facts(videos: DataFrame) -> DataFrame:
    """Rotation, shown size, frames a second and planned samples of every video."""
    w, h = display_size(F.col("width"), F.col("height"), F.col("rotation"))
    return videos.select(
        "video_id", quarter_turns(F.col("rotation")).alias("rotation"), w.alias("shown_width"), h.alias("shown_height"),
        fraction(F.col("avg_frame_rate")).alias("fps"), sample_count(F.col("duration"), F.col("sample_interval")).alias("n_samples"),
    )
