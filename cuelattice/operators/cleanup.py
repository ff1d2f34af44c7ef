"""Cues and speech made final: translated with fallback, clipped, without repeats, merged in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.functions.keys import canonical_key
from cuelattice.functions.text import clean_text
from cuelattice.operators.compose import round3
from cuelattice.operators.ordinals import numbered, time_bucket


def clip(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """An interval within [0, duration]; only from below where no duration is known."""
    known = duration > 0
    low = F.greatest(F.lit(0.0), start)
    return F.when(known, F.least(low, duration)).otherwise(low), F.when(known, F.least(end, duration)).otherwise(end)


def line_fallback(translated: Column, source: Column) -> Column:
    """Translated lines where there are as many as source lines, and each source line where its translation is blank."""
    usable = F.coalesce(F.size(translated) == F.size(source), F.lit(False))
    return F.when(usable, F.zip_with(translated, source, lambda t, s: F.coalesce(F.nullif(t, F.lit("")), s))).otherwise(source)


def with_duration(events: DataFrame, videos: DataFrame) -> DataFrame:
    return events.join(videos.groupBy("video_id").agg(F.max("duration").alias("duration")), "video_id", "left")


def _once(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by order of each key."""
    ranked = events.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__r = 1").drop("__r")


def finalize_cues(cues: DataFrame, translations: DataFrame, videos: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """cues: video_id, start_s, end_s, source_texts, bboxes; translations: canonical_key, translated_lines (a row a key)."""
    keyed = with_duration(cues, videos).withColumn("canonical_key", canonical_key(F.col("source_texts")))
    joined = keyed.join(translations.select("canonical_key", "translated_lines"), "canonical_key", "left")
    start, end = clip(F.col("start_s"), F.col("end_s"), F.col("duration"))
    timed = joined.withColumn("start_s", start).withColumn("end_s", end).where(F.col("end_s") > F.col("start_s"))
    lines = timed.select(
        "video_id", round3(F.col("start_s")).alias("start_s"), round3(F.col("end_s")).alias("end_s"), F.col("source_texts").alias("source_lines"),
        line_fallback(F.col("translated_lines"), F.col("source_texts")).alias("translated_lines"), "bboxes", F.lit("ocr").alias("source"), *(tie or []),
    )
    return _once(lines, ["video_id", "start_s", "end_s", "source_lines", "translated_lines"], tie or ["bboxes"]).drop(*(tie or []))


def finalize_audio(segments: DataFrame, translations: DataFrame, videos: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """segments: video_id, start_s, end_s, text."""
    spoken = with_duration(segments, videos).withColumn("text", clean_text(F.col("text"))).where(F.col("text") != "")
    keyed = spoken.withColumn("canonical_key", canonical_key(F.array("text")))
    joined = keyed.join(translations.select("canonical_key", "translated_lines"), "canonical_key", "left")
    start, end = clip(F.col("start_s"), F.col("end_s"), F.col("duration"))
    timed = joined.withColumn("start_s", start).withColumn("end_s", end).where(F.col("end_s") > F.col("start_s"))
    single = F.when(F.size("translated_lines") == 1, F.nullif(F.get("translated_lines", F.lit(0)), F.lit("")))
    rows = timed.select("video_id", round3(F.col("start_s")).alias("start_s"), round3(F.col("end_s")).alias("end_s"), "text", F.coalesce(single, F.col("text")).alias("line"), *(tie or []))
    once = _once(rows, ["video_id", "start_s", "end_s", "text"], tie or ["line"])
    return once.select(
        "video_id", "start_s", "end_s", F.array("text").alias("source_lines"), F.array("line").alias("translated_lines"),
        F.array().cast("array<array<double>>").alias("bboxes"), F.lit("audio").alias("source"),
    )


def merge_events(screen: DataFrame, audio: DataFrame) -> DataFrame:
    """Both streams with the number of each event in its video: by time, screen text before speech."""
    both = screen.unionByName(audio)
    rank = F.when(F.col("source") == "audio", 1).otherwise(0)
    return numbered(both, "event_no", "video_id", time_bucket("start_s"), ["start_s", "end_s", rank, "source_lines", "translated_lines"])
