"""Subtitle text: SRT blocks and ASS dialogues, one row each, and whole files, one row a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.config import Settings
from cuelattice.functions.timefmt import ALIGNMENT, WHITE, ass_color, ass_escape, ass_time, scaled, srt_time
from cuelattice.operators.ordinals import numbered, time_bucket

# The sections of the ASS format.
INFO = "[Script Info]\nTitle: subtitles\nScriptType: v4.00+\nWrapStyle: 0\nScaledBorderAndShadow: yes\nYCbCr Matrix: None\n"
STYLES = (
    "[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, "
    "StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
)
EVENTS = "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
STYLE = "Style: %s,Arial,%d,%s,&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,%d,1,%d,%d,%d,%d,1"
ORDER = ["start_s", "end_s", "event_no"]


def display_lines(translated: Column, source: Column, bilingual: bool = False) -> Column:
    """Translated lines with source lines where they are blank; all source lines where there is no translation; both if bilingual."""
    none = F.array().cast("array<string>")
    told, said = F.coalesce(translated, none), F.coalesce(source, none)
    filled = F.transform(told, lambda t, i: F.coalesce(F.nullif(t, F.lit("")), F.get(said, i), F.lit("")))
    shown = F.when(F.size(told) > 0, filled).otherwise(said)
    return F.concat(shown, said) if bilingual else shown


def shown_events(events: DataFrame, bilingual: bool = False) -> DataFrame:
    """Events that show something, with their lines."""
    lines = F.filter(display_lines(F.col("translated_lines"), F.col("source_lines"), bilingual), lambda x: x != "")
    return events.withColumn("lines", lines).where(F.size("lines") > 0)


def srt_blocks(events: DataFrame, bilingual: bool = False) -> DataFrame:
    """video_id, n, block: numbered blocks, counted over those that show something."""
    rows = numbered(shown_events(events, bilingual), "n", "video_id", time_bucket("start_s"), ORDER)
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start_s")), F.lit(" --> "), srt_time(F.col("end_s")), F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n"))
    return rows.select("video_id", "n", block.alias("block"))


def srt_lines(events: DataFrame, bilingual: bool = False) -> DataFrame:
    """video_id, n, part, line: what a file holds, in pieces that follow each other by n and part."""
    return srt_blocks(events, bilingual).select("video_id", "n", F.lit(0).alias("part"), F.concat("block", F.lit("\n")).alias("line"))


def srt_documents(events: DataFrame, bilingual: bool = False) -> DataFrame:
    """video_id, document: a file a video; a video that shows nothing has none. For videos whose text fits one value."""
    listed = F.sort_array(F.collect_list(F.struct("n", "block")))
    return srt_blocks(events, bilingual).groupBy("video_id").agg(F.concat(F.array_join(listed["block"], "\n"), F.lit("\n")).alias("document"))


def chunked(lines: Column, size: int) -> Column:
    """Lines in lists of at most size; one list for a size that is not positive."""
    if size <= 0:
        return F.array(lines)
    count = F.ceil(F.size(lines) / F.lit(size)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(lines, i * size + 1, F.lit(size)))


def ass_dialogues(events: DataFrame, bilingual: bool = False, max_lines: int = 2) -> DataFrame:
    """video_id, n, part, dialogue: an event of more than max_lines lines as several at the same time."""
    shown = numbered(shown_events(events, bilingual), "n", "video_id", time_bucket("start_s"), ORDER)
    parts = shown.select("*", F.posexplode(chunked(F.col("lines"), max_lines)).alias("part", "group"))
    style = F.when(F.col("source") == "audio", "Audio").otherwise("Default")
    text = F.concat(
        F.lit("Dialogue: 0,"), ass_time(F.col("start_s")), F.lit(","), ass_time(F.col("end_s")), F.lit(","), style, F.lit(",,0,0,0,,"), ass_escape(F.array_join("group", "\n"))
    )
    return parts.select("video_id", "n", "part", text.alias("dialogue"))


def ass_headers(videos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """videos: video_id, width, height, has_speech (some event is spoken) -> video_id, header."""
    w = F.when(F.coalesce("width", F.lit(0)) == 0, 1920).otherwise(F.col("width"))
    h = F.when(F.coalesce("height", F.lit(0)) == 0, 1080).otherwise(F.col("height"))

    def style(name: str, position: str, color: str) -> Column:
        side, edge = scaled(w, 0.03, 10), scaled(h, 0.04, 10)
        return F.format_string(STYLE, F.lit(name), scaled(h, 0.05, 20), F.lit(color), scaled(h, 0.002, 1), F.lit(ALIGNMENT.get(position, 2)), side, side, edge)

    default = style("Default", settings.subtitle_position, WHITE)
    spoken = style("Audio", settings.audio_subtitle_position, ass_color(settings.audio_subtitle_color))
    styles = F.when(F.col("has_speech"), F.concat(default, F.lit("\n"), spoken)).otherwise(default)
    header = F.concat(F.lit(INFO), F.lit("PlayResX: "), w.cast("string"), F.lit("\nPlayResY: "), h.cast("string"), F.lit("\n\n" + STYLES), styles, F.lit("\n\n" + EVENTS))
    return videos.select("video_id", header.alias("header"))


def _headers(events: DataFrame, videos: DataFrame, settings: Settings) -> DataFrame:
    """video_id, header of every video that has events."""
    speech = events.groupBy("video_id").agg(F.coalesce(F.bool_or(F.col("source") == "audio"), F.lit(False)).alias("has_speech"))
    sizes = videos.groupBy("video_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return ass_headers(speech.join(sizes, "video_id", "left"), settings)


def ass_lines(events: DataFrame, videos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """video_id, n, part, line: what a file holds, the header as number 0."""
    heads = _headers(events, videos, settings).select("video_id", F.lit(0).alias("n"), F.lit(0).alias("part"), F.col("header").alias("line"))
    lines = ass_dialogues(events, settings.bilingual, settings.max_lines)
    return heads.unionByName(lines.select("video_id", "n", "part", F.concat("dialogue", F.lit("\n")).alias("line")))


def ass_documents(events: DataFrame, videos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """video_id, document for every video that has events; for videos whose text fits one value."""
    lines = ass_dialogues(events, settings.bilingual, settings.max_lines).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("n", "part", "dialogue"))).alias("d"))
    joined = _headers(events, videos, settings).join(lines, "video_id", "left")
    body = F.coalesce(F.concat(F.array_join(F.col("d")["dialogue"], "\n"), F.lit("\n")), F.lit(""))
    return joined.select("video_id", F.concat("header", body).alias("document"))
