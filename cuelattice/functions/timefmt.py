"""Time codes, colours, escapes and scaling of subtitle files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alignments and colours of the ASS format (alpha, blue, green, red).
ALIGNMENT = {"bottom": 2, "top": 8}
WHITE = "&H00FFFFFF"
COLORS = {
    "white": "&H00FFFFFF", "yellow": "&H0000FFFF", "cyan": "&H00FFFF00", "green": "&H0000FF00", "lime": "&H0000FF00",
    "red": "&H000000FF", "orange": "&H000080FF", "magenta": "&H00FF00FF", "pink": "&H00CBC0FF", "black": "&H00000000",
}


def _units(seconds: Column, per_second: int) -> Column:
    """Whole units of a time not before 0, halves to even."""
    return F.rint(F.greatest(seconds, F.lit(0.0)) * per_second).cast("bigint")


def srt_time(seconds: Column) -> Column:
    ms = _units(seconds, 1000)
    hours = F.floor(ms / 3_600_000)
    return F.format_string("%02d:%02d:%02d,%03d", hours, F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def ass_time(seconds: Column) -> Column:
    cs = _units(seconds, 100)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def ass_escape(text: Column) -> Column:
    """Braces would open an override block; line ends are written as \\N."""
    return F.regexp_replace(F.translate(text, "{}", "()"), r"\r\n|\n|\r", r"\\N")


COLOR = re.compile(r"\s*(?:#(?P<r>.{2})(?P<g>.{2})(?P<b>.{2})|&h(?P<own>.*?)|(?P<name>\w+))\s*", re.IGNORECASE | re.DOTALL)


def ass_color(value: str | None) -> str:
    """A colour name, #RRGGBB or &H value as the format writes it; white for anything else."""
    found = COLOR.fullmatch(value or "")
    of = found.groupdict() if found else {}
    if of.get("r"):
        return f"&H00{of['b']}{of['g']}{of['r']}".upper()
    return COLORS.get((of.get("name") or "").lower(), WHITE) if of.get("own") is None else f"&H{of['own'].upper()}"


def scaled(size: Column, share: float, least: int) -> Column:
    """A share of a picture's size in whole pixels, at least so many."""
    return F.greatest(F.lit(least), F.rint(size * share).cast("int"))
