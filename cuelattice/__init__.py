"""Spark-first engine for timed on-screen text: sampling grids, event tracking, cues, subtitles."""

__version__ = "0.1.0"
