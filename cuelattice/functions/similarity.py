"""Matching form and gestalt similarity of short texts."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

INLINE_BLANKS = re.compile(r"[^\S\n]+")
BLANKS = re.compile(r"\s+")


def display_text(text: str | None) -> str:
    """NFKC, line feeds only, single blanks, no blanks around lines; '' for null."""
    if not text:
        return ""
    lines = re.split(r"\r\n|\r|\n", unicodedata.normalize("NFKC", text))
    return "\n".join(INLINE_BLANKS.sub(" ", line).strip() for line in lines).strip()


def match_text(text: str | None) -> str:
    """The display text without case and blanks, for comparing only."""
    return BLANKS.sub("", unicodedata.normalize("NFKC", display_text(text)).casefold())


def matched_ratio(a: str, b: str) -> float:
    """Gestalt ratio of two matching forms; not symmetric, so the order of arguments counts."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


def similarity(a: str | None, b: str | None) -> float:
    return matched_ratio(match_text(a), match_text(b))


def at_least(a: str, b: str, threshold: float) -> bool:
    """matched_ratio(a, b) >= threshold, by upper bounds first."""
    if a == b:
        return threshold <= 1.0
    if not a or not b:
        return threshold <= 0.0
    if 2.0 * min(len(a), len(b)) / (len(a) + len(b)) < threshold:
        return False
    matcher = SequenceMatcher(None, a, b)
    return matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold
