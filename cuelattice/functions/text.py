"""Text as Column functions: native expressions where they are exact, Arrow functions where Unicode tables are needed."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.functions import similarity as S

#: Every character that counts as blank, line feed included, as a class for Java and RE2 patterns.
BLANK = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
INLINE_BLANK = BLANK.replace(r"\x{09}-\x{0D}", r"\x{09}\x{0B}-\x{0D}")


def is_meaningful(text: Column) -> Column:
    """At least one letter or number of any script."""
    return F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{N}]")


def clean_text(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends; '' for null."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}+", " "))


def tidy_display(text: Column) -> Column:
    """display_text for text that NFKC leaves as it is: line feeds, single blanks, stripped lines."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\r", "\n")
    lines = F.regexp_replace(lines, f"{INLINE_BLANK}+", " ")
    lines = F.regexp_replace(lines, " *\n *", "\n")
    return F.regexp_replace(lines, r"^[ \n]+|[ \n]+$", "")


def _at_once(arr: pa.Array, function: Callable[[str], str]) -> pa.Array:
    """A function that treats each character or cluster by itself, called once for a whole batch of texts; '' for null."""
    texts = arr.fill_null("").to_pylist()
    made = function("\0".join(texts)).split("\0")  # no cluster reaches over a null character
    return pa.array(made if len(made) == len(texts) else [function(t) for t in texts], pa.string())


def nfkc(text: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def normal(arr: pa.Array) -> pa.Array:
        return _at_once(arr, lambda x: unicodedata.normalize("NFKC", x))

    return normal(text)


def display_text(text: Column) -> Column:
    """NFKC, line feeds only, single blanks, no blanks around lines; '' for null."""
    return tidy_display(nfkc(text))


def match_text(text: Column) -> Column:
    """The display text without case and blanks, for comparing only."""

    @F.arrow_udf(T.StringType())
    def folded(arr: pa.Array) -> pa.Array:
        return _at_once(arr, lambda x: unicodedata.normalize("NFKC", x).casefold())

    return F.regexp_replace(folded(display_text(text)), f"{BLANK}+", "")


def similarity(a: Column, b: Column) -> Column:
    """Gestalt similarity of matching forms; not symmetric."""

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([S.similarity(p, q) for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)
