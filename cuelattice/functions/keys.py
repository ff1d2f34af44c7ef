"""Keys of lines, requests and cached results."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.config import PROMPT_VERSION, stable_hash

# Fields of a request that change from run to run or do not bear on the answer.
VOLATILE = ("stream", "stream_options", "request_id", "id", "metadata", "user")


def canonical_key(lines: Column) -> Column:
    """The JSON array of the lines in order, ', ' between them."""
    quoted = F.transform(lines, lambda x: F.substring(F.to_json(F.array(x)), 2, 1 << 30))
    bare = F.transform(quoted, lambda x: F.left(x, F.length(x) - 1))
    return F.concat(F.lit("["), F.array_join(bare, ", "), F.lit("]"))


def image_key(sha256: Column, params: dict) -> Column:
    """Key of a recognition result: the image's hash and that of the parameters."""
    return F.concat_ws(":", sha256, F.lit(stable_hash(params)))


def request_key(body: dict) -> str:
    """Key of a chat request without its volatile fields."""
    return stable_hash({k: v for k, v in body.items() if k not in VOLATILE})


def request_keys(request: Column) -> Column:
    """request_key of JSON requests; null where the text is no JSON object."""

    @F.pandas_udf(T.StringType())
    def key(series: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                body = json.loads(text) if text else None
            except ValueError:
                return None
            return request_key(body) if isinstance(body, dict) else None

        return series.map(one)

    return key(request)


def messages(lines: list[str], source_lang: str | None, target_lang: str) -> list[dict]:
    """Messages of a translation request; nothing in them changes from run to run."""
    ask = (
        f"{PROMPT_VERSION}. Translate from {source_lang or 'auto'} into {target_lang}. Answer with a JSON array of as many strings as given, "
        "each the translation of the string in the same place, and with nothing else."
    )
    return [{"role": "system", "content": ask}, {"role": "user", "content": json.dumps(lines, ensure_ascii=False)}]


def request_preview(request: Column, limit: int = 30) -> Column:
    """The start of the last user message, blanks squeezed."""
    parsed = F.from_json(F.get_json_object(request, "$.messages"), "array<struct<role:string,content:string>>")
    users = F.filter(parsed, lambda m: m["role"] == "user")
    text = F.trim(F.regexp_replace(F.coalesce(F.try_element_at(users, F.lit(-1))["content"], F.lit("")), r"\s+", " "))
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)
