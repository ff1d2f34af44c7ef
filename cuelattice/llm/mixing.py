"""Problem 7: documents of several sources mixed to target shares of the total size.

The total is the largest at which every source with documents reaches its share without any
document being used more than max_repeats times; shares of targets without documents go to the
others in proportion. Each document then has a fractional number of copies. Pivotal rounding makes
it whole: two fractional documents exchange mass, weighed by their sizes so that the source's
total stays the same, until one of them is whole; which way is drawn with the probabilities that
keep every document's expectation. Documents meet in leaves of bounded size, each leaf leaves one
fractional document at most, and leftovers meet in the next level of a tree of fan-in FAN, so no
task ever holds a source. All draws come from hashes of identifiers: results repeat.

Defined results: null texts count as empty; documents without tokens are used the rounded number
of times of their own draw; sources without a target are left out; a target without documents is
reported with nothing reached; a null max_repeats counts as 1, a null or negative share as 0.
"""

from __future__ import annotations

import base64
import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.session import cut_lineage, spread

#: The setting that names a public tokenizer's ranks, their place unless it is set, and the pattern that splits text before its merges.
TOKENIZER_SETTING = "spark.cuelattice.tokenizer"
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, FAN = 4096, 64
SEED = 7
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """Loaded once per Python worker."""
    if path not in _encodings:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[path] = tiktoken.Encoding("shared", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def shipped(spark: SparkSession, path: str | None) -> str:
    """Name under which every executor gets the tokenizer's file from the driver."""
    found = path or spark.conf.get(TOKENIZER_SETTING, None) or TOKENIZER
    spark.sparkContext.addFile(found)
    return os.path.basename(found)


def token_count(text: Column, name: str) -> Column:
    """name: what shipped returns."""

    @F.arrow_udf(T.LongType())
    def count(arr: pa.Array) -> pa.Array:
        made = encoding(SparkFiles.get(name))
        return pa.array([len(made.encode_ordinary(x)) if x else 0 for x in arr.to_pylist()], pa.int64())

    return count(text)


def sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of every document; a repeated doc_id counts once, a null one not at all."""
    name = shipped(documents.sparkSession, path)
    sized = spread(documents.select("doc_id", "source", "text").where(F.col("doc_id").isNotNull())).select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("source", token_count(F.col("text"), name).alias("n_tokens")).alias("d"))
    return sized.groupBy("doc_id").agg(F.max("d").alias("d")).select("doc_id", "d.source", "d.n_tokens")


def wanted(targets: DataFrame) -> DataFrame:
    """A row a target: source, target_share, max_repeats."""
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    return targets.groupBy("source").agg(F.max(share).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))


def quotas(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """Per target: n_docs, tokens, and copies, the mean number of times a document is used; targets are few."""
    have = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    rows = [r.asDict() for r in wanted(targets).join(have, "source", "left").na.fill(0, ["n_docs", "tokens"]).collect()]
    usable = [r for r in rows if r["tokens"] > 0 and r["target_share"] > 0]
    total = sum(r["target_share"] for r in usable)
    budget = min((r["max_repeats"] * r["tokens"] * total / r["target_share"] for r in usable), default=0.0)
    for r in rows:
        r["copies"] = min(r["target_share"] / total * budget / r["tokens"], float(r["max_repeats"])) if r in usable else 0.0
    return rows


def draw(*key: object) -> float:
    """A number in [0, 1) that depends on the key only."""
    return int.from_bytes(hashlib.blake2b(repr((SEED, *key)).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivot(keys: list, mass: list[float], size: list[int], salt: object) -> tuple[dict, tuple | None]:
    """Round masses in (0, 1) in turn; what each key is rounded to, and the one left fractional."""
    whole: dict = {}
    held: tuple | None = None
    for key, p, a in zip(keys, mass, size):
        if a <= 0:
            whole[key] = int(draw("empty", key) < p)
            continue
        if p <= 1e-12 or p >= 1 - 1e-12:
            whole[key] = int(p > 0.5)
            continue
        if held is None:
            held = (key, p, a)
            continue
        other, q, b = held
        up = min(a * (1 - p), b * q)  # tokens moved from the held one to this one, at most
        down = min(a * p, b * (1 - q))
        moved = up if draw(salt, other, key) * (up + down) < down else -down
        p, q = p + moved / a, q - moved / b
        left = [(k, x, s) for k, x, s in ((other, q, b), (key, p, a)) if 1e-9 < x < 1 - 1e-9]
        for k, x in ((other, q), (key, p)):
            if not any(k == y[0] for y in left):
                whole[k] = int(x > 0.5)
        held = left[0] if left else None
        if len(left) > 1:  # only by rounding errors of floats: settle the nearer one
            near = min(left, key=lambda y: min(y[1], 1 - y[1]))
            whole[near[0]] = int(near[1] > 0.5)
            held = left[0] if left[1] is near else left[1]
    return whole, held


ROW = "source string, node long, doc_id long, n_tokens long, mass double, extra int"


def round_node(level: int, last: bool):
    """Arrow function of a group (source, node): every row with its extra copy, null for the one passed up."""

    def run(table: pa.Table) -> pa.Table:
        ids, mass, tokens = (table.column(c).to_numpy() for c in ("doc_id", "mass", "n_tokens"))
        node, source = int(table.column("node")[0].as_py()), table.column("source")[0].as_py()
        order = sorted(range(len(ids)), key=lambda i: (draw("order", int(ids[i])), int(ids[i])))
        whole, held = pivot([int(ids[i]) for i in order], [float(mass[i]) for i in order], [int(tokens[i]) for i in order], (level, source, node))
        if held is not None and last:
            whole[held[0]], held = int(draw("last", held[0]) < held[1]), None
        left = {held[0]: held[1]} if held is not None else {}
        extra = [whole.get(int(i)) for i in ids]
        return pa.table({
            "source": table.column("source"), "node": pa.array(np.full(len(ids), node // FAN), pa.int64()), "doc_id": table.column("doc_id"), "n_tokens": table.column("n_tokens"),
            "mass": pa.array([left.get(int(i), float(m)) for i, m in zip(ids, mass)], pa.float64()), "extra": pa.array(extra, pa.int32()),
        })

    return run


def copies(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """Every document of a targeted source: doc_id, source, n_tokens, copies."""
    sized = cut_lineage(sizes(documents, path))
    plan = quotas(sized, targets)
    spark = documents.sparkSession
    rows = [(r["source"], int(math.floor(r["copies"] + 1e-12)), max(0.0, r["copies"] - math.floor(r["copies"] + 1e-12)), max(1, -(-r["n_docs"] // LEAF))) for r in plan if r["n_docs"]]
    facts = spark.createDataFrame(rows, "source string, base int, mass double, leaves long")
    leaf = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.col("leaves"))
    joined = sized.join(facts, "source").withColumn("node", leaf)
    level = joined.where(F.col("mass") > 0).select("source", "node", "doc_id", "n_tokens", "mass", F.lit(None).cast("int").alias("extra"))
    width, depth, settled = max([r[3] for r in rows], default=1), 0, None
    while True:
        last = width <= 1
        made = cut_lineage(level.groupBy("source", "node").applyInArrow(round_node(depth, last), ROW))
        done = made.where(F.col("extra").isNotNull()).select("doc_id", "extra")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        level, width, depth = made.where(F.col("extra").isNull()), -(-width // FAN), depth + 1
    whole = joined.join(settled, "doc_id", "left")
    return whole.select("doc_id", "source", "n_tokens", (F.col("base") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies"))


def shares(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """Per target: documents, tokens, how much of the mix comes from it, and the most copies of a document."""
    used = copies(documents, targets, path).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"),
        F.max("copies").alias("most_copies"), F.count_if(F.col("copies") > 0).alias("docs_used"),
    )
    counts = ["n_docs", "tokens", "tokens_used", "most_copies", "docs_used"]
    rows = wanted(targets).join(used, "source", "left").na.fill(0, counts)
    # targets are few, so their total is a window over all of them
    share = F.coalesce(F.try_divide(F.col("tokens_used"), F.sum("tokens_used").over(W.partitionBy(F.lit(0)))), F.lit(0.0))
    return rows.select("source", "target_share", "max_repeats", *counts, share.alias("share"))
