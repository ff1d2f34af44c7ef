"""Problem 8: texts cut off by a field limit or during transfer.

Two sources of evidence meet. Lengths: of every source the hazard of each length, the share of
the texts at least that long that are exactly that long, by window sums over counts of lengths in
characters and in bytes; a hazard is tested against those of the neighbouring lengths, and a
Benjamini-Hochberg step keeps false discoveries among a source's lengths below FDR. Endings: how
far a text ends inside a cue, time line, sentence, quotation or word, by its format; whether a last
word without a mark is whole is read from counts of words and word pairs of the whole corpus.
An ending that is plainly incomplete counts at any length (a transfer may stop anywhere); an ending
that only may be incomplete counts at significant lengths.

Defined results: a null or blank text is never cut; a null source is a source of its own; texts
are read whole; rows with equal doc_id each count.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.llm.plainform import plain_array
from cuelattice.session import cut_lineage, spread

FDR = 0.01
#: Times the neighbouring hazards that a significant one is at least; bytes of some scripts come in twos and threes.
LIFT = 4.0
#: Lengths on either side whose hazards a hazard is tested against.
NEIGHBOURS = 30
#: A source is prose if at least this share of its texts has sentence marks.
PROSE_SHARE = 0.98
#: Occurrences of a word pair, whole or begun, from which it speaks for itself; below, its last word alone does.
PAIR_EVIDENCE = 5
#: How likely a text is cut where its length says nothing, as odds.
ELSEWHERE = 0.02
#: Bits of the cells that asked word beginnings are hashed to, and cells of a block; the same for any collection.
CELL_BITS, CELL_BLOCK = 24, 1 << 15
WHOLE, OPEN, WORD = 0, 1, 2
MARKS = ".!?…。！？"
CLOSERS = "\"'”’»」』)）]】"
SENTENCE = regex.compile(rf"[。！？…]|[.!?](?=[{regex.escape(CLOSERS)}]*(?:\s*$|\s+[\p{{Lu}}\p{{Lo}}\p{{P}}\p{{S}}]))")
ENDED = regex.compile(rf"[{regex.escape(MARKS)}][{regex.escape(CLOSERS)}{regex.escape(MARKS)}]*$")
#: A sign beside the text, such as a page number, after a finished sentence.
SIGN = regex.compile(rf"[{regex.escape(MARKS)}][{regex.escape(CLOSERS)}]*\s+(?:[\p{{P}}\p{{S}}\s]*|[\p{{P}}\p{{S}}\s]*\p{{L}}{{0,3}}[\p{{P}}\s]*\p{{N}}+[\p{{N}}\p{{P}}\p{{S}}\s]*|[(\[（].*[)\]）])$")
QUOTES = (("„", "“”"), ("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"))
TIME_LINE = regex.compile(r"^\d+:\d\d:\d\d[,.]\d{3} --> \d+:\d\d:\d\d[,.]\d{3}\s*$")
WORDS = regex.compile(r"[\p{L}\p{M}\uFFFD]+")  # a replaced character does not end a word
WORDS_BACK = regex.compile(rf"(?r){WORDS.pattern}")
CUE_MARK = regex.compile(rf"\p{{L}}[{regex.escape(MARKS)}][{regex.escape(CLOSERS)}]*\s*(?:\n|$)")
TAGS = regex.compile(r"(?:^|\n)\s*#\S*(?:\s+#\S*)*$")
FORMS = ("srt", "ass", "list")


def prose_state(text: str) -> int:
    """WHOLE or OPEN for text whose sentences have marks."""
    for opener, closers in QUOTES:
        at = text.rfind(opener)
        if at >= 0 and not (opener == "“" and "„" in text) and not any(c in text[at + 1 :] for c in closers):
            return OPEN
    return WHOLE if ENDED.search(text) or SIGN.search(text) else OPEN


def ending_state(text: str, form: str | None) -> tuple[int, bool]:
    """State of the end of a text in plain form without outer blanks, and whether it has sentence marks."""
    if text.endswith("�") and len(text) > 1 and regex.match(r"[\p{L}\p{M}]", text[-2]):
        return OPEN, True
    if form == "list":
        return WORD, True
    if form == "srt":
        block = regex.split(r"\n[ \t]*\n", text)[-1].split("\n")
        if len(block) < 3 or not TIME_LINE.match(block[1]):
            return OPEN, True
        said = "\n".join(block[2:])
        return prose_state(said), bool(CUE_MARK.search(text))
    if form == "ass":
        last = text.split("\n")[-1]
        if last.startswith("Dialogue:") or "Dialogue:".startswith(last):
            parts = last.split(",", 9)
            return (OPEN, True) if len(parts) < 10 or not parts[9].strip() else (prose_state(parts[9]), True)
        return prose_state(last), True
    if text.endswith("#"):
        return OPEN, True
    if TAGS.search(text):
        return WORD, True
    marked = bool(SENTENCE.search(text))
    return prose_state(text), marked


def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, source, doc_format, text -> doc_id, source, n_chars, n_bytes, state, marked, words (the last two)."""
    for batch in batches:
        raw = batch.column("text")
        plain = plain_array(raw.cast(pa.large_string())).to_pylist()
        state, marked, before, last = [], [], [], []
        for given, form in zip(plain, batch.column("doc_format").to_pylist()):
            text = (given or "").strip()
            s, m = ending_state(text, form) if text else (WHOLE, True)
            inside = text and regex.match(r"[\p{L}\p{M}]", text[-1]) and not given[-1].isspace()
            tail = [m.group() for m in islice(WORDS_BACK.finditer(text.lower()), 2)] if inside else []  # the last word first
            state.append(s)
            marked.append(m)
            last.append(tail[0] if tail else None)
            before.append(tail[1] if len(tail) > 1 else "")
        chars = pa.compute.utf8_length(raw).cast(pa.int64())
        size = pa.compute.binary_length(raw).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), chars, size, pa.array(state, pa.int32()), pa.array(marked, pa.bool_()), pa.array(before, pa.string()), pa.array(last, pa.string())],
            names=["doc_id", "source", "n_chars", "n_bytes", "state", "marked", "before", "last"],
        )


def prefix_codes(word: str) -> np.ndarray:
    """Hash of each beginning of a word, the whole word last; those of words of usual length are kept."""
    return _usual_codes(word) if len(word) <= 32 else _prefix_codes(word)


def _prefix_codes(word: str) -> np.ndarray:
    codes, code = [], 0
    for letter in word:
        code = zlib.crc32(letter.encode(), code)
        codes.append(code)
    return np.array(codes, np.uint64)


_usual_codes = lru_cache(maxsize=1 << 16)(_prefix_codes)


def cells_of(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Cell of each beginning, by its hash and that of the word before it."""
    with np.errstate(over="ignore"):
        mixed = (before * np.uint64(0x9E3779B97F4A7C15) ^ last) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(64 - CELL_BITS)


def word_code(word: str) -> int:
    return zlib.crc32(word.encode())


def asked_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, last = (np.array([word_code(w) for w in batch.column(c).to_pylist()], np.uint64) for c in ("before", "last"))
        found = np.unique(cells_of(before, last)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found // CELL_BLOCK, pa.int32()), pa.array(found % CELL_BLOCK, pa.int32())], names=["block", "cell"])


def pack_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of few blocks -> the bits of each."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        block, cell = (c.to_numpy() for c in batch.columns)
        for b in np.unique(block).tolist():
            held.setdefault(b, np.zeros(CELL_BLOCK, np.uint8))[cell[block == b]] = 1
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])


def cell_filter(asked: DataFrame) -> bytes:
    """A bit for each of the 2 ** CELL_BITS cells, whether a beginning is asked there; of the same size for any number of them."""
    rows = asked.select("before", "last").mapInArrow(asked_cells, "block int, cell int").repartition("block").mapInArrow(pack_cells, "block int, bits binary").collect()
    bits = np.zeros(((1 << CELL_BITS) // CELL_BLOCK, CELL_BLOCK // 8), np.uint8)
    for row in rows:
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.tobytes()


def word_counts(load: Callable[[], bytes]) -> Callable:
    """How often words occur inside texts (before = '') and after another word, of those that begin in an asked way, and the lengths of such beginnings.

    The last word of each text is left out.
    Asked beginnings are looked up in cells of fixed number, so words besides the asked ones may be
    counted too; however many are asked, a batch gives a row at most for each of its distinct pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(np.frombuffer(load(), np.uint8)).astype(bool)
        for batch in batches:
            ids: dict[str, int] = {"": 0}
            spans = []
            for text in plain_array(batch.column("text").cast(pa.large_string())).to_pylist():
                words = WORDS.findall((text or "").lower())[:-1]
                spans.append(np.array([0, *(ids.setdefault(w, len(ids)) for w in words)], np.int64))
            flat = np.concatenate([*spans, np.zeros(1, np.int64)])
            pairs, n = np.unique(flat[:-1] << 32 | flat[1:], return_counts=True)
            before, word = pairs >> 32, pairs & 0xFFFFFFFF
            names = np.array(list(ids), object)
            single = np.bincount(word, n, len(names)).astype(np.int64)
            kept = (before > 0) & (word > 0)
            seen = np.flatnonzero(single[1:]) + 1
            before, word, n = np.concatenate((before[kept], np.zeros(len(seen), np.int64))), np.concatenate((word[kept], seen)), np.concatenate((n[kept], single[seen]))
            codes = [prefix_codes(w) for w in ids]
            length = np.array([len(c) for c in codes])
            starts = np.cumsum(length) - length
            every = np.concatenate(codes)
            own = np.array([word_code(w) for w in ids], np.uint64)
            size = length[word]
            row = np.repeat(np.arange(len(word)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + starts[word][row]
            found = np.flatnonzero(asked[cells_of(own[before[row]], every[at])])
            hits = np.bincount(row[found], minlength=len(word))
            hit = np.flatnonzero(hits)
            ends = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(hits[hit]))), pa.int32()), pa.array((at - starts[word][row] + 1)[found], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(names[before[hit]], pa.string()), pa.array(names[word[hit]], pa.string()), pa.array(n[hit], pa.int64()), ends], names=["before", "word", "n", "ends"])

    return run


def beginning_counts(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: before, last -> how often last is a whole word inside the texts, and begins a longer one: whole, longer."""
    shared = documents.sparkSession.sparkContext.broadcast(cell_filter(asked))
    texts = spread(documents.select("text").where(F.col("text").isNotNull()))
    counts = texts.mapInArrow(word_counts(lambda: shared.value), "before string, word string, n long, ends array<int>").groupBy("before", "word").agg(F.sum("n").alias("n"), F.first("ends").alias("ends"))
    begun = counts.select("before", "word", "n", F.explode("ends").alias("end")).select("before", "word", "n", F.left("word", F.col("end")).alias("last"))
    whole = F.col("last") == F.col("word")
    told = begun.join(asked, ["before", "last"]).groupBy("before", "last")
    return told.agg(F.sum(F.when(whole, F.col("n")).otherwise(0)).alias("whole"), F.sum(F.when(whole, 0).otherwise(F.col("n"))).alias("longer"))


@F.pandas_udf(T.DoubleType())
def poisson_tail(seen: pd.Series, expected: pd.Series) -> pd.Series:
    """Probability of at least seen events where expected are."""

    def tail(k: int, mean: float) -> float:
        if k <= mean:
            return 1.0
        # terms fall from k on, as k is beyond the mean
        term = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        total, i = 0.0, k
        while term > total * 1e-12 and i < k + 1000:
            total += term
            i += 1
            term *= mean / i
        return min(1.0, total)

    return pd.Series([tail(int(k), float(m)) for k, m in zip(seen, expected)])


def length_hazards(ends: DataFrame) -> DataFrame:
    """Hazard of each length of each source: source, measure, length, n, at_risk, hazard, neighbours, p, significant."""
    measured = ends.select("source", F.explode(F.create_map(F.lit("chars"), "n_chars", F.lit("bytes"), "n_bytes")).alias("measure", "length"))
    counts = measured.where(F.col("length") > 0).groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    of = W.partitionBy("source", "measure").orderBy("length")
    risk = counts.withColumn("at_risk", F.sum("n").over(W.partitionBy("source", "measure").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)))
    near = of.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    # lengths that no text has add to the neighbours' time at risk, so their hazard is a share of lengths too
    beside = (F.sum("n").over(near) - F.col("n") + F.lit(0.5)) / F.lit(2 * NEIGHBOURS) / F.avg("at_risk").over(near)
    tested = risk.select("*", (F.col("n") / F.col("at_risk")).alias("hazard"), beside.alias("neighbours"))
    tested = tested.withColumn("p", poisson_tail(F.col("n"), F.greatest(F.col("neighbours") * F.col("at_risk"), F.lit(1e-3))))
    by_p = W.partitionBy("source", "measure").orderBy("p", "length")
    ranked = tested.withColumn("r", F.row_number().over(by_p)).withColumn("m", F.count("*").over(W.partitionBy("source", "measure")))
    passed = F.max(F.when(F.col("p") <= F.col("r") * F.lit(FDR) / F.col("m"), F.col("r"))).over(W.partitionBy("source", "measure"))
    return ranked.withColumn("significant", F.coalesce(F.col("r") <= passed, F.lit(False)) & (F.col("n") > 2) & (F.col("hazard") >= LIFT * F.col("neighbours"))).drop("r", "m")


def text_endings(documents: DataFrame) -> DataFrame:
    columns = spread(documents.select("doc_id", "source", "doc_format", "text").where(F.col("text").isNotNull()))
    return columns.mapInArrow(endings, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, source string, n_chars long, n_bytes long, state int, marked boolean, before string, last string")


def judged_endings(documents: DataFrame) -> DataFrame:
    """Texts that do not end plainly whole: doc_id, source, n_chars, before, last, state, at_limit (the length is a significant one)."""
    ends = cut_lineage(text_endings(documents))  # without the texts
    by_source = ends.groupBy("source").agg(F.avg(F.col("marked").cast("double")).alias("share"))
    limits = length_hazards(ends).where("significant").groupBy("source").agg(
        F.collect_set(F.when(F.col("measure") == "chars", F.col("length"))).alias("chars"), F.collect_set(F.when(F.col("measure") == "bytes", F.col("length"))).alias("bytes")
    )
    facts = by_source.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "of")
    open_ends = ends.where(F.col("state") != WHOLE).join(facts, F.col("source").eqNullSafe(F.col("of")), "left")
    at_limit = F.coalesce(F.array_contains("chars", F.col("n_chars")), F.lit(False)) | F.coalesce(F.array_contains("bytes", F.col("n_bytes")), F.lit(False))
    # a text without any mark is judged by its last word, unless its source always has marks
    judged = F.when((F.col("state") == OPEN) & ~F.col("marked") & (F.col("share") < PROSE_SHARE), WORD).otherwise(F.col("state"))
    return cut_lineage(open_ends.select("doc_id", "source", "n_chars", "before", "last", judged.alias("state"), at_limit.alias("at_limit")))


def truncated(documents: DataFrame) -> DataFrame:
    """The cut documents: doc_id, source, n_chars, at_limit (the length is a significant one)."""
    known = judged_endings(documents)
    plainly = known.where(F.col("state") == OPEN)
    doubtful = known.where((F.col("state") == WORD) & F.col("last").isNotNull())
    # each ending is asked for after its word, and alone
    asked = doubtful.select(F.explode(F.array(F.struct("before", "last"), F.struct(F.lit("").alias("before"), "last"))).alias("a")).select("a.*").distinct()
    counts = cut_lineage(beginning_counts(documents, asked))
    pair = counts.select("before", "last", F.col("whole").alias("pair_whole"), F.col("longer").alias("pair_longer"))
    single = counts.where(F.col("before") == "").select("last", "whole", "longer")
    weighed = doubtful.join(pair, ["before", "last"], "left").join(single, "last", "left").na.fill(0, ["pair_whole", "pair_longer", "whole", "longer"])
    # a text of a significant length was cut somewhere: inside a word, if longer words begin like its last one more often than it occurs
    odds = F.when(F.col("at_limit"), 1.0).otherwise(ELSEWHERE)
    told = (F.col("before") != "") & (F.col("pair_whole") + F.col("pair_longer") >= PAIR_EVIDENCE)
    cut = odds * F.when(told, F.col("pair_longer")).otherwise(F.col("longer")) > F.when(told, F.col("pair_whole")).otherwise(F.col("whole")) + 0.01
    maybe = (F.col("whole") == 0) & F.col("at_limit")
    words = weighed.where(cut | maybe)
    columns = ["doc_id", "source", "n_chars", "at_limit"]
    return plainly.select(*columns).unionByName(words.select(*columns))


def cut_rates(documents: DataFrame) -> DataFrame:
    """Every source with its number of texts, of cut ones, their rate, and how many were cut at a significant length."""
    cut = truncated(documents).groupBy("source").agg(F.count("*").alias("n_cut"), F.count_if("at_limit").alias("n_at_limit"))
    every = documents.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n_docs"))
    joined = every.join(cut, F.col("of").eqNullSafe(F.col("source")), "left")
    n = F.coalesce("n_cut", F.lit(0))
    return joined.select(F.col("of").alias("source"), "n_docs", n.alias("n_cut"), F.coalesce("n_at_limit", F.lit(0)).alias("n_at_limit"), (n / F.col("n_docs")).alias("cut_rate"))
