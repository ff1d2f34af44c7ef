"""Problem 2: runs of repeated consecutive screen text, one event each.

Each stretch of CHUNK sample numbers of a video is one row with its observations in order, however
long the video. Per region its texts become one symbol string: a code point for each distinct
plain text, GAP for an ok sample without a block in the region. A backreference pattern finds
repetitions, once over the texts and once over the texts' anchors (the first text of the run a
text is similar to), and its spans map back to sample numbers and timestamps. What may reach over
the edge of a stretch is carried by a fold over stretch summaries: a stretch hands on only what
lies before the first text that begins a run whatever was open, and its last run.

Defined results: failed samples and samples without a number do not count; of several blocks of a
sample in one region the first in the array counts; a block without a box has no region; a null
text is the empty text; a null timestamp gives a null duration.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.functions.similarity import at_least, match_text
from cuelattice.llm.plainform import plain_array
from cuelattice.operators.samples import counting_rows, region_of

REGIONS = ("top", "middle", "bottom")
THRESHOLD = 0.85
#: ok samples without a block in the region that a run may hold between two observations.
TOLERANCE = 1
#: Sample numbers in one row; bounds what a task holds of one video at a time.
CHUNK = 512
GAP = " "
FIRST_SYMBOL = 0x10000
FINAL, OPEN, SILENT = 0, 1, 2
PART = "video_id long, region string, chunk long, seq int, kind int, gap int, trailing int, text string, first_sample int, first_s double, last_sample int, last_s double, n_obs int"
NAMES = [x.split()[0] for x in PART.split(", ")]


def repetition(tolerance: int = TOLERANCE) -> regex.Pattern:
    """One symbol and its repetitions, with up to tolerance gaps between each two."""
    return regex.compile(rf"([^{GAP}])(?:{GAP}{{0,{tolerance}}}\1)*")


def _anchors(entries: list[list], forms: dict[str, str], threshold: float, known: dict) -> list[str]:
    """For each entry the text of the run it belongs to, within one stretch without certain cuts."""
    out: list[str] = []
    for entry in entries:
        text = entry[0]
        if out and entry[1] <= TOLERANCE:
            pair = (forms[text], forms[out[-1]])
            if pair not in known:
                known[pair] = at_least(*pair, threshold)
            if known[pair]:
                out.append(out[-1])
                continue
        out.append(text)
    return out


def may_share_anchor(a: str, b: str, threshold: float) -> bool:
    """Whether some text could be similar enough to both of two matching forms.

    What a text shares with a and what it shares with b overlaps in the text by so much at least,
    and that much a and b have in common; the text is at most so long to be similar to either.
    """
    common = sum((Counter(a) & Counter(b)).values())
    longest = min(len(a), len(b)) * (2 / threshold - 1)
    return common >= threshold / 2 * (len(a) + len(b)) - (1 - threshold) * longest - 1e-9


def _synchronised(entries: list[list], forms: dict[str, str], threshold: float, known: dict) -> int:
    """The first entry that begins a run whatever run was open before the chunk; their number if none does.

    Follows all anchors that may be in force: the unknown one from before, and those it may have ended for.
    """
    possible: set[str | None] = {None}
    for k, entry in enumerate(entries):
        text, after, begins = entry[0], set(), True
        for anchor in possible:
            if anchor is None:
                goes_on = k == 0 or may_share_anchor(forms[entries[0][0]], forms[text], threshold)
                after.add(text)  # it may also end here
            else:
                pair = (forms[text], forms[anchor])
                if pair not in known:
                    known[pair] = at_least(*pair, threshold)
                goes_on = known[pair]
            after.add(anchor if goes_on else text)
            begins &= not goes_on
        if begins:
            return k
        possible = after
    return len(entries)


def _chunk_rows(video, chunk, numbers, times, texts, region, forms, pattern, threshold, known) -> list[tuple]:
    """FINAL runs of one region of one chunk and the OPEN entries that the fold has to finish."""
    seen = [i for i, text in enumerate(texts) if text is not None]
    n = len(texts)
    if not seen:
        return [(video, region, chunk, 0, SILENT, min(n, TOLERANCE + 1), 0, None, None, None, None, None, 0)]
    symbols = {text: chr(FIRST_SYMBOL + k) for k, text in enumerate(dict.fromkeys(texts[i] for i in seen))}
    string = "".join(GAP if text is None else symbols[text] for text in texts)
    entries, end = [], 0  # text, gap before, start, stop (positions of first and last observation)
    for m in pattern.finditer(string):
        entries.append([texts[m.start()], m.start() - end, m.start(), m.end() - 1])
        end = m.end()
    trailing = min(n - end, TOLERANCE + 1)
    cuts = [k for k, entry in enumerate(entries) if entry[1] > TOLERANCE] + [len(entries)]
    if cuts[0] and (at := _synchronised(entries[: cuts[0]], forms, threshold, known)) < cuts[0]:
        cuts.insert(0, at)
    rows: list[tuple] = []

    def add(kind: int, gap: int, text: str, start: int, stop: int) -> None:
        held = [i for i in range(start, stop + 1) if texts[i] is not None]
        rows.append((video, region, chunk, len(rows), kind, min(gap, TOLERANCE + 1), 0, text, numbers[start], times[start], numbers[stop], times[stop], len(held)))

    for text, gap, start, stop in entries[: cuts[0]]:
        add(OPEN, gap, text, start, stop)
    if rows and len(cuts) > 1:  # what is open at the first cut ends there
        rows[-1] = (*rows[-1][:6], TOLERANCE + 1, *rows[-1][7:])
    for low, high in zip(cuts[:-1], cuts[1:]):
        piece = entries[low:high]
        anchored = [GAP] * n
        for anchor, (_, _, start, stop) in zip(_anchors(piece, forms, threshold, known), piece):
            for i in range(start, stop + 1):
                if texts[i] is not None:
                    anchored[i] = symbols[anchor]
        runs = [(m.start(), m.end() - 1) for m in pattern.finditer("".join(anchored))]
        for start, stop in runs:
            open_end = high == len(entries) and stop == runs[-1][1] and trailing <= TOLERANCE
            add(OPEN if open_end else FINAL, TOLERANCE + 1, texts[start], start, stop)
    if rows[-1][4] == OPEN:
        rows[-1] = (*rows[-1][:6], trailing, *rows[-1][7:])
    elif not any(row[4] == OPEN for row in rows):  # the fold sees none of these rows, but has to see that they end what was open
        rows.append((video, region, chunk, len(rows), SILENT, TOLERANCE + 1, 0, None, None, None, None, None, 0))
    return rows


def _flatten(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    return np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))), column.flatten()


def chunk_runs(batches: Iterator[pa.RecordBatch], threshold: float = THRESHOLD) -> Iterator[pa.RecordBatch]:
    pattern = repetition()
    for batch in batches:
        bounds, items = _flatten(batch.column("items"))
        order_of = items.field("sample_index").to_numpy(zero_copy_only=False)
        times = items.field("timestamp_s").to_pylist()
        plain: dict[str, list] = {}
        for region in REGIONS:
            column = items.field(region).dictionary_encode()
            words = plain_array(column.dictionary.cast(pa.large_string())).to_pylist()
            plain[region] = [None if k is None else words[k] for k in column.indices.to_pylist()]
        known: dict = {}
        forms: dict[str, str] = {}
        rows: list[tuple] = []
        for k, (video, chunk) in enumerate(zip(batch.column("video_id").to_pylist(), batch.column("chunk").to_pylist())):
            at = np.arange(bounds[k], bounds[k + 1])
            at = at[np.argsort(order_of[at], kind="stable")].tolist()
            numbers, moments = order_of[at].tolist(), [times[i] for i in at]
            for region in REGIONS:
                texts = [plain[region][i] for i in at]
                for text in texts:
                    if text is not None and text not in forms:
                        forms[text] = match_text(text)
                rows += _chunk_rows(video, chunk, numbers, moments, texts, region, forms, pattern, threshold, known)
        yield _batch(rows)


ARROW = pa.schema([(x, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[k]) for x, k in (y.split() for y in PART.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def stitch(batches: Iterator[pa.RecordBatch], threshold: float = THRESHOLD) -> Iterator[pa.RecordBatch]:
    """Fold over rows sorted by video, region and chunk; holds one run at a time."""
    run: list | None = None
    gap, form = 0, ""
    for batch in batches:
        done: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[4] == FINAL and run is None:
                done.append(row)
                continue
            if run is not None and (row[0], row[1]) != (run[0], run[1]):
                done.append(tuple(run))
                run = None
            if row[4] == SILENT:
                gap += row[5]
                continue
            if run is not None and row[4] == OPEN and gap + row[5] <= TOLERANCE and at_least(match_text(row[7]), form, threshold):
                run[10], run[11], run[12] = row[10], row[11], run[12] + row[12]
            else:
                if run is not None:
                    done.append(tuple(run))
                run = list(row) if row[4] == OPEN else None
                form = match_text(row[7]) if run else ""
                if run is None:
                    done.append(row)
            gap = row[6]
        yield _batch(done)
    if run is not None:
        yield _batch([tuple(run)])


def _first_in(region: str) -> Column:
    return F.get(F.filter("blocks", lambda b: b["region"] == region), F.lit(0))["text"]


def text_runs(samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every run, single observations too: video_id, region, text, first_sample, last_sample, n_obs, duration_ms."""
    blocks = F.transform(F.col("blocks"), lambda b: F.struct(region_of(b["bbox"]).alias("region"), F.coalesce(b["source_text"], F.lit("")).alias("text")))
    slim = samples.select("video_id", "sample_index", "ingested_at", "status", "timestamp_s", blocks.alias("blocks"))
    rows = counting_rows(slim, ["status", "timestamp_s", "blocks"]).where(F.col("status") == "ok")
    texts = [_first_in(r).alias(r) for r in REGIONS]
    item = F.struct("sample_index", "timestamp_s", *texts)
    chunks = (
        rows.select("video_id", F.floor(F.col("sample_index") / chunk).alias("chunk"), item.alias("item"))
        .groupBy("video_id", "chunk")
        .agg(F.collect_list("item").alias("items"))
    )
    parts = chunks.mapInArrow(chunk_runs, PART)
    # finished runs are spread by chunk; only open ones of a region meet in one fold
    salt = F.when(F.col("kind") == FINAL, F.col("chunk")).otherwise(F.lit(-1))
    folded = (
        parts.repartition("video_id", "region", salt)
        .sortWithinPartitions("video_id", "region", salt, "chunk", "seq")
        .mapInArrow(stitch, PART)
    )
    duration = F.round((F.col("last_s") - F.col("first_s")) * 1000).cast("bigint")
    return folded.select("video_id", "region", "text", "first_sample", "last_sample", "n_obs", duration.alias("duration_ms"))
