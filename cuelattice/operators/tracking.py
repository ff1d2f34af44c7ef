"""Screen text tracked over samples into events with a start and an end.

The fold is greedy: a block extends the most similar open event of its region, else closes the
first open event there and opens a new one; an event that more than gap_tolerance ok samples in a
row do not show closes by itself. Failed samples say nothing and are left out.

It runs in parallel within a video: after gap_tolerance + 1 ok samples without text nothing is
open, so a video falls into stretches that fold on their own. Their bounds are found by prefix
sums in two levels (within chunks of sample numbers, then over one row per chunk), so no task sorts
a whole video; the fold itself streams over sorted rows and holds open events only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.config import Settings
from cuelattice.functions.geometry import same_region
from cuelattice.functions.similarity import display_text, match_text, matched_ratio
from cuelattice.functions.text import tidy_display
from cuelattice.operators.ordinals import numbered, time_bucket
from cuelattice.operators.samples import counting_rows, region_of
from cuelattice.schemas import BOX

CHUNK = 1024
EVENT = (
    f"video_id long, start_s double, end_s double, source_text string, bbox {BOX}, reading_order int, label string, confidence double, "
    "sample_indices array<int>, observation_count int, close_seq int"
)


@lru_cache(maxsize=8192)
def shown_forms(text: str | None) -> tuple[str, str]:
    """Display and matching form; screens repeat their texts."""
    shown = display_text(text)
    return shown, match_text(shown)


@dataclass
class Open:
    """An event that may still be extended: first text and label, latest box and time."""

    text: str
    form: str
    start: float
    seen: float
    box: tuple
    order: int | None
    label: str | None
    confidence: float | None
    samples: list[int] = field(default_factory=list)
    missed: int = 0
    fresh: bool = True


class Tracker:
    """The fold over one video's ok samples in order."""

    def __init__(self, settings: Settings, interval: float | None = None, duration: float | None = None):
        self.settings = settings
        self.interval = settings.interval if interval is None else interval
        self.duration = duration
        self.open: list[Open] = []
        self.closed: list[dict] = []
        self.closings = 0

    def add(self, index: int, time: float, blocks: list[dict]) -> None:
        for event in self.open:
            event.fresh = False
        for block in blocks:
            text, form = shown_forms(block.get("source_text"))
            box = tuple(block["bbox"][k] for k in ("x0", "y0", "x1", "y1")) if block.get("bbox") else None
            if text and box is not None and None not in box:
                self._place(index, time, text, form, box, block)
        kept = []
        for event in self.open:
            event.missed = 0 if event.fresh else event.missed + 1
            if event.missed > self.settings.gap_tolerance:
                self._close(event, event.seen + self.interval)
            else:
                kept.append(event)
        self.open = kept

    def _place(self, index: int, time: float, text: str, form: str, box: tuple, block: dict) -> None:
        s = self.settings
        near = [e for e in self.open if not e.fresh and same_region(box, e.box, s.iou_threshold, s.center_dist_ratio)]
        best, ratio = None, -1.0
        for event in near:
            bound = 2.0 * min(len(form), len(event.form)) / max(1, len(form) + len(event.form))
            if form != event.form and bound < s.text_similarity:
                continue
            now = matched_ratio(form, event.form)
            if now >= s.text_similarity and now > ratio:
                best, ratio = event, now
        if best is None:
            if near:
                self._close(near[0], time)
                self.open.remove(near[0])
            self.open.append(Open(text, form, time, time, box, block.get("reading_order"), block.get("label"), block.get("confidence"), [index]))
            return
        best.seen, best.box, best.fresh = time, box, True
        best.samples.append(index)
        if best.order is None:
            best.order = block.get("reading_order")
        known = [c for c in (best.confidence, block.get("confidence")) if c is not None]
        best.confidence = max(known) if known else None

    def _close(self, event: Open, end: float) -> None:
        if self.duration and self.duration > 0:
            end = min(end, self.duration)
        self.closed.append({
            "start_s": round(max(0.0, event.start), 3), "end_s": round(end, 3), "source_text": event.text,
            "bbox": dict(zip(("x0", "y0", "x1", "y1"), (round(v, 5) for v in event.box))), "reading_order": event.order, "label": event.label,
            "confidence": event.confidence, "sample_indices": event.samples, "observation_count": len(event.samples), "close_seq": self.closings,
        })
        self.closings += 1

    def take(self, end: bool = False) -> list[dict]:
        """Events closed since the last call that last long enough; at the end of the samples all of them."""
        if end:
            for event in self.open:
                self._close(event, event.seen + self.interval)
            self.open = []
        done = [e for e in self.closed if e["end_s"] - e["start_s"] >= self.settings.min_event_duration - 1e-9]
        self.closed = []
        return done


def quiescent_stretches(rows: DataFrame, tolerance: int, chunk: int = CHUNK) -> DataFrame:
    """rows: ok samples with video_id, sample_index and busy (it shows text); busy ones with the stretch they belong to.

    A stretch is named by the ordinal of its first busy sample among the video's ok samples.
    """
    rows = rows.withColumn("chunk", F.floor(F.col("sample_index") / chunk))
    inside = W.partitionBy("video_id", "chunk").orderBy("sample_index")
    ordinal = F.row_number().over(inside)
    local = rows.withColumn("at", ordinal)
    before = F.max(F.when(F.col("busy"), F.col("at"))).over(inside.rowsBetween(W.unboundedPreceding, -1))
    local = local.withColumn("before", before)
    # cuts that show within the chunk; that of its first busy sample depends on earlier chunks
    local = local.withColumn("cut", F.col("busy") & (F.col("at") - F.col("before") - 1 > tolerance))
    local = local.withColumn("last_cut", F.max(F.when(F.col("cut"), F.col("at"))).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    heads = local.groupBy("video_id", "chunk").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("busy"), F.col("at"))).alias("first_busy"), F.max(F.when(F.col("busy"), F.col("at"))).alias("last_busy"), F.max(F.when(F.col("cut"), F.col("at"))).alias("end_cut")
    )
    over = W.partitionBy("video_id").orderBy("chunk")
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    heads = heads.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    heads = heads.withColumn("busy_before", F.max(F.col("shift") + F.col("last_busy")).over(earlier))
    opens = F.col("first_busy").isNotNull() & (F.col("busy_before").isNull() | (F.col("shift") + F.col("first_busy") - F.col("busy_before") - 1 > tolerance))
    heads = heads.withColumn("opened", F.when(opens, F.col("shift") + F.col("first_busy")))
    carried = F.max(F.greatest(F.col("opened"), F.col("shift") + F.col("end_cut"))).over(earlier)
    heads = heads.select("video_id", "chunk", "shift", "opened", carried.alias("carried"))
    joined = local.where("busy").join(heads, ["video_id", "chunk"])
    stretch = F.coalesce(F.col("shift") + F.col("last_cut"), F.col("opened"), F.col("carried"))
    return joined.withColumn("stretch", stretch).withColumn("ok_ord", F.col("shift") + F.col("at")).drop("chunk", "at", "before", "cut", "last_cut", "shift", "opened", "carried")


def shows_text(blocks: Column, kind: T.DataType) -> Column:
    """Whether a sample has a block that may open an event; which ones have no letter, sign or number is left to the fold."""
    return F.exists(F.coalesce(blocks, F.array().cast(kind)), lambda b: F.length(F.trim(F.coalesce(b["source_text"], F.lit("")))) > 0)


def fold_stretches(settings: Settings):
    """Arrow function: rows sorted by video, stretch and ok_ord -> events."""

    names = [x.strip().split()[0] for x in EVENT.replace("struct<x0:double,y0:double,x1:double,y1:double>", "box").split(",")]
    box = pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")])
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.string(), box, pa.int32(), pa.string(), pa.float64(), pa.list_(pa.int32()), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tracker, last = None, None, 0

        def emit(done: list[dict], video: int) -> list[tuple]:
            return [(video, *(e[n] for n in names[1:])) for e in done]

        for batch in batches:
            out: list[tuple] = []
            for video, stretch, ordinal, index, time, blocks, interval, duration in zip(*(batch.column(c).to_pylist() for c in ("video_id", "stretch", "ok_ord", "sample_index", "timestamp_s", "blocks", "interval", "duration"))):
                if (video, stretch) != key:
                    if tracker is not None:
                        out += emit(tracker.take(end=True), key[0])
                    key, tracker, last = (video, stretch), Tracker(settings, interval, duration), ordinal - 1
                for _ in range(min(ordinal - last - 1, settings.gap_tolerance + 1)):
                    tracker.add(index, time, [])  # ok samples without text in between
                tracker.add(index, time, blocks or [])
                last = ordinal
                out += emit(tracker.take(), video)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if tracker is not None and (done := emit(tracker.take(end=True), key[0])):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    return run


def track_events(samples: DataFrame, videos: DataFrame, settings: Settings = Settings(), chunk: int = CHUNK) -> DataFrame:
    """Events of all videos, in no order; interval and duration come from videos, else from the settings.

    videos without a row or with null values take the settings' interval and are not clipped.
    """
    fields = ("bbox", "source_text", "label", "reading_order", "confidence")
    slim = samples.select("video_id", "sample_index", "ingested_at", "status", "timestamp_s", F.transform("blocks", lambda b: F.struct(*[b[f].alias(f) for f in fields])).alias("blocks"))
    rows = counting_rows(slim, ["status", "timestamp_s", "blocks"]).where((F.col("status") != "failed") & F.col("timestamp_s").isNotNull())
    busy = shows_text(F.col("blocks"), slim.schema["blocks"].dataType)
    found = quiescent_stretches(rows.withColumn("busy", busy), settings.gap_tolerance, chunk)
    facts = videos.groupBy("video_id").agg(F.max("sample_interval").alias("interval"), F.max("duration").alias("duration"))
    joined = found.join(facts, "video_id", "left").withColumn("interval", F.coalesce("interval", F.lit(settings.interval)))
    keyed = joined.repartition("video_id", "stretch").sortWithinPartitions("video_id", "stretch", "ok_ord")
    return keyed.select("video_id", "stretch", "ok_ord", "sample_index", "timestamp_s", "blocks", "interval", "duration").mapInArrow(fold_stretches(settings), EVENT)


def numbered_events(events: DataFrame) -> DataFrame:
    """Events with their number in the video, by start, then top to bottom, then left to right."""
    order = ["start_s", "bbox.y0", "bbox.x0", "end_s", "source_text", "close_seq"]
    return numbered(events, "event_no", "video_id", time_bucket("start_s"), order).drop("close_seq")


def region_islands(samples: DataFrame, videos: DataFrame, tolerance: int = 1, min_duration: float = 0.0, text: Column | None = None) -> DataFrame:
    """The fold by window functions alone, for text that only continues where it is equal: one row an event.

    Exact where a region holds one block a sample and all its boxes match each other; regions are
    the thirds of the screen here.
    """
    shown = F.transform("blocks", lambda b: F.struct(region_of(b["bbox"]).alias("region"), (tidy_display(b["source_text"]) if text is None else text).alias("text"), b["confidence"].alias("confidence")))
    slim = samples.select("video_id", "sample_index", "ingested_at", "status", "timestamp_s", shown.alias("blocks"))
    ok = counting_rows(slim, ["status", "timestamp_s", "blocks"]).where(F.col("status") != "failed")
    # an event never reaches beyond a stretch, so windows run within stretches, not over a whole video
    busy = F.exists(F.coalesce("blocks", F.array().cast(slim.schema["blocks"].dataType)), lambda b: (F.coalesce(b["text"], F.lit("")) != "") & b["region"].isNotNull())
    found = quiescent_stretches(ok.withColumn("busy", busy), tolerance)
    seen = found.select("video_id", "stretch", "sample_index", "timestamp_s", "ok_ord", F.explode("blocks").alias("b")).select("video_id", "stretch", "sample_index", "timestamp_s", "ok_ord", "b.*")
    seen = seen.where((F.col("text") != "") & F.col("region").isNotNull())
    by = W.partitionBy("video_id", "stretch", "region").orderBy("ok_ord")
    gap = F.col("ok_ord") - F.lag("ok_ord").over(by) - 1
    new = F.lag("text").over(by).isNull() | (F.col("text") != F.lag("text").over(by)) | (gap > tolerance)
    marked = seen.withColumn("island", F.sum(F.when(new, 1).otherwise(0)).over(by))
    islands = marked.groupBy("video_id", "stretch", "region", "island").agg(
        F.min("timestamp_s").alias("start"), F.max("timestamp_s").alias("last"), F.min_by("text", "ok_ord").alias("text"), F.min("ok_ord").alias("first_ord"), F.max("ok_ord").alias("last_ord"),
        F.max("confidence").alias("confidence"), F.count("*").alias("observation_count"), F.min("sample_index").alias("first_sample"), F.max("sample_index").alias("last_sample"),
    )
    then = W.partitionBy("video_id", "stretch", "region").orderBy("island")
    changed = F.lead("first_ord").over(then) - F.col("last_ord") - 1 <= tolerance
    facts = videos.groupBy("video_id").agg(F.max("sample_interval").alias("interval"), F.max("duration").alias("duration"))
    ended = islands.withColumn("next_start", F.when(changed, F.lead("start").over(then))).join(facts, "video_id", "left")
    end = F.coalesce("next_start", F.col("last") + F.coalesce("interval", F.lit(1.0)))
    end = F.when(F.col("duration") > 0, F.least(end, F.col("duration"))).otherwise(end)
    timed = ended.withColumn("start_ms", F.rint(F.greatest(F.col("start"), F.lit(0.0)) * 1000).cast("bigint")).withColumn("end_ms", F.rint(end * 1000).cast("bigint"))
    kept = timed.where(F.col("end_ms") - F.col("start_ms") >= int(round(min_duration * 1000)))
    return kept.select("video_id", "region", "start_ms", "end_ms", "text", "confidence", "observation_count", "first_sample", "last_sample")
