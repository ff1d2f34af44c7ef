"""The fold on golden timelines, and its three forms against each other."""

import random

import pytest
from pyspark.sql import functions as F

from cuelattice.config import Settings
from cuelattice.operators import compose, tracking
from cuelattice.operators.samples import counting_rows
from cuelattice.schemas import BLOCK

TOP, BOTTOM = (0.1, 0.05, 0.9, 0.2), (0.1, 0.7, 0.9, 0.9)
SAMPLES = f"video_id long, sample_index int, timestamp_s double, status string, blocks array<{BLOCK}>, ingested_at timestamp_ntz"


def block(text, where=BOTTOM, order=None, confidence=None, label="text"):
    return ("1", where, text, label, order, confidence, None)


def frame(spark, rows, video=1):
    """rows: (index, blocks or 'failed')."""
    made = [(video, i, float(i - 1), "failed" if b == "failed" else "ok", [] if b == "failed" else b, None) for i, b in rows]
    return spark.createDataFrame(made, SAMPLES)


def videos(spark, duration=1000.0, interval=1.0):
    return spark.createDataFrame([(1, interval, duration)], "video_id long, sample_interval double, duration double")


def events(spark, rows, settings=Settings(), duration=1000.0, interval=1.0, chunk=tracking.CHUNK):
    found = tracking.numbered_events(tracking.track_events(frame(spark, rows), videos(spark, duration, interval), settings, chunk)).orderBy("event_no").collect()
    return [(e["start_s"], e["end_s"], e["source_text"], e["sample_indices"]) for e in found]


def test_constant_text_is_one_event(spark):
    assert events(spark, [(i, [block("こんにちは")]) for i in (1, 2, 3)]) == [(0.0, 3.0, "こんにちは", [1, 2, 3])]


def test_misread_text_continues_and_keeps_the_first(spark):
    assert events(spark, [(1, [block("今日は天気がいいね")]), (2, [block("今日は天気がいいよ")])]) == [(0.0, 2.0, "今日は天気がいいね", [1, 2])]


def test_same_text_elsewhere_is_another_event(spark):
    assert len(events(spark, [(1, [block("A text", TOP)]), (2, [block("A text", BOTTOM)])])) == 2


def test_changed_text_ends_the_event_there(spark):
    assert events(spark, [(1, [block("first")]), (2, [block("first")]), (3, [block("另一句話")])]) == [(0.0, 2.0, "first", [1, 2]), (2.0, 3.0, "另一句話", [3])]


def test_gaps_and_failures(spark):
    gap = [(1, [block("X")]), (2, []), (3, [block("X")])]
    assert events(spark, gap) == [(0.0, 3.0, "X", [1, 3])]
    assert len(events(spark, gap, Settings(gap_tolerance=0))) == 2
    assert events(spark, [(1, [block("X")]), (2, "failed"), (3, [block("X")])], Settings(gap_tolerance=0)) == [(0.0, 3.0, "X", [1, 3])]


def test_clipped_and_short_events(spark):
    late = frame(spark, [(1, [block("X")])]).withColumn("timestamp_s", F.lit(9.5))
    assert tracking.track_events(late, videos(spark, 10.0)).first()["end_s"] == 10.0
    assert events(spark, [(1, [block("X")])], interval=0.2) == [] and len(events(spark, [(1, [block("X")])])) == 1


def test_carried_values(spark):
    rows = [(1, [block("X", confidence=0.5)]), (2, [block("X", order=3, confidence=0.9)]), (3, [block("X", order=4, confidence=None, label="title")])]
    e = tracking.track_events(frame(spark, rows), videos(spark)).first()
    assert (e["reading_order"], e["confidence"], e["label"], e["observation_count"]) == (3, 0.9, "text", 3)


def test_ties_go_to_the_first_open_event(spark):
    rows = [(1, [block("X", (0.1, 0.1, 0.5, 0.2)), block("X", (0.12, 0.1, 0.52, 0.2))]), (2, [block("X", (0.11, 0.1, 0.51, 0.2))])]
    assert sorted(e[3] for e in events(spark, rows)) == [[1], [1, 2]]


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0.0, "ok", None, None), (None, 1, 0.0, "ok", [block("X")], None), (1, None, 0.0, "ok", [block("X")], None), (1, 2, None, "ok", [block("X")], None),
         (1, 3, 2.0, "ok", [("1", None, "X", None, None, None, None), block(None), block(" "), block("y" * 5000)], None)], SAMPLES)
    found = tracking.track_events(rows, videos(spark, None)).collect()
    assert [len(e["source_text"]) for e in found] == [5000]
    assert tracking.track_events(rows.limit(0), videos(spark)).count() == 0


def timeline(rng, n):
    words = ["alpha beta", "gamma delta", "epsilon zeta eta", "alpha bete"]
    rows = []
    for i in range(1, n + 1):
        if rng.random() < 0.15:
            continue
        if rng.random() < 0.1:
            rows.append((i, "failed"))
            continue
        blocks = [block(rng.choice(words), tuple(v + rng.uniform(-0.02, 0.02) for v in where)) for where in (TOP, BOTTOM) if rng.random() < 0.4]
        rows.append((i, blocks))
    return rows


def test_stretches_fold_like_the_whole(spark):
    for seed in range(3):
        rows = timeline(random.Random(seed), 120)
        tracker = tracking.Tracker(Settings(), 1.0, 1000.0)
        for i, blocks in rows:
            if blocks != "failed":
                tracker.add(i, float(i - 1), [{"source_text": b[2], "bbox": dict(zip(("x0", "y0", "x1", "y1"), b[1]))} for b in blocks])
        whole = sorted((e["start_s"], e["end_s"], e["source_text"], e["sample_indices"]) for e in tracker.take(end=True))
        assert sorted(events(spark, rows, chunk=7)) == whole


def test_islands_equal_the_fold_for_equal_text(spark):
    rng = random.Random(5)
    rows = [(i, "failed" if rng.random() < 0.1 else [block(rng.choice(["aaaa", "bbbb", "cccc"]))] if rng.random() < 0.6 else []) for i in range(1, 150)]
    fold = sorted((int(s * 1000), int(e * 1000), t, len(x)) for s, e, t, x in events(spark, rows))
    islands = tracking.region_islands(frame(spark, rows), videos(spark)).collect()
    assert sorted((r["start_ms"], r["end_ms"], r["text"], r["observation_count"]) for r in islands) == fold


def test_counting_rows_take_the_latest(spark):
    from datetime import datetime

    rows = spark.createDataFrame([(1, 1, 0.0, "failed", [], datetime(2024, 1, 1)), (1, 1, 0.0, "ok", [block("X")], datetime(2024, 1, 2)), (1, 1, 0.0, "ok", [], None)], SAMPLES)
    assert [(r["status"], len(r["blocks"])) for r in counting_rows(rows).collect()] == [("ok", 1)]


EVENTS = "video_id long, start_s double, end_s double, source_text string, bbox array<double>, reading_order int"


@pytest.mark.parametrize("mode, want", [("ltr", ["a", "b", "c"]), ("rtl", ["b", "a", "c"]), ("ttb", ["b", "c", "a"])])
def test_geometric_order(spark, mode, want):
    rows = [(1, 0.0, 1.0, "a", [0.1, 0.1, 0.2, 0.2], None), (1, 0.0, 1.0, "b", [0.5, 0.1, 0.6, 0.2], 1), (1, 0.0, 1.0, "c", [0.3, 0.5, 0.4, 0.6], 2)]
    assert compose.compose_cues(spark.createDataFrame(rows, EVENTS), mode).first()["source_texts"] == want


def test_reading_order_where_all_lines_have_one(spark):
    rows = [(1, 0.0, 1.0, "下", [0.1, 0.1, 0.2, 0.2], 2), (1, 0.0, 1.0, "上", [0.5, 0.5, 0.6, 0.6], 1), (1, 0.0, 2.0, "x", [0.0, 0.0, 0.1, 0.1], None)]
    made = {(c["start_s"], c["end_s"]): c["source_texts"] for c in compose.compose_cues(spark.createDataFrame(rows, EVENTS)).collect()}
    assert made == {(0.0, 1.0): ["上", "下"], (0.0, 2.0): ["x"]}
