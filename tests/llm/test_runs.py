"""Runs against a loop over each video."""

import random
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from cuelattice.functions.similarity import match_text, matched_ratio
from cuelattice.llm.plainform import plain_list
from cuelattice.llm.runs import may_share_anchor, text_runs
from cuelattice.schemas import BLOCK

SAMPLES = f"video_id long, sample_index int, timestamp_s double, status string, blocks array<{BLOCK}>, ingested_at timestamp_ntz, items string, chunk int"
PLACE = {"top": (0.1, 0.0, 0.9, 0.1), "middle": (0.1, 0.9, 0.9, 0.1), "bottom": (0.1, 0.8, 0.9, 0.9)}


def sample(video, index, texts, status="ok", at=0, time=None):
    """texts: region -> text."""
    blocks = [(f"{index}-{n}", PLACE[r], t, None, None, None, None) for n, (r, t) in enumerate(texts.items(), 1)]
    return video, index, (index - 1) * 0.5 if time is None else time, status, blocks, datetime(2024, 1, 1 + at), "clash", 1


def brute(rows):
    latest = {}
    for r in sorted(rows, key=lambda r: r[5]):
        latest[r[0], r[1]] = r
    out = set()
    for video in {k[0] for k in latest}:
        ok = [latest[k] for k in sorted(latest) if k[0] == video and latest[k][3] == "ok"]
        for region, place in PLACE.items():
            run, gap = None, 0
            for r in [*ok, None]:
                text = None if r is None else next((b[2] for b in r[4] if b[1] == place), None)
                if r is not None and text is None:
                    gap += 1
                    continue
                form = None if r is None else match_text(plain_list([text])[0])
                if r is not None and run and gap <= 1 and matched_ratio(form, run[0]) >= 0.85:
                    run[2], run[3] = r, run[3] + 1
                else:
                    if run:
                        out.add((video, region, run[1][1], run[2][1], run[3], round((run[2][2] - run[1][2]) * 1000)))
                    run = [form, r, r, 1] if r is not None else None
                gap = 0
    return out


def found(frame, chunk=512):
    return {(r["video_id"], r["region"], r["first_sample"], r["last_sample"], r["n_obs"], r["duration_ms"]) for r in text_runs(frame, chunk).collect()}


def test_random_timelines(spark):
    rng = random.Random(3)
    words = ["The quick brown fox jumps", "The quick brown fox jumqs", "The quikk brown fax jumqs", "ｶﾀｶﾅの字幕です", "カタカナの字幕です", "other"]
    rows = []
    for video in (1, 2, 3):
        for index in range(1, 160):
            if rng.random() < 0.1:
                continue
            texts = {r: rng.choice(words) for r in PLACE if rng.random() < 0.7}
            rows.append(sample(video, index, texts, "failed" if rng.random() < 0.1 else "ok", at=rng.randrange(3)))
            if rng.random() < 0.1:
                rows.append(sample(video, index, {"top": "again"}, at=5))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SAMPLES)
    want = brute(rows)
    for chunk in (512, 16, 3, 1):
        assert found(frame, chunk) == want, chunk


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdé", max_size=14), st.text(alphabet="abcdé", max_size=14), st.text(alphabet="abcdé", max_size=14))
def test_texts_with_a_common_anchor_are_seen_as_such(anchor, a, b):
    for t in (0.6, 0.85):
        if matched_ratio(a, anchor) >= t and matched_ratio(b, anchor) >= t:
            assert may_share_anchor(a, b, t)


def test_busy_screens_hand_on_little(spark):
    rng = random.Random(8)
    rows = [sample(1, i, {"top": " ".join(rng.choice(["alpha", "bravo", "delta", "kilo", "lima", "oscar"]) for _ in range(6))}) for i in range(1, 401)]
    texts = [r[4][0][2] for r in rows]
    from cuelattice.llm import runs as R

    got = R._chunk_rows(1, 0, list(range(1, 401)), [0.0] * 400, texts, "top", {t: match_text(t) for t in texts}, R.repetition(), 0.85, {})
    assert sum(r[4] == R.OPEN for r in got) < 20 and len(got) > 200
    frame = spark.createDataFrame(rows, SAMPLES)
    assert found(frame, 16) == brute(rows)


def test_a_run_over_many_chunks_and_odd_rows(spark):
    rows = [sample(1, i, {"top": "same text"}) for i in range(1, 101)] + [sample(1, 150, {"top": "same text"})]
    rows += [(None, 1, 0.0, "ok", [], datetime(2024, 1, 1), None, None), (1, None, 0.0, "ok", None, datetime(2024, 1, 1), None, None)]
    rows += [(9, 1, None, "ok", [("1", None, "x", None, None, None, None), ("2", PLACE["top"], None, None, None, None, None)], None, None, None), (9, 2, None, None, None, None, None, None)]
    got = found(spark.createDataFrame(rows, SAMPLES), 8)
    assert got == {(1, "top", 1, 150, 101, 74500), (9, "top", 1, 1, 1, None)}
    assert found(spark.createDataFrame([], SAMPLES)) == set()
