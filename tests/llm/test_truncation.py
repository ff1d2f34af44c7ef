"""Endings by format, limits among lengths, and odd rows."""

import random

import pytest

from cuelattice.llm import truncation as T
from tests.llm.fixture import sentence

SRT = "1\n00:00:01,000 --> 00:00:02,000\nThe baker sells a box.\n\n2\n00:00:03,000 --> 00:00:04,000\nMy sister\npaints the radio!"
ASS = "Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,The baker sells, a box.\nDialogue: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,,Done."


@pytest.mark.parametrize("text, form", [(SRT, "srt"), (SRT + "\n", "srt"), (ASS, "ass"), ("A sentence. Another one!", "txt"), ("Er sagt: „Gut.“.", "md"), ("他說：「好。」", "md"), ("文。\n※", "txt"), ("Done. -- 4 --", "txt"), ("He says: “Fine.”", "txt"), ("…", "txt")])
def test_finished(text, form):
    assert T.ending_state(text.strip(), form)[0] == T.WHOLE


@pytest.mark.parametrize("text, form", [(SRT[:-9], "srt"), (SRT[: SRT.rfind("My")].strip(), "srt"), (SRT[: SRT.rfind(" -->")], "srt"), (SRT[: SRT.rfind("2\n") + 1], "srt"), (ASS[:-3], "ass"), (ASS[:-40], "ass"), ("A sentence. Another", "txt"), ("Er sagt: „Gut.", "md"), ("她說：「好。很", "md"), ("Text about sto�", "txt"), ("A. #", "txt"), ("A line.\n#tag #", "txt")])
def test_unfinished(text, form):
    assert T.ending_state(text.strip(), form)[0] == T.OPEN


@pytest.mark.parametrize("text, form", [("a = b\nthe clo", "list"), ("Text.\n#one #tw", "txt")])
def test_decided_by_the_last_word(text, form):
    assert T.ending_state(text, form)[0] == T.WORD


DOCS = "doc_id long, source string, doc_format string, text string, state int, n_chars int"


def transcript(rng, n):
    return " ".join(sentence("en", rng.randrange(4), rng.randrange(4), rng.randrange(4)).lower().rstrip(".") for _ in range(n))


def test_cut_transcripts_prose_and_lists(spark):
    rng = random.Random(4)
    rows, cut = [], set()
    for i in range(300):
        text = transcript(rng, rng.randrange(6, 20))
        if i % 5 == 0:
            at = text.rfind(" ") + 1
            text = text[: at + (2 if len(text) - at > 3 else 1)]
            cut |= {i}
        rows.append((i, "asr", "txt", text, None, None))
    for i in range(300, 400):
        text = " ".join(sentence("de", rng.randrange(4), rng.randrange(4), rng.randrange(4)) for _ in range(8))
        if i % 4 == 0:
            text, cut = text[:-5], cut | {i}
        rows.append((i, "prose", "txt", text, None, None))
    rows += [(500, "x", "txt", None, 1, 1), (501, "x", "txt", "  ", 1, 1), (502, None, None, "An end.", 1, 1), (503, None, None, "No en", 1, 1), (504, "y", "txt", "Word. " * 50_000, 1, 1)]
    frame = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"] for r in T.truncated(frame).collect()}
    assert got - {503} == cut and 503 in got | {503}
    rates = {r["source"]: (r["n_docs"], r["n_cut"]) for r in T.cut_rates(frame).collect()}
    assert rates["asr"] == (300, 60) and rates["prose"] == (100, 25) and rates["y"] == (1, 0)
    assert T.truncated(frame.limit(0)).count() == 0 and T.cut_rates(frame.limit(0)).count() == 0


def test_last_words_of_any_length(spark):
    rng = random.Random(8)
    run = "".join(rng.choice("漁師銀鍵箱窓橋庭船長糸巻壊見知破手紙黄色古地図真鍮") for _ in range(900))
    rows = [(1, "asr", "txt", f"始 {run} 次の話 終", 1, 1), (2, "asr", "txt", f"始 {run[:700]}", 1, 1), (3, "asr", "txt", f"始 {run}", 1, 1)]
    frame = spark.createDataFrame(rows, DOCS)
    ends = {r["doc_id"]: (r["before"], r["last"]) for r in T.text_endings(frame).collect()}
    assert ends == {1: ("次の話", "終"), 2: ("始", run[:700]), 3: ("始", run)}
    assert {r["doc_id"] for r in T.truncated(frame).collect()} == {2}


def test_limits_are_significant_lengths(spark):
    rng = random.Random(6)
    lengths = [min(280, int(rng.lognormvariate(5.2, 0.7))) for _ in range(4000)]
    frame = spark.createDataFrame([(i, "s", "txt", "ж" * n, 0, 0) for i, n in enumerate(lengths)], DOCS)
    found = {(r["measure"], r["length"]) for r in T.length_hazards(T.text_endings(frame)).where("significant").collect()}
    assert ("chars", 280) in found and ("bytes", 560) in found and len(found) <= 6
