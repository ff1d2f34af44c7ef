import random
"""Column functions and plain functions on small golden values."""

import math
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelattice.config import FIELD_NAMES, Settings, stable_hash
from cuelattice.functions import geometry, keys, parse, similarity, text, timefmt


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_display_and_match_text():
    assert similarity.display_text(" Ａ　b \r\n c\t d ") == "A b\nc d"
    assert similarity.display_text(None) == "" == similarity.display_text(" \n ")
    assert similarity.match_text("Straße  X") == "strassex"


def test_similarity_is_gestalt_and_not_symmetric():
    assert similarity.similarity("", "") == 1.0 and similarity.similarity("a", "") == 0.0
    assert similarity.similarity("tide", "diet") != similarity.similarity("diet", "tide")
    assert similarity.similarity("今日は天気がいいね", "今日は天気がいいよ") >= 0.85


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcあい", max_size=30), st.text(alphabet="abcあい", max_size=30), st.floats(0, 1))
def test_bounds_do_not_change_the_decision(a, b, t):
    assert similarity.at_least(a, b, t) == (similarity.matched_ratio(a, b) >= t)


def test_meaningful_and_clean(spark):
    rows = spark.createDataFrame([("★",), ("。！",), ("今日",), ("A1",), ("①",), ("",), (None,), ("a　  b ",)], "t string")
    got = rows.select(text.is_meaningful(F.col("t")), text.clean_text(F.col("t"))).collect()
    assert [r[0] for r in got] == [False, False, True, True, True, False, False, True]
    assert got[-1][1] == "a b" and got[-2][1] == ""


def test_display_columns(spark):
    rows = spark.createDataFrame([("ａ  b\r\n c ",), (None,)], "t string")
    got = rows.select(text.display_text(F.col("t")), text.match_text(F.col("t")), text.tidy_display(F.col("t"))).collect()
    assert tuple(got[0]) == ("a b\nc", "abc", "ａ b\nc") and tuple(got[1]) == ("", "", "")


def box(*v):
    return F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))])


def test_geometry(spark):
    a, b, far = box(0, 0, 1, 1), box(0.5, 0, 1.5, 1), box(2, 2, 3, 3)
    row = one(spark, geometry.iou(a, b), geometry.iou(a, far), geometry.center_distance(a, b), geometry.region_match(a, b), geometry.region_match(a, far))
    assert row[0] == pytest.approx(1 / 3) and row[1] == 0 and row[2] == 0.5 and row[3] and not row[4]
    assert geometry.box_iou((0, 0, 1, 1), (0.5, 0, 1.5, 1)) == pytest.approx(1 / 3)
    assert geometry.same_region((0, 0, 0.1, 0.1), (0.1, 0.1, 0.2, 0.2), 0.3, 0.08) is (math.hypot(0.1, 0.1) < 0.08 * math.sqrt(2))
    unit = one(spark, geometry.unit_box(*[F.lit(float(x)) for x in (200, 50, -10, 150)], F.lit(100), F.lit(100)))[0]
    assert tuple(unit) == (0.0, 0.5, 1.0, 1.0)
    assert one(spark, geometry.unit_box(*[F.lit(1.0)] * 4, F.lit(0), F.lit(0)))[0]["x0"] is None


def test_time_codes(spark):
    row = one(spark, *[timefmt.srt_time(F.lit(x)) for x in (3661.999, -1.0, 0.0005)], *[timefmt.ass_time(F.lit(x)) for x in (3661.99, -1.0)])
    assert tuple(row) == ("01:01:01,999", "00:00:00,000", "00:00:00,000", "1:01:01.99", "0:00:00.00")


def test_ass_colors_and_escape(spark):
    assert timefmt.ass_color("Yellow") == "&H0000FFFF" and timefmt.ass_color("#102030") == "&H00302010"
    assert timefmt.ass_color("&h00aa") == "&H00AA" and timefmt.ass_color("") == timefmt.ass_color("mauve") == timefmt.WHITE
    assert one(spark, timefmt.ass_escape(F.lit("{a}\r\nb\nc\rd\\")))[0] == "(a)\\Nb\\Nc\\Nd\\"


def test_keys(spark):
    assert one(spark, keys.canonical_key(F.array(F.lit('a"b'), F.lit("あ"))))[0] == '["a\\"b", "あ"]'
    assert one(spark, keys.canonical_key(F.array().cast("array<string>")))[0] == "[]"
    body = {"model": "m", "messages": [], "stream": True, "user": "u"}
    assert keys.request_key(body) == keys.request_key({"messages": [], "model": "m"}) == stable_hash({"model": "m", "messages": []})
    rows = spark.createDataFrame([('{"model":"m","messages":[],"id":1}',), ("no json",), (None,)], "r string")
    assert [r[0] for r in rows.select(keys.request_keys(F.col("r"))).collect()] == [keys.request_key(body), None, None]
    asked = keys.messages(["x"], None, "de")
    assert asked == keys.messages(["x"], None, "de") and asked[1]["content"] == '["x"]' and "auto" in asked[0]["content"]


def test_parse(spark):
    row = one(spark, *[parse.fraction(F.lit(x)) for x in ("30000/1001", "0/0", "25", "x", None)])
    assert row[0] == pytest.approx(29.97, abs=1e-2) and tuple(row)[1:] == (0.0, 25.0, 0.0, 0.0)
    assert tuple(one(spark, *[parse.quarter_turns(F.lit(x)) for x in (-90, 450, None)])) == (270, 90, 0)
    assert tuple(one(spark, *[parse.sample_count(F.lit(d), F.lit(i)) for d, i in ((10.0, 1.0), (10.1, 1.0), (0.0, 1.0), (5.0, 0.0))])) == (10, 11, 0, 0)
    assert parse.json_array('```json\n["a", 1, null]\n```') == ["a", "1", "None"]
    assert parse.json_array("so: [\"x\"] ok") == ["x"] and parse.json_array("[1") is None and parse.json_array("{}") is None
    assert parse.stream_rotation({"side_data_list": [{"rotation": -90}]}) == 270 and parse.stream_rotation({"tags": {"rotate": "90"}}) == 90 and parse.stream_rotation({}) == 0
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert parse.retry_after("3") == 3 and parse.retry_after("-1") == 0 and parse.retry_after("Mon, 01 Jan 2024 00:00:10 GMT", now) == 10 and parse.retry_after("soon") is None
    assert parse.valid_interval(0.1) and not parse.valid_interval(float("nan")) and not parse.valid_interval(61)


def test_settings():
    assert len(FIELD_NAMES) == 37
    base = Settings()
    assert base.stage_hash("ocr") == Settings(ocr_batch_size=2, ocr_server_url="x").stage_hash("ocr") != Settings(ocr_confidence=0.5).stage_hash("ocr")
    assert base.stage_hash("emit") != Settings(bilingual=True).stage_hash("emit") and base.stage_hash("track") == Settings(bilingual=True).stage_hash("track")
    assert base.stage_params("translate", model="m")["model"] == "m" and base.former_ocr_hash() != base.stage_hash("ocr")


def test_three_decimals_as_exact_values_round(spark):
    from cuelattice.operators.compose import round3

    rng = random.Random(1)
    values = [0.0005, 2.6755, 1.0005, 0.0015, 2.5, 0.0, -0.0005, -2.6755, 1e9 + 0.0005, *(round(rng.uniform(0, 9000), 4) for _ in range(3000)), *(rng.randrange(10**7) / 2000 for _ in range(3000))]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", round3(F.col("x")).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in got if r["y"] != round(r["x"], 3)] == []


def test_arrays_of_answers_as_text_and_as_columns(spark):
    texts = ['["a", "b"]', '```json\n["a", 1, null, true, 1.5]\n```', "so: [\"x\"] ok", "[1", "{}", "[]", "no", '["a"] and ["b"]', "['a']", '["ä\\n\\u00e9"]', "[[1], 2]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse.json_arrays(F.col("t")).alias("a")).collect()
    assert [r["a"] for r in got] == [parse.json_array(t) for t in texts]


def test_display_and_matching_forms_of_batches(spark):
    from cuelattice.functions import similarity as S
    from cuelattice.functions import text

    rng = random.Random(5)
    alphabet = list("aAßſİı ﬁｶﾞe\u0301\u00a0\u3000\n\r\t\x0b\x1c\u200b\u1100\u1161ÅÅ①Ǆ\u0345α漢") + ["\r\n", "\0"]
    rows = [None, "", " ", "\0", "a\0b", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(3000))]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.display_text(F.col("t")).alias("d"), text.match_text(F.col("t")).alias("m")).collect()
    assert [r for r in got if (r["d"], r["m"]) != (S.display_text(r["t"]), S.match_text(r["t"]))] == []
