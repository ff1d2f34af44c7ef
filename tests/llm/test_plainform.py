"""Plain form against normal form C and golden texts."""

import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pytest

from cuelattice.llm.plainform import ASSIGNED, plain_array, plain_form, plain_list

PAIRS = {
    "Ａ　medianoche": "A medianoche", "ｱﾊﾞｶﾞﾊﾟ": "アバガパ", "été": "été", "각x": "각x", "pian‍o": "piano", "so­ft﻿": "soft",
    "ﬁne": "fine", "⼀⻑": "一長", "Тһе cook": "The cook", "Мoлодая лётчица": "Молодая лётчица", "El prestadο": "El prestado", "a\r\nb\rc": "a\nb\nc", "a b\tc": "a b c",
    "Bop крадёт": "Вор крадёт", "Нow а day": "How a day", "が": "が", "x️": "x", "2‍0:1‍8": "20:18",
}
KEPT = ["👩‍💻 ⚠️", "①½²！", "The cook | Пекарь несёт а", "Художница крадёт ключ. La peintre vole", "TV стоит", "Ελλάδα", "", "1️⃣", "плащ", "ключ в городе. p. 12 Жизкев", "На рассвете (rev. B) Галка", "Ё. С.довница"]


def test_golden_texts():
    assert dict(zip(PAIRS, plain_list(list(PAIRS)))) == PAIRS
    assert plain_list(KEPT) == KEPT


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=20), max_size=5))
def test_idempotent_and_row_wise(texts):
    once = plain_list(texts)
    assert plain_list(once) == once
    assert [plain_list([t])[0] for t in texts] == once


MARKS = [chr(c) for c in (*range(0x41, 0x5B), *range(0xC0, 0x100), *range(0x300, 0x310), 0x323, 0x327, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x304B, 0x3099)]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=MARKS, max_size=12))
def test_composes_like_normal_form_c(text):
    assert plain_list([text])[0] == unicodedata.normalize("NFC", text)


def test_nulls_slices_and_long_texts(spark):
    arr = pa.array(["x", None, "é", "", "ｶ" * 200_000])
    assert plain_array(arr.slice(1)).to_pylist() == [None, "é", "", "カ" * 200_000]
    assert plain_array(pa.array([], pa.string())).to_pylist() == []
    rows = spark.createDataFrame([(1, "ﬁ"), (2, None)], "id int, text string")
    assert [r[0] for r in rows.orderBy("id").select(plain_form(F.col("text"))).collect()] == ["fi", None]
    assert rows.limit(0).select(plain_form(F.col("text"))).count() == 0


@pytest.mark.parametrize("text", ["їжак і ліс", "Тато і мама", "Я і ти", "Він сказав: «Її немає»", "І знову дощ — і вітер", "Україна (Kyiv) і Львів", "Јован и Јелена су овде", "Ја сам у соби. Она је ту.", "Ѕвезда и ѕид", "Іван ідзе ў лес і спявае", "Мен үйдемін және һәм"])
def test_other_cyrillic_languages_keep_their_letters(text):
    assert plain_list([text]) == [text]


def test_look_alikes_that_russian_lacks_stand_for_latin_letters():
    assert plain_list(["sіster and mom", "ѕіх", "The ѕіх keys", "Her ѕister Іnes"]) == ["sister and mom", "six", "The six keys", "Her sister Ines"]


def test_code_points_left_out_of_the_tables_are_unassigned():
    assert {unicodedata.category(chr(cp)) for cp in range(ASSIGNED, 0xE0000)} == {"Cn"}
