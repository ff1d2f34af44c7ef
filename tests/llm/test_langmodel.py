"""Models of all labelled documents against models of the same texts at hand."""

import numpy as np

from cuelattice.llm import langmodel
from cuelattice.llm.langmodel import fit, fitted, grams
from cuelattice.llm.pairs import WordBook
from tests.llm.fixture import documents, sentence


def test_every_document_counts_whole(spark):
    name = lambda k: "".join(chr(0x61 + k // 26**i % 26) for i in range(3))
    # more texts, and longer ones, than any sample took
    texts = documents(2, 3) + [("en", f"{sentence('en', k, k // 4, k // 16)} Qu{name(k)}x meets qu{name(k)}x.") for k in range(400)]
    texts.append(("fr", " ".join(sentence("fr", k, k // 4, k // 16) for k in range(3200)) + " Le zyqwort et le zyqwort."))
    rows = [(lang.upper() + "_XX", t, "txt") for lang, t in texts] + [("en", texts[20][1], "md"), (None, "x", "txt"), ("und", "y", "txt"), ("en", None, "txt"), ("en", "listed listed", "list")]
    frame = spark.createDataFrame(rows, "lang string, text string, doc_format string").repartition(5)
    made, parts = fitted(frame, WordBook.words, endings=True)
    book, want, all_words = WordBook.counted(parts), fit(texts), WordBook(texts)
    assert {f"qu{name(k)}x" for k in range(400)} | {"zyqwort"} <= set(book.weight) and "listed" not in book.weight
    assert set(book.weight) == set(all_words.weight) and all(np.allclose(book.weight[w], x) for w, x in all_words.weight.items())
    for field in ("keys", "logp", "histories", "backoff"):
        assert all(np.array_equal(x, y) for x, y in zip(getattr(made, field), getattr(want, field), strict=True)), field
    for (keys, rate), (other, wanted) in zip(made.ends["sentence"], want.ends["sentence"], strict=True):
        assert np.array_equal(keys, other) and np.array_equal(rate, wanted, equal_nan=True)
    assert len(made.ends["sentence"][7][0]) and np.array_equal(made.sentence, want.sentence) and made.limit != 12.0
    end = grams(np.array([ord(x) for x in "zyqwo"], np.uint32), np.array([0, 5]), 5)[-1][-1]
    assert end in made.keys[4]


def test_tables_without_labelled_documents(spark):
    frame = spark.createDataFrame([(None, "x", "txt")], "lang string, text string, doc_format string")
    for endings in (True, False):
        made, parts = fitted(frame, WordBook.words, endings=endings)
        assert not len(made.keys[0]) and made.limit == 12.0 and not WordBook.counted(parts).weight


def test_without_calibration_each_sequence_counts_in_one_part(spark, monkeypatch):
    cut, held = langmodel.cut_lineage, []
    monkeypatch.setattr(langmodel, "cut_lineage", lambda df: held.append(cut(df)) or held[-1])
    texts = documents(4, 6)
    frame = spark.createDataFrame([(lang, t, "txt") for lang, t in texts], "lang string, text string, doc_format string").repartition(1)
    made, _ = fitted(frame, WordBook.words, endings=True, calibrated=False)
    want = fit(texts)
    counted = held[0].where("word IS NULL")
    inner = counted.where(f"(b & {(1 << 21) - 1}) NOT IN ({langmodel.BLANK}, {langmodel.STOP}) AND h8 != 0")
    assert counted.where("held").count() == 0 and inner.count() == inner.select("lang", "h8").distinct().count()
    # after a blank or stop no more than six codes set sequences apart
    others = counted.where(f"(b & {(1 << 21) - 1}) IN ({langmodel.BLANK}, {langmodel.STOP})")
    assert others.count() == others.select("lang", "a", "b").distinct().count() > 0
    for field in ("keys", "logp", "histories", "backoff"):
        assert all(np.array_equal(x, y) for x, y in zip(getattr(made, field), getattr(want, field), strict=True)), field
    for (keys, rate), (other, wanted) in zip(made.ends["sentence"], want.ends["sentence"], strict=True):
        assert np.array_equal(keys, other) and np.array_equal(rate, wanted, equal_nan=True)
    assert len(made.ends["sentence"][7][0]) and made.limit == 12.0
