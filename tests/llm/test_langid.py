"""Languages of held-out sentences, mixed texts and odd rows."""

import pyarrow as pa

from cuelattice.llm.langid import Identifier, label_code, language_segments
from cuelattice.llm.langmodel import LANGUAGES, labelled_sample
from tests.llm.fixture import PHRASES, documents, models, sentence


def segments(*texts):
    return [[LANGUAGES[lang] for lang, _, _ in found] for found in Identifier(models()).segments(pa.array(texts, pa.large_string()))]


def test_held_out_sentences():
    cases = [(lang, sentence(lang, a, b, a + b)) for lang in PHRASES for a in range(4) for b in range(4)]
    assert segments(*[t for _, t in cases]) == [[lang] for lang, _ in cases]


def test_mixed_texts_in_order():
    pairs = [(a, b) for a in PHRASES for b in PHRASES if a != b]
    for joint in (" | ", "\n", " / "):
        got = segments(*[sentence(a, 0, 1, 2) + joint + sentence(b, 3, 0, 1) for a, b in pairs])
        assert sum(g == [a, b] for g, (a, b) in zip(got, pairs)) >= 0.95 * len(pairs)
    assert segments("DVD " + sentence("ja", 0, 0, 0), sentence("zh", 1, 1, 1) + " (USB)") == [["ja"], ["zh"]]


def test_short_blank_and_long_texts():
    assert segments("Menu", "", "12:34", "※", "!!!") == [[], [], [], [], []]
    assert segments(" ".join([sentence("fr", 0, 1, 2)] * 3000)) == [["fr"]]


def test_confidence_is_a_probability():
    found = Identifier(models()).segments(pa.array([sentence("de", 0, 0, 0)], pa.large_string()))[0]
    assert 0.5 < found[0][1] <= 1.0


def test_frames(spark):
    rows = spark.createDataFrame([(1, sentence("es", 0, 0, 0), "old", 5), (2, None, None, None), (1, sentence("es", 0, 0, 0), "old", 5), (3, "ok", "x", 1)], "id long, text string, lang string, seg_no int")
    got = language_segments(rows, models()).collect()
    assert [(r["id"], r["seg_no"], r["lang"], r["n_segments"]) for r in got] == [(1, 1, "es", 1)] * 2
    assert language_segments(rows.limit(0), models()).count() == 0
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([("zh-Hant",), ("EN",), (" de_DE ",), (None,), ("",)], "l string")
    assert [r[0] for r in labels.select(label_code(F.col("l"))).collect()] == ["zh", "en", "de", "", ""]


def test_sample_is_bounded_and_repeatable(spark):
    docs = [(lang.upper() + "-XX", text, "txt") for lang, text in documents(3, 2)] + [(None, "x", "txt"), ("und", "y", "txt"), ("en", None, "txt"), ("en", "listed", "list")]
    frame = spark.createDataFrame(docs, "lang string, text string, doc_format string")
    a, b = labelled_sample(frame, 2), labelled_sample(frame.repartition(7), 2)
    assert a == b and len(a) == 16 and "listed" not in [t for _, t in a]


def test_sample_holds_copies_once(spark):
    texts = [sentence("en", k, k // 4, 0) for k in range(8)]
    frame = spark.createDataFrame([("en", t, "txt") for t in texts for _ in range(20)], "lang string, text string, doc_format string")
    assert {t for _, t in labelled_sample(frame, 8)} == set(texts) and len(labelled_sample(frame, 5)) == 5


def test_models_of_nothing_and_of_one_language():
    from cuelattice.llm.langmodel import fit

    assert Identifier(fit([])).segments(pa.array(["a text of some length", ""], pa.large_string())) == [[], []]
    only = Identifier(fit([("de", sentence("de", 0, 0, 0))])).segments(pa.array([sentence("de", 0, 0, 0)], pa.large_string()))
    assert [[LANGUAGES[x[0]] for x in s] for s in only] == [["de"]]
