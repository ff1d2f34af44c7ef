"""Totals, caps and expectations of the mix."""

import random
from collections import Counter

import pytest

from cuelattice.llm import mixing as M

DOCS, TARGETS = "doc_id long, text string, source string, copies int", "source string, target_share double, max_repeats int"


def corpus(spark, n=600):
    rng = random.Random(1)
    source = ["a"] * 8 + ["b"] * 3 + ["c"]
    return spark.createDataFrame([(i, "word " * rng.randrange(1, 40), rng.choice(source), 0) for i in range(n)], DOCS)


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAF", 16)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("gone", 0.1, 1)], TARGETS)
    docs = corpus(spark)
    rows = M.copies(docs, targets).collect()
    assert len(rows) == docs.count() == len({r["doc_id"] for r in rows})
    cap = {"a": 1, "b": 2, "c": 4}
    assert all(0 <= r["copies"] <= cap[r["source"]] for r in rows)
    got = {r["source"]: r for r in M.shares(docs, targets).collect()}
    for source, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert got[source]["share"] == pytest.approx(share, abs=0.01)
    assert got["gone"]["tokens_used"] == 0 and got["gone"]["share"] == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.copies(docs.repartition(5), targets).collect()))


def test_pivot_keeps_mass_and_expectation(monkeypatch):
    sizes, counts, n = [3, 10, 1, 7, 5, 2], Counter(), 4000
    for seed in range(n):
        monkeypatch.setattr(M, "SEED", seed)
        whole, held = M.pivot(list(range(6)), [0.3] * 6, sizes, "t")
        left = held[1] * sizes[held[0]] if held else 0
        assert sum(sizes[k] * v for k, v in whole.items()) + left == pytest.approx(0.3 * sum(sizes), abs=1e-6)
        counts.update({k: v for k, v in whole.items()})
        if held:
            counts[held[0]] += held[1]
    assert all(abs(counts[k] / n - 0.3) < 0.03 for k in range(6))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "a", 1), (3, "x y z", "a", 1), (3, "x y z", "a", 1), (None, "q", "a", 1), (4, "z" * 100_000, None, 1), (5, "other", "untargeted", 1)], DOCS)
    targets = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, None), ("b", None, 2)], TARGETS)
    got = {r["doc_id"]: r["copies"] for r in M.copies(docs, targets).collect()}
    assert set(got) == {1, 2, 3} and got[3] == 1
    assert {r["source"] for r in M.shares(docs, targets).collect()} == {"a", "b"}
    assert M.copies(docs.limit(0), targets).count() == 0 and M.copies(docs, targets.limit(0)).count() == 0


def test_counts_match_the_tokenizer(spark):
    rows = M.sizes(corpus(spark, 20)).join(corpus(spark, 20).select("doc_id", "text"), "doc_id").collect()
    assert all(r["n_tokens"] == len(M.encoding(M.TOKENIZER).encode_ordinary(r["text"])) for r in rows)
