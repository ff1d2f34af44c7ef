"""The join against all pairs."""

import random

import numpy as np
import pyarrow as pa

from cuelattice.llm import neardup as N

WORDS = [f"{a}{b}{c}" for a in ("bra", "kel", "vom") for b in ("to", "mi", "lu", "sa") for c in ("n", "rk", "d", "x")]


def texts(seed, n=60):
    rng = random.Random(seed)
    out: list[str] = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split()
            for _ in range(rng.randrange(12)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                rng.shuffle(words)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(14, 40))))
    return out + out[:4]


def brute(rows, t=0.6):
    sets = {k: set(N.sequences(N.compared(v)).tolist()) for k, v in rows if len(N.compared(v)) >= 80}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def test_all_pairs_are_found(spark):
    for seed in range(3):
        rows = [(f"r{i:03d}", t) for i, t in enumerate(texts(seed))]
        frame = spark.createDataFrame(rows + rows[:5], "rec_key string, text string")
        got = [tuple(r) for r in N.near_duplicates(frame).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_hot_lists_are_cut_without_loss(spark):
    rows = [(f"r{i:03d}", t) for i, t in enumerate(texts(9))]
    of = N.members(spark.createDataFrame(rows, "rec_key string, text string"))
    whole = {tuple(r)[:2] for r in N.class_links(of).collect()}
    assert whole and {tuple(r)[:2] for r in N.class_links(of, hot=7).collect()} == whole


def test_answers_derived_from_a_similar_set_are_the_same(spark):
    rows = [(f"r{i:03d}", t) for i, t in enumerate(texts(5, 90))]
    of = N.members(spark.createDataFrame(rows, "rec_key string, text string"))
    with_reuse, without = ({tuple(r) for r in N.class_links(of, reuse=x).collect()} for x in (True, False))
    assert with_reuse == without and with_reuse
    base = " ".join(random.Random(1).choice(WORDS) for _ in range(40))
    close = [base.replace(w, w[:-1] + "q", 1) for w in base.split()[:12]]
    answers, plain = N.Answers(0.6, True), N.Answers(0.6, False)
    for text in [base, *close]:
        for each in (answers, plain):
            each.start(7, N.compared(text))
        for k, other in enumerate(close + [" ".join(reversed(base.split())), "x" * 99]):
            assert answers.similarity(k, N.compared(other)) == plain.similarity(k, N.compared(other))
    assert answers.derived > 0.8 * plain.in_full and plain.derived == 0


def test_short_and_long_lists_find_the_same(spark, monkeypatch):
    rows = [(f"r{i:03d}", t) for i, t in enumerate(texts(11, 80))]
    of = N.members(spark.createDataFrame(rows, "rec_key string, text string"))
    whole = {tuple(r)[:2] for r in N.class_links(of).collect()}
    rng = np.random.default_rng(3)
    n = 300
    size = np.sort(rng.integers(80, 130, n))
    lists = N.Lists({"size": size, "at": rng.integers(0, 30, n), "bits": rng.integers(0, 1 << 62, (n, N.BITMAP)).astype(np.uint64) & np.uint64(0x1111), "part": rng.integers(0, 2, n), "crossing": np.zeros(n, bool)}, 0.6)
    monkeypatch.setattr(N, "SHORT", n + 1)
    pairs = lambda found: {(int(a), int(b)) for x, y in found for a, b in zip(x, y)}
    assert pairs(lists.short(np.array([0]), np.array([n]))) == pairs(lists.long(0, n)) and whole


def test_copies_are_paired_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 4)
    rows = [(f"r{i:02d}", "the same long text of a screen " * 4) for i in range(23)]
    got = [tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "rec_key string, text string")).collect()]
    assert len(got) == len(set(got)) == 23 * 22 // 2 and all(a < b for a, b in got)


def test_compared_form_and_odd_rows(spark):
    assert N.compared("Ａb-1٣ ½ é​") == "ab1٣12é" and N.compared(None) == ""
    long = "abcdefghij" * 20_000
    rows = [("a", None), ("b", ""), ("c", "short"), ("d", long), ("e", long.upper() + "!"), ("e", long.upper() + "!"), ("f", "x" * 80), (None, "y" * 90)]
    frame = spark.createDataFrame(rows, "rec_key string, text string").selectExpr("*", "1 as class_id", "2 as size")
    assert {tuple(r) for r in N.near_duplicates(frame).where("rec_a is not null").collect()} == {("d", "e")}
    assert N.near_duplicates(frame.limit(0)).count() == 0
    assert {r["rec_key"]: r["n_copies"] for r in N.near_duplicate_classes(frame).collect()}["d"] == 2


def told(seed, n):
    """Texts of few phrases and many names, one in five an edit of another."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bdgkpvwxz") + rng.choice("aeiou") + rng.choice("bdgkpvwxz") for _ in range(2))
    phrases = [[" ".join(rng.choice(w) for _ in range(3)) for _ in range(12)] for w in (WORDS[:12], WORDS[12:24], ["это", "город", "зонт", "вечер"])]
    out: list[str] = []
    for _ in range(n):
        if out and rng.random() < 0.2:
            words = rng.choice(out).split()
            for _ in range(rng.randrange(1, 7)):
                words[rng.randrange(len(words))] = name()
            out.append(" ".join(words))
        else:
            phrase = rng.choice(phrases)
            out.append(" ".join(f"{rng.choice(phrase)} {name()} {rng.choice(phrase)} {name()}" for _ in range(rng.randrange(2, 6))))
    return out


def test_common_sequences_share_a_list_without_loss(spark):
    rows = [(f"r{i:03d}", t) for i, t in enumerate(told(4, 260))]
    of = N.members(spark.createDataFrame(rows, "rec_key string, text string"))
    text = {r["class_id"]: r["rec_key"] for r in of.collect()}
    wanted = {p for p in brute(rows) if N.compared(dict(rows)[p[0]]) != N.compared(dict(rows)[p[1]])}
    for least, hot in ((1 << 30, 20_000), (20, 20_000), (3, 20_000), (3, 7)):
        got = [tuple(sorted((text[r[0]], text[r[1]]))) for r in N.class_links(of, least=least, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 30


def joined(texts, least):
    """Rows that are indexed, and pairs of numbers that are compared in full."""
    batch = pa.RecordBatch.from_pydict({"text": texts, "family": [N.family_of(t) for t in texts], "class_no": list(range(len(texts)))})
    cells = next(N.count_cells(iter([batch])))
    sketch = np.zeros(N.COUNTS, np.uint32)
    sketch[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    kinds = N.kinds_of(texts)
    lists = pa.Table.from_batches(N.postings(lambda: (sketch, kinds), 0.6, 20_000, least)(iter([batch]))).sort_by([("key", "ascending"), ("place", "ascending")])
    found = N.join_lists(0.6)(iter(lists.to_batches(max_chunksize=1000)))
    return lists.num_rows, {(a, b) for x in found for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}


def test_lists_and_comparisons_stay_few_where_all_sequences_are_common():
    texts = sorted({t for t in map(N.compared, told(8, 3000)) if len(t) >= N.MIN_LENGTH})
    rows, compared = joined(texts, N.LEAST_COMMON)
    plain_rows, plain = joined(texts, 1 << 30)
    sets = [set(N.sequences(t).tolist()) for t in texts]
    near = {(a, b) for a, b in plain if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-12}
    assert len(near) > 300 and near <= compared <= plain
    assert len(compared) < 1.5 * len(near) and rows < 0.5 * plain_rows


def test_odd_sets_in_a_shared_list():
    assert (N.kinds_of([]) == N.TOPICS).all() and (N.kinds_of(["", "a"]) == N.TOPICS).all() and N.kinds_of(["abc" * 30] * 3).min() == 0
    long = N.compared(" ".join(told(5, 400)))
    texts = [long, long[:-9], long[40:] + "xyzzyx", *({N.compared(t) for t in told(6, 200)})]
    assert {(0, 1), (0, 2), (1, 2)} <= joined(texts, 2)[1]
    points = np.random.default_rng(1).integers(0, 9, (1000, 3))
    assert sorted(N.boxed(points, 64).tolist()) == list(range(1000))


def test_only_texts_that_are_long_when_compared_are_kept():
    assert N.compared_if_long(None) == "" and N.compared_if_long("a " * 79) == "a" * 79 and N.compared_if_long("a" * 79) == ""
    for text in ("ﷺ" * 6, "A-" * 80, "İ" * 40, "ß" * 80, "½" * 40, "x" * 81):
        assert (N.compared_if_long(text) == N.compared(text)) or len(N.compared(text)) < N.MIN_LENGTH
    assert len(N.compared_if_long("ﷺ" * 6)) >= N.MIN_LENGTH
