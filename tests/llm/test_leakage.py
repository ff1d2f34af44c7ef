"""Leaks against a scan for common substrings."""

import random

from cuelattice.llm import leakage as K

WORDS = {"en": ["baker", "window", "carries", "silver", "umbrella", "quietly", "before", "harbour", "stone", "letter", "garden", "museum"], "ja": list("漁師銀鍵箱窓橋庭師船長糸巻壊見知破手紙黄色古地図真鍮")}


def passage(rng, lang, n):
    return (" " if lang == "en" else "").join(rng.choice(WORDS[lang]) for _ in range(n))


def brute(docs, items):
    out = set()
    for d, text in docs:
        t = K.letters_of(text)
        for i, item, lang in items:
            n, s = (20 if lang in ("ja", "zh", "ko") else 40), K.letters_of(item)
            if any(s[k : k + n] in t for k in range(len(s) - n + 1)):
                out.add((d, i))
    return out


def found(docs, items, kind="run"):
    rows = K.leaked_items(docs, items).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in rows}) == len(rows)
    return {(r["doc_id"], r["item_id"]) for r in rows if r["kind"] == kind}


def test_whole_part_and_disguised_leaks(spark):
    rng = random.Random(2)
    items = [(i, passage(rng, lang, 30 if lang == "en" else 90), lang, "s") for i, lang in enumerate(["en"] * 6 + ["ja"] * 6, 1)]
    docs = []
    for d in range(1, 120):
        lang = rng.choice(["en", "ja"])
        text = passage(rng, lang, 60)  # an item of one language may lie in a text of another
        if rng.random() < 0.5:
            item = rng.choice(items)[1]
            low = rng.randrange(len(item) // 2)
            part = item[low : low + rng.randrange(20, len(item))]
            part = rng.choice([part, part.upper(), "​".join(part), part.replace(" ", "  -")])
            text = text[: len(text) // 2] + part + text[len(text) // 2 :]
        docs.append((d, text))
    frame = spark.createDataFrame(docs + [(500, None), (501, ""), (502, "short")], "doc_id long, text string").selectExpr("*", "1 as letters", "2 as item_id")
    got = found(frame, spark.createDataFrame(items, "item_id long, text string, lang string, suite string"))
    want = brute(docs, [x[:3] for x in items])
    assert got == want and len(want) > 20


def test_shortest_runs_at_all_offsets(spark):
    rng = random.Random(5)
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    latin = list("abcdefghijklmnopqrstuvwxyz")
    noise = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    items = [(1, noise(han, 60), "ja"), (2, noise(latin, 120), "en")]
    docs = []
    for text, letters, n in [(items[0][1], han, 20), (items[1][1], latin, 40)]:
        for low in range(len(text) - n + 1):
            docs.append((len(docs), noise(letters, rng.randrange(70)) + text[low : low + n] + noise(letters, rng.randrange(70))))
    # what every document holds weighs next to nothing, so the run does not show in a cosine
    usual = items[0][1][20:40]
    docs = [(d, f"{text}{noise(han, 15)}{usual}{noise(han, 15)}") for d, text in docs]
    near = [(len(docs) + k, noise(han, 30) + items[0][1][k : k + 19] + noise(han, 30)) for k in range(40)]
    frame = spark.createDataFrame(docs + near, "doc_id long, text string")
    got = found(frame, spark.createDataFrame(items, "item_id long, text string, lang string"))
    assert got == brute(docs + near, items) and len(got) >= 41 + 2 * 81


def test_odd_tables(spark):
    items = spark.createDataFrame([(1, "a" * 50, "en"), (2, None, None), (3, "kurz", "de")], "item_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "b " + "A" * 60_000), (1, "b " + "A" * 60_000), (2, "c" * 100)], "doc_id long, text string")
    assert [tuple(r)[:2] for r in K.leaked_items(docs, items).collect()] == [(1, 1)]
    assert K.leaked_items(docs.limit(0), items).count() == 0 and K.leaked_items(docs, items.limit(0)).count() == 0


def test_runs_of_mixed_scripts(spark):
    rng = random.Random(12)
    han, latin = [chr(c) for c in range(0x4E00, 0x4E00 + 2000)], list("abcdefghijklmnopqrstuvwxyz")
    noise = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    items = [(1, noise(latin, 90), "en"), (2, noise(han, 60), "zh"), (3, noise(han, 30) + noise(latin, 30) + noise(han, 30), "ja"), (4, noise(han, 50), "en")]
    docs = []
    for d in range(160):
        around, item = rng.choice([han, latin]), rng.choice(items)
        n = rng.choice([19, 20, 25, 39, 40, 45])
        low = rng.randrange(len(item[1]) - n)
        docs.append((d, noise(around, rng.randrange(300)) + item[1][low : low + n] + noise(around, rng.randrange(300))))
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, lang string"))
    assert got == brute(docs, items) and len(got) > 50


def test_long_texts_in_pieces_and_items_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(i, "".join(rng.choice(letters) for _ in range(100)), "en") for i in range(7)]
    long = list("".join(rng.choice(letters) for _ in range(1_300_000)))
    places = [0, 399_975, 400_100, 799_999 - 20, 1_000_000, 1_300_000 - 41]
    for k, at in enumerate(places):
        long[at : at + 40] = items[k][1][k : k + 40]
    docs = spark.createDataFrame([(1, "".join(long)), (2, items[6][1][:39])], "doc_id long, text string")
    monkeypatch.setattr(K, "BLOCK_LETTERS", 250)
    assert len(list(K.item_blocks(spark.createDataFrame(items, "item_id long, text string, lang string")))) == 4
    assert found(docs, spark.createDataFrame(items, "item_id long, text string, lang string")) == {(1, k) for k in range(len(places))}


def test_paraphrases(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abdefgiklmnoprstuvz") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(50)), "en") for i in range(20)]
    docs, want = [], set()
    for d in range(200):
        body = text(80)
        if d % 2:
            item, told = items[rng.randrange(20)], []
            for k, word in enumerate(item[1].split()):
                told.append(rng.choice(words) if k % 5 == 4 else word)  # no 40 letters stay together
            body[40:40] = told
            want.add((d, item[0]))
        docs.append((d, " ".join(body)))
    frame, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, lang string")
    runs, told = found(frame, held), found(frame, held, "paraphrase")
    assert not told - want and len(told | (runs & want)) >= 0.95 * len(want)


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert K.common_subsequence(a, b) == best[-1][-1]
