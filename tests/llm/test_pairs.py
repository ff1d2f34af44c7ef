"""Each defect, what looks like one, and odd rows."""

import json
import random

import regex

from cuelattice.llm import pairs as P
from cuelattice.llm.langmodel import LANGUAGES
from tests.llm.fixture import PHRASES, documents, models, sentence

S, G = sentence("en", 0, 0, 1), sentence("de", 0, 0, 1)


def defects(*cases):
    judge = P.Judge(models(), P.WordBook(documents()))
    return judge.lines([(s, a, LANGUAGES.index(t) if t else -1) for s, a, t in cases])


def test_good_answers_have_no_defect():
    cases = [(sentence(a, 0, 1, 2), sentence(b, 0, 1, 2), b) for a in PHRASES for b in PHRASES]
    assert defects(*cases) == [None] * len(cases)


def test_defects():
    assert defects((S, None, "de"), (S, "", "de"), (S, "​ …", "de")) == ["empty"] * 3
    refusals = ["I cannot translate this content.", "Es tut mir leid, aber ich kann diesen Text nicht übersetzen.", "Je ne peux pas traduire ce texte.", "この内容は翻訳できません。", "抱歉，我無法翻譯這段內容。", "번역할 수 없습니다.", "Я не могу перевести этот текст.", "No puedo traducir este contenido."]
    assert defects(*[(S, r, "de") for r in refusals]) == ["refusal"] * len(refusals)
    assert defects((S, S, "de"), (S, f"“{S.upper()}”", "de"), (S, f"Translation: {S}", "de"), (S, "  " + S.rstrip(".") + " ", "de")) == ["copy"] * 4
    assert defects((S, sentence("fr", 0, 0, 1), "de"), (S, sentence("ru", 0, 0, 1), "de")) == ["wrong_language"] * 2
    assert defects((S, G[:-8], "de"), (S + " " + S, G, "de"), (S, G[: len(G) // 2], "de")) == ["truncated"] * 3


def test_what_is_no_defect():
    assert defects((S, S, "en"), ("Menu", "Menu", "de"), ("No. 7", "No. 7", "de"), (S.rstrip("."), G.rstrip("."), "de"), (S + " ★", G + " ★", "de")) == [None] * 5
    said = "I cannot translate this content."
    assert defects((said, "Ich kann diesen Inhalt nicht übersetzen.", "de"))[0] != "refusal"
    assert defects(("I'm sorry, I can't help you carry the piano.", "Es tut mir leid, ich kann dir nicht helfen.", "de"))[0] != "refusal"


LEADS = ["", "Translation: ", "Here is the answer: ", "Sure! ", "翻訳結果は以下の通りです：", "As you asked, this is what the line says when it is put into the other language, word by word and without any change at all: "]


def test_no_copy_is_lost_at_any_length():
    rng = random.Random(3)
    for lang in PHRASES:
        words = [w for k in range(4) for w in sentence(lang, k, k, k).rstrip(".。").split()]
        letters = "".join(words)
        for _ in range(2000):
            if rng.random() < 0.5:
                line = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
            else:
                line = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 40)))
            answer = rng.choice(LEADS) + rng.choice([line, line.upper(), f"“{line}”", line + "."])
            assert P.is_copy(line, answer), (line, answer)


def test_compression_of_long_and_repetitive_copies():
    rng = random.Random(4)
    lines = [sentence("ru", rng.randrange(4), rng.randrange(4), rng.randrange(4)) * n for n in (1, 40, 3000)] + ["la " * 400, "a" * 300_000, "Ha ha ha ha ha ha ha!", "木の箱を売る人"]
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüабвгд") for _ in range(500_000))
    for line in [*lines, noise]:
        for lead in LEADS:
            assert P.is_copy(line, lead + line)
        assert not P.is_copy(line, line[:-1] + "x")


def test_compression_sets_other_answers_apart():
    sources = [sentence("en", a, b, c) for a in range(4) for b in range(4) for c in range(4)]
    apart = [P.copy_bytes(s.encode(), t.encode()) > P.copy_bound(len(s)) for s in sources for t in (sentence("de", 0, 1, 2), sentence("ko", 1, 2, 3), s[::-1])]
    assert sum(apart) / len(apart) > 0.95
    assert not P.is_copy("", "x") and not P.is_copy("abc", "") and not P.is_copy("Silver-lining", "Silver-lining again")


def test_short_copies_are_defects():
    lines = ["Silver-lining", "Harbour lights", "The old key box", "Two cups of milk", "Radio towers glow", "A wooden box is sold", "la " * 400, "木の箱を売る人"]
    for source in lines:
        for answer in (source, source.upper(), f"Translation: {source}", f"Here is the translation: “{source}”"):
            assert defects((source, answer, "ru")) == ["copy"], answer


REFUSED = [
    "I am not permitted to render this passage.", "I must skip this one.", "Sorry, but I'm not able to help with that request.", "As an AI, I can't process this text.", "My apologies, this content cannot be translated.",
    "Diese Zeile kann ich leider nicht übertragen.", "Ich muss diese Anfrage ablehnen.", "Als KI darf ich diesen Satz nicht bearbeiten.", "Bedauerlicherweise ist eine Übersetzung nicht möglich.",
    "Je suis désolé, je ne saurais traduire cette phrase.", "Il m'est impossible de traiter cette demande.", "Cette requête ne peut être traitée, je regrette.", "En tant qu'assistant, je préfère ne pas répondre.",
    "Lo siento, no se puede traducir este pasaje.", "Me niego a traducir esta línea.", "Lamentablemente no soy capaz de atender su petición.", "Como modelo de lenguaje, no puedo responder.",
    "К сожалению, перевести эту строку невозможно.", "Я вынужден отказаться от перевода.", "Простите, выполнить этот запрос не получится.", "Как языковая модель, я не могу ответить.",
    "恐れ入りますが、この文の翻訳はお断りいたします。", "ご要望にはお応えできません。", "申し訳ございませんが、対応いたしかねます。", "このテキストを訳すことはできません。",
    "對不起，這個請求我無法處理。", "恕難翻譯此內容。", "很遺憾，這句不便翻譯。", "作為語言模型，我不能提供協助。",
    "죄송하지만 이 문장은 번역이 불가능합니다.", "해당 요청은 거절하겠습니다.", "유감스럽게도 도와드릴 수 없습니다.", "정책상 이 텍스트를 처리할 수 없습니다.",
    "Mi dispiace, non posso tradurre.", "Infelizmente não posso traduzir este texto.", "Het spijt me, ik kan deze tekst niet vertalen.", "Przepraszam, nie mogę przetłumaczyć tego tekstu.", "Tyvärr kan jag inte översätta denna text.", "На жаль, я не можу перекласти цей текст.", "Üzgünüm, bu metni çeviremem.",
]
TOLD = [
    "Der Inhalt ist nicht neu.", "The guidelines were not followed.", "Nicht alle Kisten sind leer.", "He cannot find the key.", "It is impossible to see the harbour from here.", "Il ne peut pas ouvrir la boîte.",
    "Le contenu de la caisse est fragile.", "No se puede cruzar el puente.", "El contenido de la caja es frágil.", "Дверь невозможно открыть.", "Содержание письма неизвестно.", "彼は窓を開けることができない。", "この橋は渡れない。",
    "船長不能離開碼頭。", "箱子的內容沒有人知道。", "문을 열 수 없다.", "상자의 내용은 비밀이다.", "Entschuldigung, wo ist der Hafen?", "I translate letters for a museum.", "Die Anfrage kam gestern.", "申し訳なさそうに彼女は笑った。", "抱歉，我遲到了。", "죄송해요, 늦었어요.", "Lo siento mucho.",
]


def test_refusals_not_seen_before():
    """Held-out sentences, written apart from the dictionaries."""
    neutral = "The old captain repairs his boat."
    found = [P.refuses(neutral, x) for x in REFUSED]
    wrong = [x for x in TOLD if P.refuses(neutral, x)]
    assert sum(found) >= 0.95 * len(found), [x for x, f in zip(REFUSED, found) if not f]
    assert not wrong
    told = [("すみません、ピアノは手伝えません。", "I'm sorry, I can't help you carry the piano."), ("この文は翻訳できません。", "I cannot translate this sentence."), ("Die Anfrage wurde abgelehnt, das tut uns leid.", "Sorry, your request was declined.")]
    assert not any(P.refuses(*x) for x in told)


def test_answers_are_parsed():
    assert P.parse_answer('["a", null]', 2) == (["a", None], False) and P.parse_answer('["a"]', 2) == (["a"], True)
    assert P.parse_answer('```json\n["a"]\n```', 1) == (["a"], False) and P.parse_answer('["a", "b', 2) == (["a", "b"], True)
    assert P.parse_answer('["\\ud800x"]', 1) == (["\ufffdx"], False)
    assert P.parse_answer("x\ny", 2) == (["x", "y"], False) and P.parse_answer("x", 1) == (["x"], False)


def test_frames(spark):
    ask = lambda lines, to="German": json.dumps({"messages": [{"role": "system", "content": f"Translate into {to}."}, {"role": "user", "content": json.dumps(lines)}]})
    tell = lambda x: json.dumps({"choices": [{"message": {"content": x}}]})
    rows = [("ok", ask([S]), tell(json.dumps([G]))), ("none", ask([S]), json.dumps({"choices": []})), ("cut", ask([S, S]), tell(f'["{G}", "{G[:9]}')), ("two", ask([S, S]), tell(json.dumps([G, ""]))), ("null", None, None), ("bad", "{", "{")]
    cache = P.cache_pairs(spark.createDataFrame(rows, "cache_key string, request string, response string"))
    cues = spark.createDataFrame([(1, 1, [S, None], [G, None]), (2, 1, [S], [S]), (3, 7, [S], [G]), (4, 1, None, None), (5, 1, [], []), (6, 1, [S], None)], "cue_id long, video_id long, source_lines array<string>, translated_lines array<string>")
    videos = spark.createDataFrame([(1, "de"), (1, "de"), (2, None)], "video_id long, target_lang string")
    got = P.defective_pairs(P.cue_pairs(cues, videos).unionByName(cache), models(), P.WordBook(documents())).collect()
    assert {tuple(r) for r in got} == {("l:none", "empty"), ("l:cut", "truncated"), ("l:two", "empty"), ("l:null", "empty"), ("l:bad", "empty"), ("c:1:2", "empty"), ("c:2:1", "copy"), ("c:6:1", "empty")}
    assert P.defective_pairs(cache.limit(0), models(), P.WordBook(documents())).count() == 0


def test_without_models_or_words():
    from cuelattice.llm.langmodel import fit

    judge = P.Judge(fit([]), P.WordBook([]))
    assert judge.lines([(S, "", 0), (S, "I cannot translate this content.", 1), (S, G, 1)])[:2] == ["empty", "refusal"]


def test_texts_of_a_batch_are_taken_apart_together(monkeypatch):
    """By a few passes over all of them, with what the expressions find in each."""
    rng = random.Random(5)
    signs = list("aB éß.!?…。！？\n\t　\"')」』](«²³½①7٣\u0301\u200b木箱のカ한글Σσς-–★♪ \x1c\x85\U00020001\U0001f600İŉ,;")
    texts = ["".join(rng.choice(signs) for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9, 20, 60]))) for _ in range(4000)]
    tail = regex.compile(r"(?:[\s\p{P}\p{S}\p{No}\p{Cf}]|\s\p{L}?\p{No}+)+$")
    sentences = regex.compile(rf"[{regex.escape(P.MARKS)}]+(?=[\s{regex.escape(P.CLOSERS)}]|$|[^\p{{ASCII}}])")
    word = regex.compile(r"[\p{L}\p{M}]+")
    got, words = P.Shapes(texts), []
    for k, t in enumerate(texts):
        end = t[len(tail.sub("", t)) :]
        seen = (got.letters[k], got.said[k], got.sentences[k], t[got.tail[k] :], got.closed[k])
        assert seen == (sum(map(len, word.findall(t))), bool(P.SAID.search(t)), len(sentences.findall(t)), end, any(x in P.MARKS for x in end)), t
        found = word.findall(t.lower())
        words.append([x for w in found for x in ([w[i : i + 2] for i in range(max(1, len(w) - 1))] if "⺀" <= w[0] <= "鿿" or "\U00020000" <= w[0] else [w])])
    cut, many = P.cut_words([t.lower() for t in texts])
    assert cut == [w for x in words for w in x] and many.tolist() == list(map(len, words))
    assert P.canonical([t.casefold() for t in texts]) == ["".join(regex.findall(r"[\p{L}\p{M}\p{N}]+", t.casefold())).encode() for t in texts]
    passes, cut_words = [], P.cut_words
    judge = P.Judge(models(), P.WordBook(documents()))
    monkeypatch.setattr(P, "cut_words", lambda x: passes.append(len(x)) or cut_words(x))
    judge.lines([(sentence("en", k, k // 4, k // 16), sentence("de", k, k // 4, k // 16), 1) for k in range(64)])
    assert passes == [64, 64]
    pairs = [(S, x, 1) for x in (G, "", S, G[:-8], G + " " + G)]
    whole = judge.lines(pairs)
    monkeypatch.setattr(P, "AT_ONCE", len(S) + len(G))
    assert judge.lines(pairs) == whole and whole[1:4] == ["empty", "copy", "truncated"] and judge.lines([]) == []
