"""Problem 3: unusable answers to source lines, each with its kind of defect.

* empty: nothing, or no letter or digit.
* refusal: by scored dictionaries: words of declining, being unable, translating, requests and the
  like, in many languages, weigh in once a kind; an answer counts where it scores in one language
  what a refusal does and the source says nothing of the kind.
* copy: each answer is compressed with its source as zstandard dictionary, both in canonical form.
  Without its lead-in the answer takes next to nothing where it gives the source back, at any length
  of the two, so a bound on its size (copy_bound) picks the candidates; letters are compared then.
* wrong_language: by a dictionary of words (sequences of two letters in languages without blanks)
  of each language; where it knows too few of a text's words the character models decide.
* truncated: fewer sentences than the source, a broken list, or an end that the terminal-context
  model of the target language does not know as a sentence's end.

Of several defects the first of this order counts. Defined results: null sources have no language
and only give empty or refusal; pairs without a known target language are judged without it;
texts of any length are judged whole; equal pairs are judged once a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.langmodel import DENSE, LANGUAGES, Models, folded
from cuelattice.llm.plainform import N, encode, plain_list

DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")
# By language, words of declining (D), being unable (N) and able (A), translating (T), serving (S),
# requests and their texts (O), the one who answers (M), being sorry (R). Words of spaced scripts stand for all that begin so.
REFUSAL_WORDS = {
    "en": {
        "D": ["i can't", "i cannot", "i can not", "i'm unable", "i am unable", "i won't", "i will not", "i'm not able", "i am not able", "i'm not permitted", "i am not permitted", "i'm not allowed", "i am not allowed",
              "i must decline", "i have to decline", "i decline", "i must refuse", "i refuse", "i must skip", "i have to skip", "i'd rather not", "i would rather not", "i'm not comfortable", "i am not comfortable",
              "we can't", "we cannot", "we are unable", "we're unable", "i couldn't", "i could not", "i'm declining", "not something i can", "against my", "i don't feel comfortable", "i do not feel comfortable"],
        "N": ["cannot", "can't", "can not", "unable", "not able", "not possible", "impossible", "not permitted", "not allowed", "won't", "declined", "refused", "unavailable", "not available"],
        "T": ["translat", "render", "localis", "localiz"],
        "S": ["help", "assist", "comply", "provide", "process", "fulfil", "answer", "handle"],
        "O": ["this content", "that content", "the content", "this text", "that text", "this one", "this line", "this passage", "this sentence", "this material", "request", "guideline", "polic", "prompt"],
        "M": ["as an ai", "as an assistant", "language model", "ai model", "ai assistant"],
        "R": ["sorry", "apolog", "unfortunately", "regret", "afraid"],
    },
    "de": {
        "D": ["weigere", "lehne ab", "verweigere", "muss ablehnen", "ablehnen muss", "ablehnen müssen", "bin nicht in der lage", "außerstande", "darf ich nicht", "kann ich nicht", "ist mir nicht möglich"],
        "N": ["nicht", "kein", "unmöglich", "ablehn", "abgelehnt", "verweiger"],
        "A": ["ich kann", "kann ich", "ich darf", "darf ich", "ich werde", "werde ich", "ich möchte", "wir können", "können wir", "ist mir", "mir ist", "lässt sich"],
        "T": ["übersetz", "übertrag"],
        "S": ["helfen", "weiterhelfen", "behilflich", "bearbeit", "beantwort", "erfüllen", "nachkommen", "anbieten"],
        "O": ["diesen text", "dieser text", "diesen inhalt", "dieser inhalt", "dieses inhalt", "inhalt", "anfrage", "diese zeile", "diesen satz", "diese passage", "richtlinie", "bitte nicht"],
        "M": ["als ki", "sprachmodell", "als assistent"],
        "R": ["tut mir leid", "tut uns leid", "leider", "entschuldig", "bedaure", "bedauer", "verzeih", "schade"],
    },
    "fr": {
        "D": ["je ne peux pas", "je ne peux", "je ne puis", "je ne saurais", "je refuse", "je dois refuser", "je dois décliner", "je décline", "je ne suis pas en mesure", "je ne suis pas autoris", "je ne suis pas capable", "m'est impossible", "nous ne pouvons pas", "je préfère ne pas"],
        "N": ["ne peux pas", "ne peut pas", "ne peut être", "impossible", "pas en mesure", "pas possible", "refus"],
        "T": ["tradui", "traduc"],
        "S": ["aider", "assister", "répondre", "traiter", "fournir", "donner suite"],
        "O": ["ce texte", "ce contenu", "cette demande", "votre demande", "contenu", "demande", "requête", "cette phrase", "cette ligne", "ce passage", "consigne", "directive", "règles"],
        "M": ["en tant qu'ia", "en tant qu'intelligence", "en tant qu'assistant", "en tant que modèle", "modèle de langage"],
        "R": ["désolé", "navré", "malheureusement", "regrette", "pardon"],
    },
    "es": {
        "D": ["no puedo", "no podré", "no me es posible", "me niego", "debo negarme", "debo rechazar", "tengo que rechazar", "rechazo", "no estoy autoriz", "no estoy en condiciones", "no soy capaz", "me resulta imposible", "no podemos", "prefiero no"],
        "N": ["no se puede", "no es posible", "imposible", "incapaz", "no está permitid"],
        "T": ["traduc", "traduz"],
        "S": ["ayudar", "asistir", "responder", "procesar", "atender", "proporcionar", "cumplir"],
        "O": ["este texto", "este contenido", "esta solicitud", "su solicitud", "tu solicitud", "contenido", "solicitud", "petición", "esta frase", "esta línea", "este pasaje", "directric", "políticas", "normas"],
        "M": ["como ia", "como modelo", "modelo de lenguaje", "como asistente"],
        "R": ["lo siento", "lamento", "lamentablemente", "disculp", "perdón", "desgraciadamente"],
    },
    "ru": {
        "D": ["не могу", "не смогу", "не имею возможности", "не вправе", "не имею права", "не буду", "отказываюсь", "вынужден отказ", "вынуждена отказ", "я не в состоянии", "не в силах", "мы не можем", "мне не разреш"],
        "N": ["невозможно", "не в состоянии", "отказ", "нельзя", "не может быть", "не удастся", "не получится", "не разрешено"],
        "T": ["перевод", "перевест", "перевож", "переведен", "переведён", "переводит"],
        "S": ["помочь", "выполнить", "обработать", "ответить", "предоставить"],
        "O": ["этот текст", "этого текста", "это содержани", "этого содержани", "содержани", "запрос", "просьб", "эту строку", "эту фразу", "этот фрагмент", "этот материал", "правил"],
        "M": ["как ии", "языковая модель", "языковой модел", "языковую модел", "как ассистент"],
        "R": ["извините", "прошу прощения", "простите", "к сожалению", "сожале"],
    },
    "ja": {
        "D": ["しかね", "いたしかね", "できかね", "致しかね", "お断り", "差し控え", "応じられません", "お応えできません", "お答えできません", "辞退", "控えさせて"],
        "N": ["ません", "ない", "不可能", "不可です"],
        "T": ["翻訳", "訳す", "訳出", "訳せ"],
        "S": ["対応", "手伝", "応じ", "お応え", "お答え", "処理", "提供", "お役に立"],
        "O": ["内容", "この文", "このテキスト", "依頼", "リクエスト", "要望", "要求", "ガイドライン", "ポリシー", "規約", "この行"],
        "M": ["aiとして", "言語モデル", "aiアシスタント", "アシスタントとして"],
        "R": ["申し訳", "すみません", "恐れ入ります", "残念", "ごめん", "あいにく"],
    },
    "zh": {
        "D": ["我無法", "我无法", "我不能", "我沒辦法", "我没办法", "恕難", "恕难", "我拒絕", "我拒绝", "我必須拒絕", "我必须拒绝", "礙難", "碍难", "我們無法", "我们无法", "我不便", "我不可以"],
        "N": ["無法", "无法", "不能", "沒辦法", "没办法", "拒絕", "拒绝", "不可以", "不允許", "不允许", "不便"],
        "T": ["翻譯", "翻译", "譯出", "译出"],
        "S": ["協助", "协助", "幫助", "帮助", "處理", "处理", "提供", "回答", "滿足", "满足", "完成", "配合", "從命", "从命"],
        "O": ["這段", "这段", "此內容", "此内容", "該內容", "该内容", "內容", "内容", "請求", "请求", "要求", "此文", "這句", "这句", "準則", "准则", "政策", "規定", "规定"],
        "M": ["作為ai", "作为ai", "作為一個ai", "作为一个ai", "語言模型", "语言模型", "人工智慧助", "人工智能助"],
        "R": ["抱歉", "對不起", "对不起", "遺憾", "遗憾", "可惜", "不好意思"],
    },
    "ko": {
        "D": ["거절하", "거부하", "거절합", "거부합", "양해 부탁", "삼가", "해 드릴 수 없", "해드릴 수 없", "드릴 수 없", "응할 수 없"],
        "N": ["수 없", "수가 없", "없습니다", "없어요", "못", "불가능", "불가합", "어렵습니다", "거절", "거부", "허용되지"],
        "T": ["번역", "옮길 수"],
        "S": ["도와", "도움", "처리", "수행", "제공", "응답", "답변", "이행"],
        "O": ["이 내용", "해당 내용", "이 문장", "해당 문장", "이 텍스트", "해당 텍스트", "이 글", "요청", "부탁", "지침", "정책", "가이드라인"],
        "M": ["ai로서", "인공지능으로", "언어 모델", "ai 언어"],
        "R": ["죄송", "미안", "유감", "안타깝", "아쉽"],
    },
    "it": {
        "D": ["non posso", "non potrò", "mi rifiuto", "devo rifiutare", "non sono autorizzat", "non sono in grado", "mi è impossibile", "preferisco non"],
        "N": ["non è possibile", "impossibile", "non si può"], "T": ["tradur", "traduz", "tradott"], "S": ["aiutar", "rispondere", "fornire", "soddisfare"],
        "O": ["questo testo", "questo contenuto", "contenuto", "richiesta", "questa frase"], "M": ["come ia", "modello linguistico"], "R": ["mi dispiace", "spiacente", "purtroppo", "scusa"],
    },
    "pt": {
        "D": ["não posso", "não poderei", "não consigo", "recuso", "devo recusar", "não estou autorizad", "não sou capaz"],
        "N": ["não é possível", "impossível", "incapaz"], "T": ["traduz", "tradu"], "S": ["ajudar", "responder", "fornecer", "atender"],
        "O": ["este texto", "este conteúdo", "conteúdo", "solicitação", "pedido", "esta frase"], "M": ["como ia", "modelo de linguagem"], "R": ["desculp", "lamento", "infelizmente", "sinto muito"],
    },
    "nl": {
        "D": ["kan ik niet", "ik weiger", "moet ik weigeren", "ben niet in staat", "mag ik niet"],
        "N": ["niet", "onmogelijk", "geen"], "A": ["ik kan", "ik mag", "ik zal", "ik wil"], "T": ["vertal", "vertaling"], "S": ["helpen", "beantwoorden", "voldoen"],
        "O": ["deze tekst", "deze inhoud", "inhoud", "verzoek", "deze zin", "richtlijn"], "M": ["als ai", "taalmodel"], "R": ["het spijt me", "sorry", "helaas", "excuses"],
    },
    "pl": {
        "D": ["nie mogę", "nie jestem w stanie", "odmawiam", "muszę odmówić", "nie wolno mi"],
        "N": ["nie można", "niemożliwe", "nie da się"], "T": ["tłumacz", "przetłumacz"], "S": ["pomóc", "odpowiedzieć", "spełnić"],
        "O": ["tego tekstu", "ten tekst", "tej treści", "treści", "prośb", "żądani", "zasad"], "M": ["jako ai", "model językow"], "R": ["przepraszam", "przykro mi", "niestety"],
    },
    "sv": {
        "D": ["kan jag inte", "jag vägrar", "jag måste avböja"], "N": ["inte", "omöjligt"], "A": ["jag kan", "jag får", "jag vill"], "T": ["översätt"], "S": ["hjälpa", "svara"],
        "O": ["denna text", "den här texten", "innehåll", "begäran", "riktlinj"], "M": ["som ai", "språkmodell"], "R": ["tyvärr", "ledsen", "förlåt"],
    },
    "uk": {
        "D": ["не можу", "не зможу", "відмовляюс", "змушений відмов", "не маю права"], "N": ["неможливо", "відмов"], "T": ["переклад", "перекласти"], "S": ["допомогти", "виконати"],
        "O": ["цей текст", "цього тексту", "вміст", "запит", "правил"], "M": ["мовна модель", "як ші"], "R": ["вибачте", "перепрошую", "на жаль"],
    },
    "tr": {
        "D": ["çeviremem", "yapamam", "reddediyorum", "reddetmek zorunda"], "N": ["mümkün değil", "imkansız", "edemiyorum", "yapamıyorum", "çeviremiyorum"], "T": ["çevir", "tercüme"], "S": ["yardımcı", "yardım"],
        "O": ["bu metni", "bu içeri", "içerik", "talep", "istek"], "M": ["yapay zeka", "dil modeli"], "R": ["üzgünüm", "maalesef", "özür"],
    },
}
#: What a kind of words weighs, once an answer; D stands for N and A together, so they do not add to it.
WEIGHTS = {"D": 2, "N": 1, "A": 1, "T": 2, "S": 1, "O": 1, "M": 2, "R": 1}
#: Weight of a refusal, and of the kinds that its source does not have.
REFUSAL, BEYOND = 3, 2
# Names of the languages in requests.
NAMES = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "russian": "ru", "japanese": "ja", "traditional chinese": "zh",
    "simplified chinese": "zh", "chinese": "zh", "korean": "ko",
}
MARKS = ".!?…。！？"
CLOSERS = "\"'”’»」』)）]"
FENCE = regex.compile(r"^```\w*\s*|\s*```$")
SAID = regex.compile(r"[\p{L}\p{N}]")
SIGN = regex.compile(r"[^\p{L}\p{P}]")
HALVES = regex.compile("[\ud800-\udfff]")
#: Bytes that a source given back takes at most, and that share of its own besides; measured ones take 8 to 19, and 12 in each block of 128 KB.
COPY_BYTES, COPY_SHARE = 32, 1 / 64
LEVEL = 19
#: A context that ends sentences less often than this is no sentence's end.
UNFINISHED, UNLIKELY = 0.02, 0.6
#: An answer without the source's final mark and with less than this share of the letters to be expected stops early.
SHORT = 0.7
KNOWN_WORDS = 0.5
#: Pairs are judged together up to so many characters, so that long texts don't fill the memory.
AT_ONCE = 4_000_000


#: Classes of code points, a bit each.
CLASSES = {
    "word": r"[\p{L}\p{M}]+", "number": r"\p{N}+", "letter": r"\p{L}+", "other_number": r"\p{No}+", "blank": r"\s+", "beside": r"[\s\p{P}\p{S}\p{No}\p{Cf}]+",
    "mark": rf"[{regex.escape(MARKS)}]+", "after": rf"(?:[\s{regex.escape(CLOSERS)}]|[^\p{{ASCII}}])+",
}
WORDS, NUMBER, LETTER, OTHER_NUMBER, SPACE, BESIDE, MARK, AFTER = (1 << k for k in range(len(CLASSES)))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The classes of all code points; made once per Python worker."""
    every = np.arange(N, dtype="<u4")
    every[0xD800:0xE000] = 0xFFFD  # halves of characters
    text, made = every.tobytes().decode("utf-32-le"), np.zeros(N, np.uint8)
    for k, pattern in enumerate(CLASSES.values()):
        for found in regex.finditer(pattern, text):
            made[found.start() : found.end()] |= 1 << k
    made[0xD800:0xE000] = 0
    return made


def rows_of(texts: list[str], between: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the row starts in them (rows + 1 values); what stands between two texts ends the row of the first."""
    cps = np.frombuffer(between.join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + len(between))))
    starts[-1] = len(cps)
    return cps, starts


def per_row(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the positions found, in order, each row has."""
    return np.diff(np.searchsorted(found, starts))


class Shapes:
    """What plain texts are made of, a value each: letters (and marks), said (letters or digits), sentences, tail (where only signs and numbers follow), closed (whether those hold a sentence's end)."""

    def __init__(self, texts: list[str]):
        cps, starts = rows_of(texts)
        kind = classes()[cps]
        first = np.zeros(len(cps) + 1, bool)
        first[starts] = True
        self.letters = per_row(np.flatnonzero(kind & WORDS), starts)
        self.said = per_row(np.flatnonzero(kind & (LETTER | NUMBER)), starts) > 0
        # a letter may stand between a blank and a number
        beside, mark = (kind & BESIDE) > 0, (kind & MARK) > 0
        if len(cps):
            amid = np.flatnonzero(((kind[1:-1] & LETTER) > 0) & ((kind[:-2] & SPACE) > 0) & ((kind[2:] & OTHER_NUMBER) > 0)) + 1
            beside[amid[~first[amid] & ~first[amid + 1]]] = True
        apart, ends = np.flatnonzero(~beside), np.flatnonzero(mark)
        last = np.searchsorted(apart, starts[1:]) - 1
        tail = np.maximum(starts[:-1], np.where(last >= 0, apart[last] + 1, 0) if len(apart) else 0)
        self.tail = tail - starts[:-1]
        self.closed = np.searchsorted(ends, starts[1:]) > np.searchsorted(ends, tail)
        # marks in a row end one sentence where one of them is followed by a blank, a closing sign, a letter beyond ASCII or nothing
        opens = mark & first[:-1]
        opens[1:] |= mark[1:] & ~mark[:-1]
        run = np.cumsum(opens)
        ending = ends[first[ends + 1] | ((kind[np.minimum(ends + 1, max(0, len(cps) - 1))] & AFTER) > 0)]
        ending = ending[np.append(True, run[ending][1:] != run[ending][:-1])[: len(ending)]]
        self.sentences = per_row(ending, starts)


@lru_cache(maxsize=1)
def refusal_words() -> ahocorasick.Automaton:
    """All words of refusing in one automaton, each with its languages and kinds."""
    found: dict[str, set[tuple[str, str]]] = {}
    for lang, kinds in REFUSAL_WORDS.items():
        for kind, words in kinds.items():
            for word in words:
                found.setdefault(word, set()).add((lang, kind))
    made = ahocorasick.Automaton()
    for word, of in found.items():
        made.add_word(word, (len(word), word[0] < "⺀" and word[0].isalpha(), tuple(of)))
    made.make_automaton()
    return made


def refusal_kinds(text: str) -> dict[str, set[str]]:
    """The kinds of words of refusing in a text, by language."""
    low = text.casefold().replace("’", "'")
    kinds: dict[str, set[str]] = {}
    for end, (length, spaced, of) in refusal_words().iter(low):
        at = end - length
        if spaced and at >= 0 and low[at].isalpha():
            continue  # inside a word
        for lang, kind in of:
            kinds.setdefault(lang, set()).add(kind)
    return kinds


def weight_of(kinds: set[str]) -> int:
    return sum(WEIGHTS[k] for k in kinds) - (sum(WEIGHTS[k] for k in kinds & {"N", "A"}) if "D" in kinds else 0)


def refuses(source: str, answer: str) -> bool:
    """Whether an answer, in one language, says what a refusal does, names what it refuses, and its source says much less of it."""
    likely = [k for k in refusal_kinds(answer).values() if k & {"D", "N"} and k & {"T", "O", "M", "S"} and weight_of(k) >= REFUSAL]
    if not likely:
        return False
    said: set[str] = set().union(*refusal_kinds(source).values())
    if said & {"D", "N"}:
        said |= {"D", "N", "A"}
    return any(weight_of(k - said) >= BEYOND for k in likely)


def canonical(folded_texts: list[str]) -> list[bytes]:
    """Letters, marks and digits of case-folded texts in UTF-8."""
    cps, starts = rows_of(folded_texts)
    keep = np.flatnonzero(classes()[cps] & (WORDS | NUMBER))
    return encode(cps[keep], np.searchsorted(keep, starts)).cast(pa.large_binary()).to_pylist()


@lru_cache(maxsize=1 << 12)
def copy_params(window: int, end: int, source: int) -> zstandard.ZstdCompressionParameters:
    options = {"window_log": window, "write_checksum": False, "write_content_size": False, "write_dict_id": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}
    return zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=end, dict_size=source, **options)


def copy_bytes(source: bytes, answer: bytes) -> int:
    """Size of an answer without its lead-in, the end that is as long as the source, compressed with the source as dictionary.

    A lead-in is compressed apart from it, as its letters would change how those after it are coded.
    """
    end = answer[max(0, len(answer) - len(source)) :]
    window = min(27, max(10, (len(source) + len(end) + 64).bit_length()))
    params = copy_params(window, len(end), len(source))
    known = zstandard.ZstdCompressionDict(source, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(source) >= 8 else None  # shorter ones are no dictionary
    return len(zstandard.ZstdCompressor(compression_params=params, dict_data=known).compress(end))


def copy_bound(size: int) -> int:
    """What copy_bytes is at most for a source of so many bytes that is given back."""
    return COPY_BYTES + int(COPY_SHARE * size)


def is_copy(source: str, answer: str) -> bool:
    """Both in plain form: the source is all of the answer but a lead-in of any length."""
    return gives_back(*canonical([source.casefold(), answer.casefold()]))


def gives_back(source: bytes, answer: bytes) -> bool:
    """is_copy of canonical forms."""
    if not source or len(answer) < len(source):
        return False
    return copy_bytes(source, answer) <= copy_bound(len(source)) and answer.endswith(source)


def cut_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Words of all texts in order, and how many each text has; words that begin with a Han letter or kana as sequences of two letters."""
    cps, starts = rows_of(texts, "\n")
    inside = (classes()[cps] & WORDS) > 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    heads, lengths = edges[::2], edges[1::2] - edges[::2]
    one = cps[heads]
    dense = (one >= 0x2E80) & (one <= 0x9FFF) | (one >= 0x20000)
    out, many = np.where(inside, cps, np.uint32(0x20)), np.ones(len(heads), np.int64)
    if dense.any():
        many[dense] = np.maximum(1, lengths[dense] - 1)
        within = np.zeros(len(cps), bool)
        within[inside] = np.repeat(dense, lengths)
        within[heads] = within[heads + lengths - 1] = False
        # letters between the first and the last one end a sequence and begin the next
        times = np.where(within, 3, 1)
        upto = np.cumsum(times)
        out = np.repeat(out, times)
        out[upto[within] - 2] = 0x20
    upto = np.concatenate(([0], np.cumsum(many)))
    return np.ascontiguousarray(out, "<u4").tobytes().decode("utf-32-le").split(), np.diff(upto[np.searchsorted(heads, starts)])


class WordBook:
    """Words of each language with their share in it; sequences of two letters for dense scripts."""

    def __init__(self, sample: list[tuple[str, str]]):
        counts: dict[str, np.ndarray] = {}
        for lang, text in sample:
            at = LANGUAGES.index(lang)
            for word in self.words(plain_list([text])[0].lower()):
                if word not in counts:
                    counts[word] = np.zeros(len(LANGUAGES), np.float32)
                counts[word][at] += 1
        self._weigh(counts, sum(counts.values(), np.zeros(len(LANGUAGES), np.float32)))

    @classmethod
    def counted(cls, parts: DataFrame) -> WordBook:
        """parts: lang (index), word, n of all texts, summed up here."""
        of = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"l{k}") for k in range(len(LANGUAGES))]
        rows = parts.groupBy("word").agg(*of, F.sum("n").alias("total")).where("total > 1").toArrow()
        counts = np.stack([rows.column(f"l{k}").to_numpy() for k in range(len(LANGUAGES))], 1).astype(np.float32)
        made = cls([])
        total = {r["lang"]: r["n"] for r in parts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        made._weigh(dict(zip(rows.column("word").to_pylist(), counts)), np.array([total.get(k, 0) for k in range(len(LANGUAGES))], np.float32))
        return made

    def _weigh(self, counts: dict[str, np.ndarray], total: np.ndarray) -> None:
        total = np.maximum(1.0, total)
        # words met once are names more often than words
        often = {w: c for w, c in counts.items() if c.sum() > 1}
        self.place = {w: k for k, w in enumerate(often)}
        self.table = np.log((np.stack([*often.values()]) + 0.02) / total) if often else np.zeros((0, len(LANGUAGES)), np.float32)

    @property
    def weight(self) -> dict[str, np.ndarray]:
        return {w: self.table[k] for w, k in self.place.items()}

    @staticmethod
    def words(text: str) -> list[str]:
        return cut_words([text])[0]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the score by language, how many words the book knows, and their share."""
        words, many = cut_words([t.lower() for t in texts])
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        of = np.repeat(np.arange(len(texts)), many)[at >= 0]
        values = self.table[at[at >= 0]]
        by_lang = np.stack([np.bincount(of, values[:, k], len(texts)) for k in range(len(LANGUAGES))], 1)
        known = np.bincount(of, minlength=len(texts))
        return by_lang, known, known / np.maximum(1, many)


def whole_characters(text: str) -> str:
    """Without the halves of characters that escapes may leave; they have no code in UTF-8."""
    return HALVES.sub("\ufffd", text)


def parse_answer(content: str | None, n: int) -> tuple[list[str | None], bool]:
    """Answers by line (one for all lines if the content names no lines), and whether a list is cut off."""
    text = FENCE.sub("", (content or "").strip()).strip()
    try:
        found = json.loads(text)
        if isinstance(found, list):
            return [None if x is None else whole_characters(str(x)) for x in found], len(found) < n
    except ValueError:
        pass
    if text.startswith("["):
        body = text[1:]
        if not regex.search(r"\]\s*$", body) or body.count('"') % 2:
            parts = regex.findall(r'"((?:[^"\\]|\\.)*)"?', body)
            return [x.replace('\\"', '"').replace("\\n", "\n") for x in parts], True
    lines = [x for x in text.split("\n") if x.strip()]
    if n > 1 and len(lines) == n:
        return list(lines), False
    return [text], False


class Judge:
    """Defects of batches of pairs; made once per Python worker."""

    def __init__(self, models: Models, book: WordBook):
        self.models, self.book = models, book

    def languages(self, plain: list[str]) -> list[int]:
        by_book, known, share = self.book.scores(plain)
        out = by_book.argmax(1)
        unknown = np.flatnonzero((known == 0) | (share < KNOWN_WORDS))
        if len(unknown):
            codes, starts, _ = folded(pa.array([plain[k] for k in unknown.tolist()], pa.large_string()))
            rows = np.repeat(np.arange(len(unknown)), np.diff(starts))
            score = self.models.score(codes, starts)
            out[unknown] = np.stack([np.bincount(rows, score[:, k], len(unknown)) for k in range(len(LANGUAGES))], 1).argmax(1)
        return out.tolist()

    def lines(self, every: list[tuple[str, str | None, int]]) -> list[str | None]:
        """Defect of each source, answer and index of the target language (-1: unknown)."""
        place = {pair: k for k, pair in enumerate(dict.fromkeys(every))}
        pairs, found, size = list(place), [], 0
        for k, (s, a, _) in enumerate(pairs, 1):
            size += len(s) + len(a or "")
            if size > AT_ONCE or k == len(pairs):
                found += self._distinct(pairs[len(found) : k])
                size = 0
        return [found[place[pair]] for pair in every]

    def _distinct(self, pairs: list[tuple[str, str | None, int]]) -> list[str | None]:
        source = plain_list([s or "" for s, _, _ in pairs])
        answer = plain_list([a or "" for _, a, _ in pairs])
        from_lang, to_lang = self.languages(source), self.languages(answer)
        of_source, of_answer = Shapes(source), Shapes(answer)
        told, given = (x.letters.tolist() for x in (of_source, of_answer))
        canonical_source, canonical_answer = (canonical([t.casefold() for t in x]) for x in (source, answer))
        codes, starts, _ = folded(pa.array([a[:k] for a, k in zip(answer, of_answer.tail.tolist())], pa.large_string()))
        end = self.models.ending(codes, starts, "sentence")
        out: list[str | None] = []
        for k, ((_, _, target), said) in enumerate(zip(pairs, of_answer.said.tolist())):
            s, a = source[k], answer[k]
            if not said:
                out.append("empty")
                continue
            if refuses(s, a):
                out.append("refusal")
                continue
            least = 6 if LANGUAGES[from_lang[k]] in DENSE else 12
            if told[k] < least:
                out.append(None)
                continue
            native = from_lang[k] == target
            copied = gives_back(canonical_source[k], canonical_answer[k])
            if copied:
                out.append(None if native else "copy")
            elif target >= 0 and to_lang[k] not in (target, from_lang[k]) and given[k] >= (3 if LANGUAGES[to_lang[k]] in DENSE else 6):
                out.append("wrong_language")
            else:
                to = target if target >= 0 else to_lang[k]
                expected = told[k] * self.models.sentence[to] / self.models.sentence[from_lang[k]]
                sentences = int(of_answer.sentences[k]) - int(of_source.sentences[k])
                out.append("truncated" if self.stops_early(s, a, sentences, bool(of_source.closed[k]), bool(of_answer.closed[k]), float(end[k, to]), given[k] / expected) else None)
        return out

    @staticmethod
    def stops_early(source: str, answer: str, sentences: int, closing: bool, closed: bool, rate: float, length: float) -> bool:
        """sentences: those of the answer less those of the source; closing, closed: whether source and answer end with one; rate: how often the answer's last letters end a sentence in its language; length: its letters as a share of those to be expected."""
        last = (source.rsplit(None, 1) or [""])[-1]
        if sentences < 0 and closed:
            return True
        # both end in the same sign or mark beside the text, so the answer came to the end
        if SIGN.search(last) and answer.endswith(last):
            return sentences < 0
        if closing and not closed:
            return rate < UNLIKELY or length < SHORT or sentences < -1
        return not closed and rate < UNFINISHED


def lists(column: pa.ListArray) -> Iterator[list[str | None] | None]:
    """Its values as lists; null stays None."""
    values, at = column.flatten().to_pylist(), 0
    for n in column.value_lengths().to_pylist():
        yield None if n is None else values[at : at + n]
        at += n or 0


def judge(load: Callable[[], tuple[Models, WordBook]]) -> Callable:
    """Arrow function: pair_key, target, sources, answers or content -> pair_key, defect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judging = None
        for batch in batches:
            judging = judging or Judge(*load())
            keys = batch.column("pair_key").to_pylist()
            pairs: list[tuple[str, str | None, int]] = []
            owner: list[int] = []
            worst = [len(DEFECTS)] * len(keys)
            for row, (target, sources, answers, content) in enumerate(zip(batch.column("target").to_pylist(), lists(batch.column("sources")), lists(batch.column("answers")), batch.column("content").to_pylist())):
                at = LANGUAGES.index(target) if target in LANGUAGES else -1
                sources = sources or [""]
                broken = False
                if answers is None:
                    if content is None or not SAID.search(content):
                        worst[row] = 0
                        continue
                    answers, broken = parse_answer(content, len(sources))
                    if len(answers) == 1 and len(sources) > 1 and not broken:
                        sources = [" ".join(x or "" for x in sources)]
                    if broken:
                        worst[row] = DEFECTS.index("truncated")
                        answers = answers[:-1] if len(answers) <= len(sources) and answers and not SAID.search(answers[-1] or "") else answers
                for source, answer in zip(sources, answers):
                    pairs.append((source or "", answer, at))
                    owner.append(row)
            if pairs:
                for row, defect in zip(owner, judging.lines(pairs)):
                    if defect is not None:
                        worst[row] = min(worst[row], DEFECTS.index(defect))
            bad = [row for row, w in enumerate(worst) if w < len(DEFECTS)]
            yield pa.RecordBatch.from_arrays([pa.array([keys[r] for r in bad], pa.string()), pa.array([DEFECTS[worst[r]] for r in bad], pa.string())], names=["pair_key", "defect"])

    return run


def defective_pairs(pairs: DataFrame, models: Models, book: WordBook) -> DataFrame:
    """pairs: pair_key, target, sources array<string>, answers array<string> (null: see content), content string."""
    shared = pairs.sparkSession.sparkContext.broadcast((models, book))  # grows with the distinct words and sequences of the documents
    return pairs.select("pair_key", "target", "sources", "answers", "content").mapInArrow(judge(lambda: shared.value), "pair_key string, defect string")


def cue_pairs(cues: DataFrame, videos: DataFrame) -> DataFrame:
    """A pair for each cue line; a cue delivered twice gives equal pairs, one without translations a null answer for each line."""
    told = F.coalesce("translated_lines", F.transform("source_lines", lambda _: F.lit(None).cast("string")))
    lines = cues.select("cue_id", "video_id", F.posexplode(F.arrays_zip(F.col("source_lines").alias("s"), told.alias("t"))).alias("at", "line"))
    target = videos.groupBy("video_id").agg(F.max("target_lang").alias("target"))
    key = F.concat(F.lit("c:"), F.col("cue_id").cast("string"), F.lit(":"), (F.col("at") + 1).cast("string"))
    return lines.join(target, "video_id", "left").select(
        key.alias("pair_key"), "target", F.array(F.col("line")["s"]).alias("sources"), F.array(F.col("line")["t"]).alias("answers"), F.lit(None).cast("string").alias("content")
    )


def cache_pairs(cache: DataFrame) -> DataFrame:
    """A pair for each cached request."""
    system = F.lower(F.get_json_object("request", "$.messages[0].content"))
    named = regex_names(system)
    user = F.get_json_object("request", "$.messages[1].content")
    return cache.select(
        F.concat(F.lit("l:"), F.col("cache_key")).alias("pair_key"), named.alias("target"),
        F.coalesce(F.from_json(user, "array<string>"), F.array(user)).alias("sources"), F.lit(None).cast("array<string>").alias("answers"),
        F.get_json_object("response", "$.choices[0].message.content").alias("content"),
    )


def regex_names(system: Column) -> Column:
    """The language named after into or to in an instruction."""
    pattern = r"\b(?:into|to)\s+(" + "|".join(NAMES) + r")\b"
    name = F.regexp_extract(system, pattern, 1)
    found = F.lit(None).cast("string")
    for word, code in NAMES.items():
        found = F.when(name == word, code).otherwise(found)
    return found
