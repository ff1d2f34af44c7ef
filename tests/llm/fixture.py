"""Small labelled texts in all languages, made from phrases."""

import random
from functools import lru_cache

PHRASES = {
    "en": (["the baker", "my sister", "a stranger", "the old teacher"], ["sells", "paints", "forgets", "shows"], ["a wooden box", "the broken radio", "two blue cups", "the silver key"], "{0} {1} {2}."),
    "de": (["der Bäcker", "meine Schwester", "ein Fremder", "der alte Lehrer"], ["verkauft", "bemalt", "vergisst", "zeigt"], ["eine hölzerne Kiste", "das kaputte Radio", "zwei blaue Tassen", "den silbernen Schlüssel"], "{0} {1} {2}."),
    "fr": (["le boulanger", "ma sœur", "un inconnu", "le vieux maître"], ["vend", "peint", "oublie", "montre"], ["une caisse en bois", "la radio cassée", "deux tasses bleues", "la clé en argent"], "{0} {1} {2}."),
    "es": (["el panadero", "mi hermana", "un desconocido", "el viejo maestro"], ["vende", "pinta", "olvida", "muestra"], ["una caja de madera", "la radio rota", "dos tazas azules", "la llave de plata"], "{0} {1} {2}."),
    "ru": (["пекарь", "моя сестра", "незнакомец", "старый учитель"], ["продаёт", "красит", "забывает", "показывает"], ["деревянный ящик", "сломанное радио", "два синих стакана", "серебряный ключ"], "{0} {1} {2}."),
    "ja": (["パン屋", "私の妹", "見知らぬ人", "年老いた先生"], ["売る", "塗る", "忘れる", "見せる"], ["木の箱", "壊れたラジオ", "青いカップ二つ", "銀の鍵"], "{0}は{2}を{1}。"),
    "zh": (["麵包師傅", "我的妹妹", "一個陌生人", "年老的老師"], ["賣掉", "粉刷", "忘記", "展示"], ["一個木箱", "壞掉的收音機", "兩個藍杯子", "銀色的鑰匙"], "{0}{1}{2}。"),
    "ko": (["제빵사는", "내 여동생은", "낯선 사람은", "늙은 선생님은"], ["판다", "칠한다", "잊는다", "보여준다"], ["나무 상자를", "고장 난 라디오를", "파란 컵 두 개를", "은빛 열쇠를"], "{0} {2} {1}."),
}


def sentence(lang: str, a: int, b: int, c: int) -> str:
    who, does, what, form = PHRASES[lang]
    text = form.format(who[a % 4], does[b % 4], what[c % 4])
    return text[0].upper() + text[1:]


def documents(per_lang: int = 12, sentences: int = 24, seed: int = 1) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    return [(lang, " ".join(sentence(lang, rng.randrange(4), rng.randrange(4), rng.randrange(4)) for _ in range(sentences))) for lang in PHRASES for _ in range(per_lang)]


@lru_cache(maxsize=1)
def models():
    from cuelattice.llm.langmodel import fit

    return fit(documents())
