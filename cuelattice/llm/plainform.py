"""Problem 1: one plain written form for text that looks the same.

Texts stay in Arrow buffers: a batch is decoded once into a numpy array of code points, mapped by
table gathers with expansion offsets, its marks are composed by array operations over all texts at
once, and the result is encoded once. No Python string is made per text.

Defined results: null stays null, the empty text stays empty, texts of any length are processed
whole. Full-width punctuation, circled or raised digits, fractions, and joiners or selectors
inside an emoji are kept. The form is idempotent.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of one script and those of another that look the same.
LATIN_CYRILLIC = {
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О",
    "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "У", "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ",
    "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у",
    "ë": "ё", "Ë": "Ё", "ï": "ї", "Ï": "Ї",
}
LATIN_GREEK = {
    "A": "Α", "B": "Β", "E": "Ε", "Z": "Ζ", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο",
    "P": "Ρ", "T": "Τ", "Y": "Υ", "X": "Χ", "o": "ο", "v": "ν",
}
CYRILLIC_GREEK = {
    "А": "Α", "В": "Β", "Е": "Ε", "Н": "Η", "І": "Ι", "К": "Κ", "М": "Μ", "О": "Ο", "Р": "Ρ", "Т": "Τ",
    "Х": "Χ", "о": "ο",
}
# Cyrillic letters that Russian does not have. Beside Cyrillic words they are those of another language;
# only a word of look-alikes with one of them, in a text that proves no script, is taken for a Latin one.
CYRILLIC_ALIEN = "ІЈЅіјѕԁһӏԛԝїЇ"
# Radical forms without a decomposition of their own and the Han characters they stand for.
RADICALS = {
    "⺁": "厂", "⺅": "亻", "⺆": "冂", "⺇": "几", "⺈": "刀", "⺉": "刂", "⺊": "卜", "⺋": "㔾", "⺌": "小",
    "⺍": "小", "⺏": "尣", "⺐": "尢", "⺒": "巳", "⺓": "幺", "⺔": "彑", "⺕": "彐", "⺖": "忄", "⺗": "心",
    "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺜": "日", "⺝": "月", "⺞": "歺", "⺠": "民", "⺡": "氵", "⺢": "氺",
    "⺣": "灬", "⺤": "爫", "⺥": "爫", "⺦": "丬", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺫": "目", "⺬": "示",
    "⺭": "礻", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺱": "罓", "⺲": "罒", "⺶": "羊", "⺷": "羊", "⺸": "羊",
    "⺹": "耂", "⺺": "肀", "⺻": "聿", "⺼": "肉", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎",
    "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "角", "⻈": "讠", "⻉": "贝", "⻊": "足",
    "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长",
    "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食",
    "⻞": "食", "⻟": "飠", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤",
    "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙",
    "⻱": "龜", "⻲": "亀",
}
#: Format characters (category Cf) that are drawn, or that form flag emoji; they stay.
DRAWN_FORMATS = [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD, *range(0xE0020, 0xE0080)]
#: Spans of compatibility characters that are brought to their plain letters.
COMPATIBILITY_SPANS = [
    (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2E80, 0x2FD5), (0xF900, 0xFAFF),
    (0xFB00, 0xFB17), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFF9F),
    (0xFFA1, 0xFFDC), (0x2F800, 0x2FA1F),
]
N = 0x110000
#: From here to 0xE0000 no character is assigned.
ASSIGNED = 0x323B0
ZWJ = 0x200D
LATIN, CYRILLIC, GREEK = 1, 2, 3


@lru_cache(maxsize=1)
def tables() -> dict:
    """Lookup tables over all code points; made once per Python worker."""
    flat: list[int] = []
    length = np.ones(N, np.uint8)
    offset = np.full(N, -1, np.int32)
    ccc = np.zeros(N, np.uint8)
    letter = np.zeros(N, bool)
    script = np.zeros(N, np.uint8)
    emoji = np.zeros(N, bool)
    selector = np.zeros(N, bool)
    firsts, seconds, composed = [], [], []

    def put(cp: int, text: str) -> None:
        offset[cp], length[cp] = len(flat), len(text)
        flat.extend(map(ord, text))

    drawn, dropped = set(DRAWN_FORMATS), []
    for cp in [*range(ASSIGNED), *range(0xE0000, 0xE01F0)]:  # beyond them all are unassigned or selectors
        if 0xAC00 <= cp <= 0xD7A3:
            letter[cp] = True
            continue
        if 0x3400 <= cp <= 0x9FFF or 0x17000 <= cp <= 0x187FF or 0x20000 <= cp <= 0x2EBE0 or 0x30000 <= cp <= 0x323AF:
            letter[cp] = unicodedata.category(chr(cp))[0] == "L" if cp < 0x20000 else True
            continue
        if 0xD800 <= cp <= 0xF8FF:
            continue
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category == "Cn":
            continue
        letter[cp] = category[0] == "L"
        ccc[cp] = unicodedata.combining(ch)
        if category == "Cf" and cp not in drawn:
            dropped.append(cp)
        elif category == "Zs" and cp != 0x20 or ch in "\t\x0b\x0c\x1c\x1d\x1e\x1f\x85":
            put(cp, " ")
        elif category in ("Zl", "Zp") or ch == "\r":
            put(cp, "\n")
        elif decomposition := unicodedata.decomposition(ch):
            if decomposition[0] != "<":
                full = unicodedata.normalize("NFD", ch)
                put(cp, full)
                parts = [int(x, 16) for x in decomposition.split()]
                if len(parts) == 2 and unicodedata.normalize("NFC", full) == ch:
                    firsts.append(parts[0])
                    seconds.append(parts[1])
                    composed.append(cp)
        if category == "So" or cp in (0xA9, 0xAE) or 0x2190 <= cp <= 0x2BFF or cp >= 0x1F000:
            emoji[cp] = True
    for low, high in COMPATIBILITY_SPANS:
        for cp in range(low, high + 1):
            plain = unicodedata.normalize("NFKD", chr(cp))
            if plain != chr(cp) and plain.strip():
                put(cp, plain)
    for radical, han in RADICALS.items():
        put(ord(radical), han)
    keycap = emoji.copy()
    keycap[[0x23, 0x2A, *range(0x30, 0x3A)]] = True
    selector[0xFE00:0xFE10] = selector[0xE0100:0xE01F0] = True
    for cp in [*dropped, 0x034F, *np.flatnonzero(selector).tolist()]:
        offset[cp], length[cp] = 0, 0
    for cp in np.flatnonzero(letter[:0x2C80]).tolist() + list(range(0xA640, 0xA7CB)):
        name = unicodedata.name(chr(cp), "")
        script[cp] = LATIN if name.startswith("LATIN") else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else 0
    keys = np.array(firsts, np.int64) << 21 | np.array(seconds, np.int64)
    order = np.argsort(keys)
    to = {s: np.arange(N, dtype=np.uint32) for s in (LATIN, CYRILLIC, GREEK)}
    for pairs, one, other in ((CYRILLIC_GREEK, CYRILLIC, GREEK), (LATIN_GREEK, LATIN, GREEK), (LATIN_CYRILLIC, LATIN, CYRILLIC)):
        for a, b in pairs.items():
            to[one][ord(b)], to[other][ord(a)] = ord(a), ord(b)
    alien = np.zeros(N, bool)
    alien[[ord(x) for x in CYRILLIC_ALIEN]] = True
    touched = (offset >= 0) | (length == 0) | (ccc > 0) | ((np.arange(N) >= 0x1100) & (np.arange(N) < 0x1200))
    touched[seconds] = True
    nfc_stable = np.zeros(N, bool)
    nfc_stable[composed] = True
    return {
        "flat": np.array(flat or [0], np.uint32), "length": length, "offset": offset, "ccc": ccc, "letter": letter,
        "script": script, "emoji": emoji, "keycap": keycap, "selector": selector, "pair": keys[order],
        "composed": np.array(composed, np.uint32)[order], "to": to, "alien": alien, "touched": touched & ~nfc_stable,
    }


def decode(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of a string array, and the row starts in them (rows + 1 values)."""
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string()) if pa.types.is_string(arr.type) else arr
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(arr) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint32), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return cps, heads[offsets - offsets[0]]


def encode(cps: np.ndarray, starts: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The string array of decode's values; rows where valid is false are null."""
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(width)))
    data = np.ascontiguousarray(cps, "<u4").tobytes().decode("utf-32-le").encode("utf-8")
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    made = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [mask, pa.py_buffer(ends[starts].astype(np.int64).tobytes()), pa.py_buffer(data)])
    return made


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where there is none."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _expand(cps: np.ndarray, rows: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Decompose, plain letters for compatibility ones, blanks, and no invisible characters."""
    length = t["length"][cps].astype(np.int64)
    first = np.ones(len(cps), bool)
    first[1:] = rows[1:] != rows[:-1]
    last = np.roll(first, -1)
    emoji, joint = t["emoji"][cps], (cps == ZWJ)
    tone = t["selector"][cps] | ((cps >= 0x1F3FB) & (cps <= 0x1F3FF))
    position = np.arange(len(cps))
    solid = np.maximum.accumulate(np.where(~tone | first, position, 0))
    before, after = np.roll(solid, 1), np.roll(position, -1)
    kept = joint & ~first & ~last & emoji[before] & emoji[after]
    kept |= t["selector"][cps] & ~first & t["keycap"][cps][np.roll(position, 1)]
    carriage = (cps == 0x0D) & ~last & (np.roll(cps, -1) == 0x0A)
    length[kept], length[carriage] = 1, 0
    source = np.repeat(position, length)
    step = np.arange(len(source)) - np.repeat(np.cumsum(length) - length, length)
    at = t["offset"][cps][source]
    out = np.where((at >= 0) & ~kept[source], t["flat"][np.maximum(at, 0) + step], cps[source]).astype(np.uint32)
    return out, rows[source]


def _compose(cps: np.ndarray, rows: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Order marks and compose them with their base, Hangul parts too, as in normal form C."""
    if not len(cps):
        return cps, rows
    ccc = t["ccc"][cps]
    if ccc.any():
        fresh = ccc == 0
        fresh[0] = True
        fresh[1:] |= rows[1:] != rows[:-1]
        group = np.cumsum(fresh) - 1
        order = np.lexsort((ccc, group))
        cps, ccc = cps[order], ccc[order]
        heads = np.flatnonzero(fresh)
        ordinal = np.arange(len(cps)) - heads[group]
        marks = np.flatnonzero(ordinal > 0)
        marks = marks[np.argsort(ordinal[marks], kind="stable")]
        bounds = np.searchsorted(ordinal[marks], np.arange(1, ordinal.max() + 2))
        cps, alive = cps.copy(), np.ones(len(cps), bool)
        held = np.zeros(len(heads), np.uint8)
        usable = ccc[heads] == 0
        for low, high in zip(bounds[:-1], bounds[1:]):
            now = marks[low:high]
            of = group[now]
            made = _look_up(t["pair"], t["composed"], cps[heads[of]].astype(np.int64) << 21 | cps[now])
            fits = (made > 0) & usable[of] & (held[of] < ccc[now])
            cps[heads[of[fits]]] = made[fits]
            alive[now[fits]] = False
            held[of[~fits]] = ccc[now[~fits]]
        cps, rows = cps[alive], rows[alive]
    for kind in ("lead", "tail", "other"):
        a, b, same = cps[:-1].astype(np.int64), cps[1:].astype(np.int64), rows[1:] == rows[:-1]
        if kind == "lead":
            fits = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176) & same
            made = 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28
        elif kind == "tail":
            fits = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3) & same
            made = a + b - 0x11A7
        else:
            made = _look_up(t["pair"], t["composed"], a << 21 | b)
            fits = (made > 0) & same & (t["ccc"][cps[1:]] == 0)
            fits[1:] &= ~fits[:-1]
        if fits.any():
            cps = cps.copy()
            at = np.flatnonzero(fits)
            cps[at] = made[at]
            alive = np.ones(len(cps), bool)
            alive[at + 1] = False
            cps, rows = cps[alive], rows[alive]
    return cps, rows


#: Characters that end a stretch within which neighbouring words are taken to be of one language.
STOPS = np.array([ord(x) for x in "\n|/–—()[]{}.!?…;:。！？；：「」『』«»“”„\""], np.uint32)


def _nearest(found: np.ndarray, stretch: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the value of the nearest found word before and after it in its stretch, else 0."""
    at = np.arange(len(found))
    before = np.maximum.accumulate(np.where(found, at, -1))
    before = np.concatenate(([-1], before[:-1]))
    after = len(found) - 1 - np.maximum.accumulate(np.where(found[::-1], at, -1))[::-1]
    after = np.concatenate((after[1:], [len(found)]))
    has_before, has_after = before >= 0, after < len(found)
    b, a = np.maximum(before, 0), np.minimum(after, len(found) - 1)
    return (
        np.where(has_before & (stretch[b] == stretch), value[b], 0),
        np.where(has_after & (stretch[a] == stretch), value[a], 0),
    )


def _own_script(cps: np.ndarray, rows: np.ndarray, n_rows: int, t: dict) -> np.ndarray:
    """Replace letters of another script that stand for look-alike letters of the word's own."""
    script = t["script"][cps]
    has = [np.bincount(rows[script == s], minlength=n_rows) > 0 for s in (LATIN, CYRILLIC, GREEK)]
    alien_row = np.bincount(rows[t["alien"][cps]], minlength=n_rows) > 0
    wanted = (has[0].astype(int) + has[1] + has[2] > 1) | alien_row
    if not wanted.any():
        return cps
    use = np.flatnonzero(wanted[rows])
    sub, sub_rows, sub_script = cps[use], rows[use], script[use]
    latin, cyrillic, greek = (t["to"][s] for s in (LATIN, CYRILLIC, GREEK))
    has_l, has_c, has_g = (x[sub_rows] for x in has)
    plain = np.zeros(len(sub), np.uint8)  # the script a letter proves, 0 if it could stand for another's
    is_l, is_c, is_g = sub_script == LATIN, sub_script == CYRILLIC, sub_script == GREEK
    russian = (cyrillic[sub] != sub) & ~t["alien"][cyrillic[sub]]
    plain[is_l & ~(has_c & russian) & ~(has_g & (greek[sub] != sub))] = LATIN
    plain[is_c & ~t["alien"][sub] & ~((has_l | ~has_g) & (latin[sub] != sub)) & ~(has_g & (greek[sub] != sub))] = CYRILLIC
    plain[is_g & ~(has_l & (latin[sub] != sub)) & ~(has_c & (cyrillic[sub] != sub))] = GREEK
    lettered = t["letter"][sub] & (sub_script > 0)
    start = lettered.copy()
    start[1:] &= ~lettered[:-1] | (sub_rows[1:] != sub_rows[:-1])
    word = np.cumsum(start) - 1
    inside = np.flatnonzero(lettered)
    if not len(inside):
        return cps
    w, words = word[inside], int(word[-1]) + 1
    count = [np.bincount(w[plain[inside] == s], minlength=words) for s in (LATIN, CYRILLIC, GREEK)]
    total = [np.bincount(w[sub_script[inside] == s], minlength=words) for s in (LATIN, CYRILLIC, GREEK)]
    alien = np.bincount(w[t["alien"][sub[inside]]], minlength=words) > 0
    proof = np.stack(count)
    own = np.where(proof.max(0) > 0, proof.argmax(0) + 1, 0)
    heads = inside[start[inside]]
    stop = np.isin(sub, STOPS)
    first = np.ones(len(sub), bool)
    first[1:] = sub_rows[1:] != sub_rows[:-1]
    stretch = np.cumsum(stop | first)[heads]
    before, after = _nearest(own > 0, stretch, own)
    row_proof = np.stack([np.bincount(sub_rows[plain == s], minlength=n_rows) for s in (LATIN, CYRILLIC, GREEK)])
    row_own = np.where(row_proof.max(0) > 0, row_proof.argmax(0) + 1, 0)[sub_rows[heads]]
    kinds = np.stack(total) > 0
    single = np.where(kinds.sum(0) == 1, kinds.argmax(0) + 1, 0)
    alone = (before == 0) & (after == 0)
    keeps = (single > 0) & ((single == before) | (single == after) | (alone & (row_own == 0) & ~alien) | (alone & (row_own == single)))
    # single letters are labels ("p. 12", "rev. B") where a full stop follows or joins them to a word of their script
    lone = (np.bincount(w, minlength=words) == 1) & (single > 0) & ~alien
    dot = sub == 0x2E
    joined = np.cumsum((stop & ~dot) | first)[heads]
    wide_before, wide_after = _nearest(own > 0, joined, own)
    dotted = np.append(dot[1:] & (sub_rows[1:] == sub_rows[:-1]), False)[heads]
    keeps |= lone & (dotted | (single == wide_before) | (single == wide_after))
    near = np.where(before > 0, before, np.where(after > 0, after, row_own))
    own = np.where(own > 0, own, np.where(keeps, single, np.where(near > 0, near, LATIN)))
    target = own[w]
    old = sub[inside]
    new = np.select([target == LATIN, target == CYRILLIC, target == GREEK], [latin[old], cyrillic[old], greek[old]], old)
    moved = new != old
    # a word that its script cannot spell in full is left as it is
    spelled = np.bincount(w[(t["script"][new] != target)], minlength=words) == 0
    moved &= spelled[w] | (plain[inside] == 0) & (proof.max(0)[w] > 0)
    out = cps.copy()
    out[use[inside[moved]]] = new[moved]
    return out


def plain_array(arr: pa.Array) -> pa.Array:
    """The plain form of every text of a string array."""
    valid = np.asarray(arr.is_valid()) if arr.null_count else None
    t = tables()
    cps, starts = decode(arr)
    if not len(cps):
        return arr.cast(pa.large_string())
    n = len(starts) - 1
    rows = np.repeat(np.arange(n), np.diff(starts))
    heavy = np.bincount(rows[t["touched"][cps]], minlength=n) > 0
    out, out_rows = cps, rows
    if heavy.any():
        pick = heavy[rows]
        made, made_rows = _compose(*_expand(cps[pick], rows[pick], t), t)
        out, out_rows = np.concatenate((cps[~pick], made)), np.concatenate((rows[~pick], made_rows))
        order = np.argsort(out_rows, kind="stable")
        out, out_rows = out[order], out_rows[order]
    out = _own_script(out, out_rows, n, t)
    return encode(out, np.concatenate(([0], np.cumsum(np.bincount(out_rows, minlength=n)))), valid)


def plain_list(texts: list[str | None]) -> list[str | None]:
    return plain_array(pa.array(texts, pa.large_string())).to_pylist()


def plain_form(text: Column) -> Column:
    """Plain form as a Column, Arrow batches in and out."""

    @F.arrow_udf(T.StringType())
    def plain(arr: pa.Array) -> pa.Array:
        return plain_array(arr).cast(pa.string())

    return plain(text)
