"""Character models per language: interpolated Kneser-Ney, and how sentences and words end.

Models are fitted on all labelled documents, copies once. Tasks count the distinct sequences of
ENDING characters of their texts; the counts of all tasks, summed up, hold those of all shorter
sequences. A tenth of the texts, scored by models of the others, gives temperature and limit.

Models are kept as sorted arrays of 64-bit hashes of character sequences, with one column of values
for each language, so that a batch of texts is scored in all languages by a few searches. They grow
with the distinct sequences, not with the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.llm.plainform import N, decode, plain_list, tables
from cuelattice.session import cut_lineage

LANGUAGES = ("en", "de", "fr", "es", "ru", "ja", "zh", "ko")
#: Languages written without blanks between words, or with syllable letters: fewer letters say as much.
DENSE = ("ja", "zh", "ko")
SAMPLE_DOCS = 240
MAX_CODES = 90_000
#: Characters a language that the driver receives at most.
SAMPLE_CODES = 4 * MAX_CODES
ORDER = 5
ENDING = 8
ALPHABET = 20_000
STEP = np.uint64(0x9E3779B97F4A7C15)
BLANK, STOP = 0x20, 0x2E
#: Stands before each row where sequences are counted; no text has it.
START = 0x110000
#: Codes of a language that a task counts at a time.
CHUNK = 2_000_000
#: One of so many texts is for calibration.
HELD = 10
TEMPERATURES = (1.0, 0.5, 0.25, 0.1, 0.05, 0.02)
SENTENCE_MARKS = ".!?…。！？"


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Lower-case letters as they are, sentence marks as STOP, all else as BLANK."""
    letter = tables()["letter"]
    table = np.full(N, BLANK, np.uint32)
    at = np.flatnonzero(letter)
    table[at] = at
    for cp in np.flatnonzero(letter[:0x2C00]).tolist() + list(range(0xA640, 0xA7CB)) + list(range(0xFF21, 0xFF3B)):
        low = chr(cp).lower()
        if len(low) == 1:
            table[cp] = ord(low)
    for cp in range(0x300, 0x370):
        table[cp] = cp
    for mark in SENTENCE_MARKS:
        table[ord(mark)] = STOP
    return table


def folded(plain: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts without repeated blanks, each text led by a blank; row starts; source position of each code.

    The source position counts code points of the decoded array, -1 for the leading blank.
    """
    cps, starts = decode(plain)
    n = len(starts) - 1
    codes = fold_table()[cps]
    rows = np.repeat(np.arange(n), np.diff(starts))
    keep = np.ones(len(codes), bool)
    if len(codes):
        same = rows[1:] == rows[:-1]
        gap = (codes == BLANK) | (codes == STOP)
        keep[1:] = ~((codes[1:] == BLANK) & gap[:-1] & same) & ~((codes[1:] == STOP) & (codes[:-1] == STOP) & same)
        first = np.ones(len(codes), bool)
        first[1:] = ~same
        keep &= ~(first & (codes == BLANK))
    at = np.flatnonzero(keep)
    all_rows = np.concatenate((np.arange(n), rows[at]))
    order = np.argsort(all_rows, kind="stable")
    out = np.concatenate((np.full(n, BLANK, np.uint32), codes[at]))[order]
    position = np.concatenate((np.full(n, -1), at))[order]
    return out, np.concatenate(([0], np.cumsum(np.bincount(all_rows, minlength=n)))), position


def grams(codes: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the k codes that end at each position, for k = 1..order; 0 where the row is too short."""
    within = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    one = (codes.astype(np.uint64) + np.uint64(1)) * STEP
    one ^= one >> np.uint64(29)
    out = [one]
    with np.errstate(over="ignore"):
        for k in range(2, order + 1):
            h = np.zeros(len(codes), np.uint64)
            h[1:] = out[-1][:-1] * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
            h ^= h >> np.uint64(31)
            h[within < k - 1] = 0
            out.append(h)
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted) & (wanted != 0), at, -1)


@dataclass
class Models:
    """Sorted hashes by order with log probabilities and back-off weights, one column a language."""

    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    histories: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ends: dict[str, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    temperature: float = 1.0
    limit: float = 12.0  # beyond what a fitted language gives unknown letters, within what one without texts does
    sentence: np.ndarray = field(default_factory=lambda: np.ones(len(LANGUAGES)))  # mean letters of a sentence

    def score(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log probability of every code in every language."""
        hashes = grams(codes, starts, len(self.keys))
        at = find(self.keys[0], hashes[0])
        out = np.repeat(self.floor[None, :].astype(np.float32), len(codes), axis=0)
        out[at >= 0] = self.logp[0][at[at >= 0]]
        active = np.arange(len(codes))
        for k in range(1, len(self.keys)):
            active = active[hashes[k][active] != 0]
            history = find(self.histories[k], hashes[k - 1][active - 1])
            active, history = active[history >= 0], history[history >= 0]
            at = find(self.keys[k], hashes[k][active])
            hit = at >= 0
            out[active[hit]] = self.logp[k][at[hit]]
            out[active[~hit]] += self.backoff[k][history[~hit]]
        return out

    def ending(self, codes: np.ndarray, starts: np.ndarray, kind: str) -> np.ndarray:
        """How often the longest known context at each row's end was followed by an end of the kind; a row each."""
        hashes = grams(codes, starts, ENDING)
        last = starts[1:] - 1
        out = np.zeros((len(last), len(LANGUAGES)), np.float32)
        for k in range(1, ENDING):  # longer contexts overrule shorter ones
            keys, rate = self.ends[kind][k]
            at = find(keys, hashes[k][np.maximum(last, 0)])
            known = (at >= 0) & (last >= starts[:-1])
            rates = rate[at[known]].astype(np.float32)
            out[known] = np.where(np.isnan(rates), out[known], rates)
        return out


def text_lines(plain: list[str]) -> list[str]:
    """Lines with letters; scaffolding of subtitle files has no letters of the language's own."""
    lines = [x.split(",,")[-1] for t in plain for x in t.split("\n")]
    return [x for x in lines if any(map(str.isalpha, x))]


#: Of each distinct sequence of ENDING codes of a language (ORDER + 1 where endings are not asked for): its last six codes in two numbers, hashes of its last 6, 7 and 8 codes (0 where the
#: row has fewer, or where the last one is BLANK or STOP, which no sentence ends after), how often it occurs, how often a sentence ends after it and how often a row does.
SEQUENCES = ("a", "b", "h6", "h7", "h8", "n", "ends", "lasts")


def count_sequences(codes: np.ndarray, starts: np.ndarray, endings: bool = True) -> list[np.ndarray]:
    """The columns of SEQUENCES of some rows of codes."""
    length = np.diff(starts)
    place = np.arange(len(codes)) + (ENDING - 1) * (np.repeat(np.arange(len(length)), length) + 1)
    padded = np.full(len(codes) + (ENDING - 1) * len(length), START, np.uint32)
    padded[place] = codes
    hashes = grams(padded, np.array([0, len(padded)]), ENDING if endings else ORDER + 1)
    within = np.arange(len(codes)) - np.repeat(starts[:-1], length)
    last = np.zeros(len(codes), bool)
    last[starts[1:][length > 0] - 1] = True
    inner = (codes != BLANK) & (codes != STOP)  # no longer contexts are asked for after the others
    end = (np.append(codes[1:], STOP)[: len(codes)] == STOP) & inner & ~last
    key = np.where(inner, hashes[-1][place], hashes[ORDER][place])
    order = np.argsort(key)
    heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else order
    first = order[heads]
    at = [padded[place[first] - k].astype(np.int64) for k in range(ORDER + 1)]
    longer = [np.where((within[first] >= k - 1) & inner[first], hashes[k - 1][place[first]] if endings else 0, 0).astype(np.uint64).view(np.int64) for k in range(ORDER + 1, ENDING + 1)]
    sums = [np.add.reduceat(x[order].astype(np.int64), heads) if len(heads) else heads for x in (np.ones(len(codes), bool), end, last)]
    return [at[5] << 42 | at[4] << 21 | at[3], at[2] << 42 | at[1] << 21 | at[0], *longer, *sums]


COUNTED = "lang int, held boolean, word string, " + ", ".join(f"{c} long" for c in SEQUENCES)
NAMES = [x.split()[0] for x in COUNTED.split(", ")]


def count_texts(words: Callable[[str], list[str]] | None = None, endings: bool = True, chunk: int = CHUNK) -> Callable:
    """lang, held, text -> rows of COUNTED: distinct sequences, and distinct words, with what a task has of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[tuple[str, bool], list[str]] = {}
        size: Counter = Counter()
        said: dict[str, Counter] = {}

        def counted(lang: str, held: bool) -> pa.RecordBatch:
            codes, starts, _ = folded(pa.array(lines.pop((lang, held)), pa.large_string()))
            columns = count_sequences(codes, starts, endings)
            n = len(columns[0])
            size.pop((lang, held))
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, LANGUAGES.index(lang), np.int32)), pa.array(np.full(n, held)), pa.nulls(n, pa.string()), *map(pa.array, columns)], names=NAMES)

        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                plain, langs = plain_list(part.column("text").to_pylist()), part.column("lang").to_pylist()
                if words:
                    for one in dict.fromkeys(langs):  # no word goes on in another line
                        said.setdefault(one, Counter()).update(words("\n".join(t for lang, t in zip(langs, plain) if lang == one).lower()))
                for lang, held, text in zip(langs, part.column("held").to_pylist(), plain):
                    more = text_lines([text])
                    lines.setdefault((lang, held), []).extend(more)
                    size[lang, held] += sum(map(len, more))
                    if size[lang, held] > chunk:
                        yield counted(lang, held)
        for lang, held in list(lines):
            yield counted(lang, held)
        for lang, found in said.items():
            n = len(found)
            none = [pa.nulls(n, pa.int64())] * (len(SEQUENCES) - 3)
            zero = pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, LANGUAGES.index(lang), np.int32)), pa.array(np.zeros(n, bool)), pa.array(list(found), pa.string()), *none, pa.array(list(found.values()), pa.int64()), zero, zero], names=NAMES)

    return run


@dataclass
class Counts:
    """Distinct sequences of ORDER + 1 codes a language, and longer contexts that end sentences."""

    lang: np.ndarray
    codes: np.ndarray  # a row a sequence, led by START where the row has fewer
    n: np.ndarray
    ends: np.ndarray
    lasts: np.ndarray
    longer: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # for each length over ORDER: hashes; followed, and ended, a column a language

    @classmethod
    def of(cls, lang: np.ndarray, a: np.ndarray, b: np.ndarray, sums: list[np.ndarray], longer: list) -> Counts:
        mask = (1 << 21) - 1
        codes = np.stack([a >> 42, a >> 21 & mask, a & mask, b >> 42, b >> 21 & mask, b & mask], 1)
        return cls(lang, codes, *sums, longer)

    def hashes(self, k: int, before: int = 0) -> np.ndarray:
        """Of k codes of each sequence that end so many codes before its last one, as grams has them."""
        high = ORDER + 1 - before
        low = high - k
        return grams(np.ascontiguousarray(self.codes[:, low:high]).ravel(), np.arange(len(self.codes) + 1) * (high - low), high - low)[-1].reshape(-1, high - low)[:, -1]

    def whole(self, k: int) -> np.ndarray:
        """Where the last k codes are of a text."""
        return self.codes[:, ORDER + 1 - k] != START


def _kneser_ney(counts: Counts) -> Models:
    n_lang, made = len(LANGUAGES), Models()
    trained = np.bincount(counts.lang, minlength=n_lang) > 0
    below = None
    for k in range(1, ORDER + 1):
        whole = np.flatnonzero(counts.whole(k))
        lang = counts.lang[whole]
        key = counts.hashes(k)[whole]
        union, example = np.unique(key, return_index=True)
        before = counts.hashes(k - 1, 1)[whole] if k > 1 else key
        histories = np.unique(before) if k > 1 else np.zeros(0, np.uint64)
        # continuation counts: distinct codes before the sequence, a row's start among them; of the longest ones too, so that phrases told often don't count for more
        wider = counts.hashes(k + 1)[whole]
        seen = np.zeros((len(union), n_lang))
        gamma = np.ones((len(histories), n_lang))
        unigram_gamma = np.ones(n_lang)
        for one in np.flatnonzero(trained):
            mine = np.flatnonzero(lang == one)
            if not len(mine):
                continue
            mine = mine[np.unique(wider[mine], return_index=True)[1]]
            values, first, total_of = np.unique(key[mine], return_index=True, return_counts=True)
            ones, twos = (total_of == 1).sum(), (total_of == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            index = np.searchsorted(union, values)
            if k == 1:
                seen[index, one] = (total_of - discount) / total_of.sum()
                unigram_gamma[one] = discount * len(values) / total_of.sum()
            else:
                history = np.searchsorted(histories, before[mine[first]])
                total = np.bincount(history, total_of, len(histories))
                kinds = np.bincount(history, minlength=len(histories))
                seen[index, one] = (total_of - discount) / total[history]
                used = total > 0
                gamma[used, one] = discount * kinds[used] / total[used]
        if k == 1:
            floor = np.where(trained, unigram_gamma / ALPHABET, 1e-13)  # a language without texts never wins
            probability = seen + floor[None, :]
            made.floor = np.log(floor).astype(np.float32)
        else:
            shorter = counts.hashes(k - 1)[whole[example]]
            probability = seen + gamma[np.searchsorted(histories, before[example])] * below[1][np.searchsorted(below[0], shorter)]
        made.keys.append(union)
        made.logp.append(np.log(np.maximum(probability, 1e-12)).astype(np.float16))
        made.histories.append(histories)
        made.backoff.append(np.log(np.maximum(gamma, 1e-9)).astype(np.float16))
        below = (union, probability)
    return made


def _endings(counts: Counts) -> list[tuple[np.ndarray, np.ndarray]]:
    """By context length: hashes of contexts that some language ends a sentence with, and the rate of ends a language (nan: context unknown)."""
    last = counts.codes[:, -1]
    out = []
    for k in range(1, ENDING + 1):
        if k <= ORDER:
            usable = np.flatnonzero(counts.whole(k) & (last != BLANK) & (last != STOP))
            keys, at = np.unique(counts.hashes(k)[usable], return_inverse=True)
            followed, ended = (np.bincount(at * len(LANGUAGES) + counts.lang[usable], x[usable], len(keys) * len(LANGUAGES)).reshape(-1, len(LANGUAGES)) for x in (counts.n - counts.lasts, counts.ends))
            some = ended.sum(1) > 0
            keys, followed, ended = keys[some], followed[some], ended[some]
        else:
            keys, followed, ended = counts.longer[k - ORDER - 1] if counts.longer else (np.zeros(0, np.uint64), *np.zeros((2, 0, len(LANGUAGES))))
        # a context met once says little beside a shorter one, unless it is long
        known = followed >= (1 if k > 5 else 2)
        out.append((keys, np.where(known, ended / np.maximum(1, followed), np.nan).astype(np.float16)))
    return out


def models_of(counts: Counts) -> Models:
    made = _kneser_ney(counts)
    made.ends = {"sentence": _endings(counts)}
    last = counts.codes[:, -1]
    stops = np.bincount(counts.lang, counts.n * (last == STOP), len(LANGUAGES))
    letters = np.bincount(counts.lang, counts.n * ((last != STOP) & (last != BLANK)), len(LANGUAGES))
    made.sentence[stops > 0] = letters[stops > 0] / stops[stops > 0]
    return made


def trial(made: Models, lang: int, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Losses of held-out lines at each of TEMPERATURES, and thousandths of the cross-entropy a code of each line."""
    codes, starts, _ = folded(pa.array(lines, pa.large_string()))
    length = np.diff(starts)
    if not len(length):
        return np.zeros(len(TEMPERATURES)), np.zeros(0, np.int64)
    score = np.add.reduceat(made.score(codes, starts), starts[:-1], axis=0)[length >= 12].astype(np.float64)
    losses = []
    for temperature in TEMPERATURES:
        x = score * temperature
        x -= x.max(1, keepdims=True)
        losses.append((np.log(np.exp(x).sum(1)) - x[:, lang]).sum())
    return np.array(losses), np.rint(-1000 * score.max(1) / length[length >= 12]).astype(np.int64)


def calibrate(made: Models, losses: np.ndarray, entropy: Counter) -> None:
    """A temperature for confidences, and the cross-entropy a code beyond which no language is named."""
    if not entropy:
        return
    made.temperature = TEMPERATURES[int(np.argmin(losses))]
    values = np.array(sorted(entropy))
    upto = np.cumsum([entropy[v] for v in values.tolist()])
    at = 0.995 * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, k, "right")] for k in (int(at), min(int(at) + 1, upto[-1] - 1)))
    made.limit = float(low + (at - int(at)) * (high - low)) / 1000 + 2.5


def fit(sample: list[tuple[str, str]]) -> Models:
    """Models of all languages from texts at hand; a tenth of each language's texts is for calibration."""
    rows, held = [], []
    for lang in LANGUAGES:
        texts = [t for code, t in sample if code == lang]
        cut = max(1, len(texts) // HELD) if len(texts) > 1 else 0
        rows += [(lang, k < cut, t) for k, t in enumerate(texts)]
        held.append(text_lines(plain_list(texts[:cut])))
    texts = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.large_string())], names=["lang", "held", "text"])
    counted = pa.Table.from_batches(list(count_texts()(iter([texts])))) if rows else pa.table({c: pa.array([], pa.int64()) for c in NAMES})
    column = {c: counted.column(c).to_numpy() for c in NAMES if c != "word"}

    def counts(rows: np.ndarray) -> Counts:
        longer = []
        usable = rows & ~np.isin(column["b"] & ((1 << 21) - 1), (BLANK, STOP))
        for name in ("h6", "h7", "h8"):
            at = np.flatnonzero(usable & (column[name] != 0))
            keys, of = np.unique(column[name][at].view(np.uint64), return_inverse=True)
            sums = [np.bincount(of * len(LANGUAGES) + column["lang"][at], x[at], len(keys) * len(LANGUAGES)).reshape(-1, len(LANGUAGES)) for x in (column["n"] - column["lasts"], column["ends"])]
            some = sums[1].sum(1) > 0
            longer.append((keys[some], sums[0][some], sums[1][some]))
        five, of = np.unique(np.stack([column["lang"][rows], column["a"][rows], column["b"][rows]], 1), axis=0, return_inverse=True)
        return Counts.of(*five.T, [np.bincount(of, column[c][rows], len(five)) for c in ("n", "ends", "lasts")], longer)

    made, part = models_of(counts(np.ones(len(column["n"]), bool))), models_of(counts(~column["held"].astype(bool)))
    tried = [trial(part, k, lines) for k, lines in enumerate(held)]
    calibrate(made, sum(x for x, _ in tried), Counter(np.concatenate([y for _, y in tried]).tolist()))
    return made


def labelled_texts(documents: DataFrame) -> DataFrame:
    """lang, held, text of the labelled documents: every text of a language once, one of HELD of them for calibration."""
    lang = F.lower(F.substring_index(F.regexp_replace(F.trim("lang"), "_", "-"), "-", 1))
    prose = F.coalesce(F.col("doc_format") != "list", F.lit(True))
    rows = documents.where(F.col("text").isNotNull() & prose).select(lang.alias("lang"), "text", (F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0).alias("held"))
    return rows.where(F.col("lang").isin(*LANGUAGES))


def try_texts(load: Callable[[], Models]) -> Callable:
    """lang, text -> losses and cross-entropies of a task's lines: temperature (-1: none), milli, n, loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses, entropy = np.zeros(len(TEMPERATURES)), Counter()
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                for low in range(0, len(some), 200):
                    loss, milli = trial(load(), LANGUAGES.index(lang), text_lines(plain_list(some[low : low + 200])))
                    losses += loss
                    entropy.update(milli.tolist())
        k, m = len(TEMPERATURES), len(entropy)
        columns = [[*range(k), *[-1] * m], [*[0] * k, *entropy], [*[0] * k, *entropy.values()], [*losses.tolist(), *[0.0] * m]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.float64()))], names=["temperature", "milli", "n", "loss"])

    return run


def fitted(documents: DataFrame, words: Callable[[str], list[str]] | None = None, endings: bool = False, calibrated: bool = True) -> tuple[Models, DataFrame]:
    """Models of all languages from all labelled documents, and their words: lang, word, n in parts.

    words: cuts a text in lower case to its words. endings: whether contexts of over ORDER characters are asked for.
    Without calibration temperature and limit keep their first values.
    """
    texts = labelled_texts(documents)
    if not calibrated:
        texts = texts.withColumn("held", F.lit(False))  # one part, so that no sequence counts in two
    counted = cut_lineage(texts.distinct().mapInArrow(count_texts(words, endings), COUNTED))
    sequences = counted.where(F.col("word").isNull())
    sums = lambda *by: sequences.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "ends", "lasts")])
    every = sums("lang", "held", "a", "b").toArrow()
    longer = []
    if endings:
        usable = sequences.where(~F.col("b").bitwiseAND((1 << 21) - 1).isin(BLANK, STOP))
        # what ends with none of the last characters of sentences ends none
        usable = usable.join(F.broadcast(usable.where("ends > 0").select("h6").distinct()), "h6", "left_semi")
        contexts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in range(ORDER + 1, ENDING + 1)])).alias("c")
        by_lang = lambda c: [F.sum(F.when(F.col("lang") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(len(LANGUAGES))]
        # all lengths in one pass over the sequences
        held = usable.select("lang", (F.col("n") - F.col("lasts")).alias("followed"), "ends", contexts).where("c.h != 0").groupBy("c.k", "c.h").agg(*by_lang("followed"), *by_lang("ends"), F.sum("ends").alias("some"))
        rows = held.where("some > 0").drop("some").toArrow()
        length, keys = rows.column("k").to_numpy(), rows.column("h").to_numpy().view(np.uint64)
        tallies = [np.stack([rows.column(f"{c}{k}").to_numpy() for k in range(len(LANGUAGES))], 1) for c in ("followed", "ends")]
        for k in range(ORDER + 1, ENDING + 1):
            at = np.flatnonzero(length == k)
            at = at[np.argsort(keys[at])]
            longer.append((keys[at], *(x[at] for x in tallies)))

    def counts(of: pa.Table) -> Counts:
        both = of.group_by(["lang", "a", "b"]).aggregate([(c, "sum") for c in ("n", "ends", "lasts")])
        return Counts.of(*(both.column(c).to_numpy().astype(np.int64) for c in ("lang", "a", "b")), [both.column(f"{c}_sum").to_numpy() for c in ("n", "ends", "lasts")], longer)

    made = models_of(counts(every))
    if calibrated:
        part = _kneser_ney(counts(every.filter(pc.invert(every.column("held")))))
        shared = documents.sparkSession.sparkContext.broadcast(part)
        rows = texts.where("held").select("lang", "text").distinct().mapInArrow(try_texts(lambda: shared.value), "temperature int, milli long, n long, loss double")
        rows = rows.groupBy("temperature", "milli").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).collect()
        losses = np.array([sum(r["loss"] for r in rows if r["temperature"] == k) for k in range(len(TEMPERATURES))])
        calibrate(made, losses, Counter({r["milli"]: r["n"] for r in rows if r["temperature"] < 0}))
    return made, counted.where(F.col("word").isNotNull()).select("lang", "word", "n")


def language_code(label: str | None) -> str:
    """The language a label names, without case, region and script; '' for none."""
    return (label or "").strip().lower().replace("_", "-").split("-")[0]


def labelled_sample(documents: DataFrame, docs: int = SAMPLE_DOCS, codes: int = SAMPLE_CODES) -> list[tuple[str, str]]:
    """Up to docs distinct texts and codes characters a language, the first ones by hash; the same for any order of rows.

    For trials; the queries fit on all labelled documents.
    """
    lang = F.lower(F.substring_index(F.regexp_replace(F.trim("lang"), "_", "-"), "-", 1))
    prose = F.coalesce(F.col("doc_format") != "list", F.lit(True))
    rows = documents.where(F.col("text").isNotNull() & prose).select(lang.alias("lang"), F.left("text", F.lit(MAX_CODES)).alias("text"), F.xxhash64("text").alias("h"))
    rows = rows.where(F.col("lang").isin(*LANGUAGES)).withColumn("size", F.length("text"))
    # only hashes are ranked; the texts of the chosen ones are fetched, copies once
    hashes = rows.groupBy("lang", "h").agg(F.max("size").alias("size"))
    by = W.partitionBy("lang").orderBy("h")
    first = hashes.withColumn("r", F.row_number().over(by)).where(F.col("r") <= docs)
    chosen = first.withColumn("upto", F.sum("size").over(by)).where(F.col("upto") <= codes).select("lang", "h", "r")
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "r").agg(F.min("text").alias("text"))
    return [(r["lang"], r["text"]) for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["r"]))]
