"""Problem 4: the language of every text and of each segment of mixed ones.

Texts are scored by the Kneser-Ney models of langmodel in all languages at once; the lowest
length-normalised cross-entropy wins, and none where even that is beyond the calibrated limit.
A text whose words fit several languages is cut by a best path over its words, on which changing
the language costs more inside a sentence than at a separator; segments that are too short to
name a language join their neighbour.

Defined results: null and blank texts, and texts with too few letters, have no segment; texts of
any length are scored whole; the same text has the same segments in every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.langmodel import BLANK, DENSE, LANGUAGES, STOP, Models, folded
from cuelattice.llm.plainform import decode, plain_array

MIN_LETTERS, MIN_DENSE = 12, 6
ADDED = ("seg_no", "lang", "confidence", "n_letters", "n_segments")
#: Cost in nats of a change of language at a separator, and within a sentence.
SWITCH_AT_STOP, SWITCH_INSIDE = 7.0, 16.0
#: A text beyond the limit still gets a language of at least this confidence.
SURE = 0.95
SEPARATORS = np.array([ord(x) for x in "\n|/–—()[]{}.!?…。！？;；"], np.uint32)
LEAST = np.array([MIN_DENSE if x in DENSE else MIN_LETTERS for x in LANGUAGES])


def script_kinds(codes: np.ndarray) -> np.ndarray:
    """0 Latin and others, 1 Cyrillic, 2 Hangul, 3 kana and Han."""
    return np.select(
        [(codes >= 0x400) & (codes < 0x530), (codes >= 0xAC00) & (codes < 0xD7B0), (codes >= 0x2E80) & (codes < 0xA000) | (codes >= 0x20000)],
        [1, 2, 3], 0,
    )


class Identifier:
    """Segments of batches of texts; made once per Python worker."""

    def __init__(self, models: Models):
        self.models = models

    def segments(self, plain: pa.Array) -> list[list[tuple[int, float, int]]]:
        """For each text its segments in order: language index, confidence, letters."""
        codes, starts, position = folded(plain)
        cps, cp_starts = decode(plain)
        n = len(starts) - 1
        rows = np.repeat(np.arange(n), np.diff(starts))
        letters = (codes != BLANK) & (codes != STOP)
        score = self.models.score(codes, starts)
        # words: letters of one script; the blank before a word belongs to it
        kinds = script_kinds(codes)
        new = letters.copy()
        new[1:] &= ~letters[:-1] | (kinds[1:] != kinds[:-1]) | (rows[1:] != rows[:-1])
        word = np.cumsum(new) - 1
        lead = np.zeros(len(codes), bool)
        lead[:-1] = ~letters[:-1] & new[1:] & (rows[1:] == rows[:-1])
        word = np.where(lead, np.roll(word, -1), word)
        used = letters | lead
        n_words = int(new.sum())
        if not n_words:
            return [[] for _ in range(n)]
        by_word = np.stack([np.bincount(word[used], score[used, k], n_words) for k in range(score.shape[1])], 1)
        n_letters = np.bincount(word[letters], minlength=n_words)
        heads = np.flatnonzero(new)
        word_row = rows[heads]
        separator = np.concatenate(([0], np.cumsum(np.isin(cps, SEPARATORS))))
        at = np.maximum(position[heads], 0)
        before = separator[at]
        apart = np.ones(n_words, bool)
        apart[1:] = before[1:] != before[:-1]
        bounds = np.searchsorted(word_row, np.arange(n + 1))
        busy = np.flatnonzero(np.diff(bounds))
        firsts = bounds[busy]
        total = np.add.reduceat(by_word, firsts, axis=0)
        free = np.add.reduceat(by_word.max(1), firsts)
        count = np.add.reduceat(n_letters, firsts)
        out: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
        best = total.argmax(1)
        gain = free - total.max(1)
        for k, row in enumerate(busy.tolist()):
            if gain[k] > SWITCH_AT_STOP and bounds[row + 1] - bounds[row] > 1:
                low, high = bounds[row], bounds[row + 1]
                out[row] = self._mixed(by_word[low:high], n_letters[low:high], apart[low:high])
            elif count[k] >= LEAST[best[k]]:
                out[row] = [self._named(total[k], int(count[k]))]
        return [[x for x in found if x] for found in out]

    def _named(self, score: np.ndarray, letters: int) -> tuple[int, float, int] | None:
        """Best language; none where the text is unlike all of them and no one of them stands out."""
        lang = int(score.argmax())
        trust = float(1.0 / np.exp((score - score[lang]) * self.models.temperature).sum())
        if -score[lang] / max(1, letters) > self.models.limit and trust < SURE:
            return None
        return lang, trust, letters

    def _mixed(self, score: np.ndarray, letters: np.ndarray, apart: np.ndarray) -> list:
        """The best path over words; runs of one language that are long enough."""
        n, k = score.shape
        value, back = score[0].copy(), np.zeros((n, k), np.int64)
        for i in range(1, n):
            cost = SWITCH_AT_STOP if apart[i] else SWITCH_INSIDE
            top = int(value.argmax())
            change = value[top] - cost
            stay = value >= change
            back[i] = np.where(stay, np.arange(k), top)
            value = np.where(stay, value, change) + score[i]
        path = [int(value.argmax())]
        for i in range(n - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        path.reverse()
        runs: list[list] = []  # language, score, letters
        for lang, s, m in zip(path, score, letters):
            if runs and runs[-1][0] == lang:
                runs[-1][1], runs[-1][2] = runs[-1][1] + s, runs[-1][2] + m
            else:
                runs.append([lang, s.copy(), int(m)])
        while len(runs) > 1:
            # too short, or a few words unlike any language amid one: names
            amid = [0 < i < len(runs) - 1 and runs[i - 1][0] == runs[i + 1][0] for i in range(len(runs))]
            short = [i for i, r in enumerate(runs) if r[2] < LEAST[r[0]] or (amid[i] and r[2] < 2 * LEAST[r[0]] and -r[1][r[0]] > self.models.limit * r[2])]
            if not short:
                break
            i = min(short, key=lambda j: (runs[j][2], j))
            del runs[i]  # an abbreviation or name says nothing about the language beside it
            i = 1
            while i < len(runs):
                if runs[i][0] == runs[i - 1][0]:
                    runs[i - 1][1], runs[i - 1][2] = runs[i - 1][1] + runs[i][1], runs[i - 1][2] + runs[i][2]
                    del runs[i]
                else:
                    i += 1
        if len(runs) == 1:
            found = self._named(runs[0][1], runs[0][2])
            return [(*found[:2], int(letters.sum()))] if found and letters.sum() >= LEAST[found[0]] else []
        found = []
        for lang, s, m in runs:
            x = np.exp((s - s.max()) * self.models.temperature)
            found.append((lang, float(x[lang] / x.sum()), m))
        return found


def segmenter(load: Callable[[], Models]) -> Callable:
    """Arrow function over batches with a text column: the same columns without it, a row a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = None
        for batch in batches:
            identifier = identifier or Identifier(load())
            text = batch.column("text").dictionary_encode()
            found = identifier.segments(plain_array(text.dictionary.cast(pa.large_string())))
            index, number, lang, confidence, letters, total = [], [], [], [], [], []
            for row, key in enumerate(text.indices.to_pylist()):
                if key is None:
                    continue
                for seg, (code, trust, m) in enumerate(found[key], 1):
                    index.append(row)
                    number.append(seg)
                    lang.append(LANGUAGES[code])
                    confidence.append(trust)
                    letters.append(m)
                    total.append(len(found[key]))
            keep = batch.drop_columns(["text"]).take(pa.array(index, pa.int64()))
            more = [pa.array(number, pa.int32()), pa.array(lang, pa.string()), pa.array(confidence, pa.float64()), pa.array(letters, pa.int32()), pa.array(total, pa.int32())]
            yield pa.RecordBatch.from_arrays([*keep.columns, *more], names=[*keep.schema.names, *ADDED])

    return run


def language_segments(texts: DataFrame, models: Models) -> DataFrame:
    """texts: columns with one named text; a row for each segment: its other columns, seg_no, lang, confidence, n_letters, n_segments.

    Columns of texts that are named like the new ones are left out.
    """
    texts = texts.select(*[c for c in texts.columns if c not in ADDED])
    shared = texts.sparkSession.sparkContext.broadcast(models)  # grows with the distinct sequences of the documents
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(segmenter(lambda: shared.value), f"{kept}, seg_no int, lang string, confidence double, n_letters int, n_segments int")


def label_code(label: Column) -> Column:
    """The language a label names, in lower case, without region and script."""
    return F.lower(F.substring_index(F.regexp_replace(F.trim(F.coalesce(label, F.lit(""))), "_", "-"), "-", 1))
