"""Problem 5: near-duplicate texts by the overlap of their sets of character sequences.

An exact similarity join in the manner of set relations. Texts that are equal once compared form a
class with one set. Sets list their sequences rarest first (by a sketch of counts over all sets of
constant size), and only the first ones are indexed. The list of a sequence holds its sets by size
with the position it has in them; blocks of a list are skipped by size and position, and pairs by
parity bitmaps.

Sequences that very many sets of their script hold would make lists that name the same pairs again
and again. All such sequences of a script share one list, in which a set stands once, so a pair is
looked at once. Blocks of that list are skipped by profiles: the sets' numbers of sequences of each
of TOPICS kinds. A set lacks at most as many of another's sequences as the threshold allows, so
where a block has too few of a set's kinds none of its sets is near. Kinds come from a clustering of
some texts (`kinds_of`); any division gives the same links, a good one skips more.

What is left is verified by family, sets that share their least hashes. The first set of a family
is compared in full, and its overlaps are kept. Those of a highly similar set follow from them: only
the sequences in which the two differ are looked for, and a bound on their number skips most.

Lists of sequences that more than HOT sets hold are cut into parts, and each pair of parts meets
in a task of its own, so no link is lost and no task holds a hot list. Families of more than HOT
sets are cut into parts too.

Defined results: null texts and texts below MIN_LENGTH compared characters take no part; a record
with repeated rows counts once; texts of any length are compared whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.session import cut_lineage

THRESHOLD = 0.6
MIN_LENGTH = 80
WIDTH = 3
#: Cells of the count sketch; it is the same size for any collection.
SKETCH = 1 << 20
#: 64-bit words of a set's parity bitmap.
BITMAP = 4
HOT = 20_000
BLOCK = 256
#: Lists up to this length are paired all at once.
SHORT = 64
#: Sequences in which a set may differ from the first of its family to be derived from it.
CLOSE = 48
#: A sequence is common if more than one in COMMON sets of its script hold it, and more than LEAST_COMMON sets.
COMMON = 400
LEAST_COMMON = 64
#: First characters of the scripts that have a list of common sequences each; any division is right.
SCRIPTS = np.array([0x250, 0x370, 0x400, 0x530, 0x600, 0x780, 0x900, 0xE00, 0xE80, 0x1100, 0x1200, 0x1E00, 0x2000, 0x2E80, 0xAC00, 0xD7B0])
#: 64-bit words of the second bitmap of a set in a list of common sequences.
WIDE = 8
TOPICS = 16
#: Texts, and bytes of texts, whose sequences are told at once.
SLICE, LETTERS = 1024, 1 << 20
#: Texts from which the kinds of sequences are told, and characters of each.
LEADERS, LEADING = 4096, 2000
#: Sequences, the most frequent, by which these texts are clustered.
TELLING = 4096
#: Copies of a text that one key of the join of copies holds.
COPIES = 1000
OTHER = regex.compile(r"[^\p{L}\p{Nd}]+")


def compared(text: str | None) -> str:
    """NFKC, lower case, letters and decimal digits only."""
    return OTHER.sub("", unicodedata.normalize("NFKC", text or "").lower())


def compared_if_long(text: str | None) -> str:
    """The compared form; nothing where it must be too short, as taking characters out makes it no longer."""
    form = unicodedata.normalize("NFKC", text or "").lower()
    return OTHER.sub("", form) if len(form) >= MIN_LENGTH else ""


def sequences(text: str) -> np.ndarray:
    """The distinct substrings of WIDTH characters, packed into integers without collisions."""
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(cps) < WIDTH:
        return np.zeros(0, np.uint64)
    return np.unique(cps[:-2] << np.uint64(42) | cps[1:-1] << np.uint64(21) | cps[2:])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def least_overlap(sizes: np.ndarray | int, threshold: float) -> np.ndarray:
    """Elements that two sets of together so many must share at least."""
    return np.ceil(threshold / (1 + threshold) * sizes - 1e-9).astype(np.int64)


def parity_bitmaps(row: np.ndarray, place: np.ndarray, n: int, words: int) -> np.ndarray:
    """Bits that an odd number of elements of a row fall on; the bitmaps of two sets differ by at most what the sets do."""
    odd = np.bincount(row * (words * 64) + place.astype(np.int64), minlength=n * words * 64).reshape(n, -1) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little")


def script_of(tokens: np.ndarray) -> np.ndarray:
    return np.searchsorted(SCRIPTS, (tokens >> np.uint64(42)).astype(np.int64), "right")


def family_of(text: str) -> int:
    """The same for most highly similar texts: their three least hashes."""
    hashed = mix(sequences(text))
    return int(np.bitwise_xor.reduce(np.partition(hashed, min(3, len(hashed) - 1))[:3]).view(np.int64)) if len(hashed) else 0


def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [compared_if_long(t) for t in batch.column("text").to_pylist()]
        keep = [k for k, t in enumerate(texts) if len(t) >= MIN_LENGTH]
        columns = [batch.column("rec_key").take(pa.array(keep, pa.int64())), pa.array([texts[k] for k in keep], pa.string()), pa.array([family_of(texts[k]) for k in keep], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["rec_key", "text", "family"])


def family_cells(family: np.ndarray) -> np.ndarray:
    return SKETCH + (mix(family.view(np.uint64)) & np.uint64(SKETCH - 1)).astype(np.int64)


#: Cells of sequences, of families, of scripts.
COUNTS = 2 * SKETCH + len(SCRIPTS) + 1


def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTS, np.int64)
    for batch in batches:
        sets = [sequences(text) for text in batch.column("text").to_pylist()]
        if sets:
            tokens = np.concatenate(sets)
            total += np.bincount((mix(tokens) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=COUNTS)
            total += np.bincount(family_cells(batch.column("family").to_numpy()), minlength=COUNTS)
            held = np.unique(np.repeat(np.arange(len(sets)), [len(x) for x in sets]) * (len(SCRIPTS) + 1) + script_of(tokens))
            total += np.bincount(2 * SKETCH + held % (len(SCRIPTS) + 1), minlength=COUNTS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["cell", "n"])


def count_sketch(texts: DataFrame) -> np.ndarray:
    """How many sets hold a sequence of each cell, then how many are of a family of each, then how many hold each script; COUNTS numbers, however many texts."""
    rows = texts.select("text", "family").mapInArrow(count_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(COUNTS, np.uint32)
    sketch[rows.column("cell").to_numpy()] = np.minimum(rows.column("n").to_numpy(), np.iinfo(np.uint32).max)
    return sketch


def kinds_of(texts: list[str]) -> np.ndarray:
    """The kind of the sequences of each cell (TOPICS: of none), by clusters of the texts."""
    kinds = np.full(SKETCH, TOPICS, np.uint8)
    cells = [np.unique((mix(sequences(text)) & np.uint64(SKETCH - 1)).astype(np.int64)) for text in texts]
    if not sum(map(len, cells)):
        return kinds
    used, column, n = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(cells)), [len(x) for x in cells])
    rank = np.empty(len(used), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(used))
    weighed = np.zeros((len(texts), min(len(used), TELLING)), np.float32)
    telling = rank[column] < TELLING
    weighed[row[telling], rank[column[telling]]] = np.log(len(texts) / n[column[telling]])
    weighed /= np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-9)
    # the first centres lie far from each other
    centres = weighed[:1]
    for _ in range(1, min(TOPICS, len(texts))):
        centres = np.vstack((centres, weighed[np.argmin((weighed @ centres.T).max(1))]))
    for _ in range(12):
        nearest = np.argmax(weighed @ centres.T, 1)
        sums = np.stack([weighed[nearest == k].sum(0) for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    met = np.bincount(nearest[row] * len(used) + column, minlength=len(centres) * len(used)).reshape(len(centres), -1)
    rates = met / (3 + np.bincount(nearest, minlength=len(centres)))[:, None]
    kinds[used[n > 1]] = np.argmax(rates, 0)[n > 1]
    return kinds


def part_of(number: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part of a class where something hot is cut into parts."""
    return (mix(number.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % parts


def smaller_families(family: np.ndarray, number: np.ndarray, sketch: np.ndarray, hot: int) -> np.ndarray:
    """Families of about hot sets at most: larger ones are cut by the number of the class."""
    parts = np.maximum(1, -(-sketch[family_cells(family)].astype(np.int64) // hot))
    cut = mix(family.view(np.uint64) + part_of(number, parts).astype(np.uint64)).view(np.int64)
    return np.where(parts > 1, cut, family)


def cut_families(load: Callable[[], np.ndarray], hot: int) -> Callable:
    """family, class_a, class_b, text -> the same with smaller families."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family = smaller_families(batch.column("family").to_numpy(), batch.column("class_a").to_numpy(), load(), hot)
            yield pa.RecordBatch.from_arrays([pa.array(family), *batch.columns[1:]], names=batch.schema.names)

    return run


#: Numbers only: key (a sequence, and the parts that meet where it is hot), size << 32 | position, part << 1 | whether parts differ,
#: class, its family, bitmap. In lists of common sequences also the second bitmap and the profile.
POSTING = "key long, place long, part long, class_no long, family long, " + ", ".join(f"bits{k} long" for k in range(BITMAP)) + ", more binary"
POSTED = [x.split()[0] for x in POSTING.split(", ")]


def postings(load: Callable[[], tuple[np.ndarray, np.ndarray]], threshold: float, hot: int, least: int = LEAST_COMMON) -> Callable:
    """A row for each indexed sequence of a set, one for all common sequences of a script (and each pair of parts, for what is hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kinds = load()
        of_script = sketch[2 * SKETCH :].astype(np.int64)
        bound = np.maximum(least, of_script // COMMON)
        # lists of common sequences are cut into larger parts, but into some for several tasks
        pieces = np.maximum(-(-of_script // (5 * hot)), np.minimum(4, -(-of_script // 2048)))
        for batch in batches:
            letters = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64)
            lows = np.flatnonzero(np.diff(np.arange(batch.num_rows) // SLICE + letters // LETTERS, prepend=-1)).tolist()
            for low, high in zip(lows, [*lows[1:], batch.num_rows]):
                yield indexed(batch.slice(low, high - low), sketch, kinds, bound, pieces)

    def indexed(batch: pa.RecordBatch, sketch: np.ndarray, kinds: np.ndarray, bound: np.ndarray, pieces: np.ndarray) -> pa.RecordBatch:
        number, n = batch.column("class_no").to_numpy(), batch.num_rows
        family = smaller_families(batch.column("family").to_numpy(), number, sketch, hot)
        sets = [sequences(text) for text in batch.column("text").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        starts = np.cumsum(sizes) - sizes
        row, tokens = np.repeat(np.arange(n), sizes), np.concatenate(sets)
        hashed = mix(tokens)
        cells = (hashed & np.uint64(SKETCH - 1)).astype(np.int64)
        count = sketch[cells].astype(np.int64)
        bits = parity_bitmaps(row, hashed >> np.uint64(56), n, BITMAP).view(np.int64)
        wide = parity_bitmaps(row, hashed >> np.uint64(40) & np.uint64(WIDE * 64 - 1), n, WIDE)
        profile = np.minimum(np.bincount(row * (TOPICS + 1) + kinds[cells], minlength=n * (TOPICS + 1)).reshape(n, -1)[:, :TOPICS], 255).astype(np.uint8)
        more = np.concatenate((wide, profile), 1)
        # the first sequences of each set, rarest first
        shown = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
        first = np.concatenate([start + np.lexsort((hashed[start : start + size], count[start : start + size]))[:k] for start, size, k in zip(starts.tolist(), sizes.tolist(), shown.tolist())])
        row, at = row[first], np.arange(len(first)) - np.repeat(np.cumsum(shown) - shown, shown)
        script = script_of(tokens[first])
        common = count[first] > bound[script]
        _, earliest = np.unique(row[common] * (len(SCRIPTS) + 1) + script[common], return_index=True)
        rare, shared = np.flatnonzero(~common), np.flatnonzero(common)[earliest]
        kept = np.concatenate((rare, shared))
        token = np.concatenate((hashed[first[rare]], mix(mix(script[shared].astype(np.uint64) + np.uint64(1 << 50)))))
        parts = np.concatenate((np.maximum(1, -(-count[first[rare]] // hot)), pieces[script[shared]]))
        # what is hot is written once for each part that the set's own part has to meet
        again = np.repeat(np.arange(len(kept)), parts)
        other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        of, at, parts = row[kept][again], at[kept][again], parts[again]
        mine = part_of(number[of], parts)
        meeting = (np.minimum(mine, other) << 32 | np.maximum(mine, other)).astype(np.uint64)
        key = np.where(parts > 1, token[again] ^ mix(mix(meeting + np.uint64(1))), token[again])
        columns = [key.view(np.int64), sizes[of] << 32 | at, mine << 1 | (mine != other), number[of], family[of], *bits[of].T]
        with_more = again >= len(rare)
        ends = np.concatenate(([0], np.cumsum(with_more * more.shape[1]))).astype(np.int32)
        valid = pa.array(with_more).buffers()[1]
        made = pa.Array.from_buffers(pa.binary(), len(again), [valid, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(more[of[with_more]]))])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns] + [made], names=POSTED)

    return run


def boxed(points: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which each size of them lie close together: halves by the column that differs most."""
    order, todo = np.arange(len(points)), [(0, len(points))]
    while todo:
        low, high = todo.pop()
        if high - low <= size:
            continue
        of = points[order[low:high]]
        middle = size * -(-(high - low) // (2 * size))
        order[low:high] = order[low:high][np.argpartition(of[:, np.argmax(of.std(0))], middle)]
        todo += [(low, low + middle), (low + middle, high)]
    return order


class Lists:
    """Rows of whole lists, each sorted by size; finds the pairs of their sets that may be near."""

    def __init__(self, rows: dict[str, np.ndarray], threshold: float):
        self.threshold = threshold
        self.size, self.at, self.bits, self.part, self.crossing = (rows[c] for c in ("size", "at", "bits", "part", "crossing"))
        self.common, self.more = rows.get("common"), rows.get("more")
        self.left = self.size - self.at
        # the smaller set of a pair shows a common sequence earlier than the larger one has to
        self.early = self.at < self.size - np.ceil(2 * threshold / (1 + threshold) * self.size - 1e-9) + 1

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows, a before b, may reach the threshold by size, position and bitmap."""
        sums = self.size[a] + self.size[b]
        need = least_overlap(sums, self.threshold)
        fits = self.early[a] & (self.size[a] >= self.threshold * self.size[b] - 1e-9) & (np.minimum(self.left[a], self.left[b]) >= need)
        fits &= ~self.crossing[a] | (self.part[a] != self.part[b])
        at = np.flatnonzero(fits)
        apart = np.bitwise_count(self.bits[a[at]] ^ self.bits[b[at]]).sum(1, dtype=np.int64)
        return at[apart <= sums[at] - 2 * need[at]]

    def short(self, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of lists of at most SHORT rows: all rows with the next one, then with the one after that, and so on."""
        out = []
        rows = np.repeat(starts, ends - starts) + np.arange((ends - starts).sum()) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
        end = np.repeat(ends, ends - starts)
        for step in range(1, SHORT):
            kept = rows + step < end
            if not kept.any():
                break
            rows, end = rows[kept], end[kept]
            good = self.fitting(rows, rows + step)
            out.append((rows[good], rows[good] + step))
        return out

    def long(self, start: int, end: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one list in blocks; those of sets too large, or that meet the sequence too late, are skipped as a whole."""
        t, out = self.threshold, []
        share, spare = t / (1 + t) * self.size, (1 - t) / (1 + t) * self.size
        crossing = self.crossing[start:end].any()
        late = self.left - share + 1e-6  # a pair needs as many elements left in both sets as both sizes ask for
        for low in range(start, end, BLOCK):
            rows = np.arange(low, min(low + BLOCK, end))
            rows = rows[self.early[rows]]
            if not len(rows):
                continue
            for first in range(low, end, BLOCK):
                last = min(first + BLOCK, end)
                if self.size[first] * t > self.size[rows[-1]] + 1e-9:
                    break
                if min(self.left[rows].max(), self.left[first:last].max()) < least_overlap(int(self.size[rows[0]] + self.size[first]), t):
                    continue
                fits = (late[rows][:, None] >= share[None, first:last]) & (late[None, first:last] >= share[rows][:, None])
                if first < rows[-1]:
                    fits &= np.arange(first, last)[None, :] > rows[:, None]
                if crossing:
                    fits &= ~self.crossing[rows][:, None] | (self.part[rows][:, None] != self.part[None, first:last])
                if not fits.any():
                    continue
                apart = np.zeros(fits.shape, np.uint16)
                for word in range(BITMAP):
                    apart += np.bitwise_count(self.bits[rows, word][:, None] ^ self.bits[None, first:last, word])
                a, b = np.nonzero(fits & (apart <= spare[rows][:, None] + spare[None, first:last] + 1e-6))
                if len(a):
                    a, b = rows[a], b + first
                    good = self.fitting(a, b)
                    out.append((a[good], b[good]))
        return out


    def shared(self, start: int, end: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a list of common sequences, where every set stands once: by profiles in blocks, then by both bitmaps."""
        t, out, held, waiting = self.threshold, [], [], 0
        need, spare = t / (1 + t), (1 - t) / (1 + t)
        rows = np.arange(start, end)
        profile = self.more[start:end, WIDE * 8 :].astype(np.int16)
        points = np.column_stack((profile, self.size[rows] * need)).astype(np.float32)
        crossing = self.crossing[start]
        mine = self.part[rows] == self.part[start]
        sides = [rows[x][boxed(points[x], BLOCK)] for x in ((mine, ~mine) if crossing else (mine,))]
        ones, twos = sides[0], sides[-1]
        blocks = [self.blocks(x, profile[x - start]) for x in sides]
        (_, size_x, small_x, large_x, own_x, least_x, most_x), (_, size_y, small_y, large_y, own_y, least_y, most_y) = blocks[0], blocks[-1]
        words = np.ascontiguousarray(self.bits[twos].T)
        spare_x, spare_y = (np.ceil(spare * x - 1e-6).astype(np.uint16) for x in (size_x, size_y))
        buffers = np.empty(BLOCK * BLOCK, np.uint64), np.empty(BLOCK * BLOCK, np.uint8), np.empty(BLOCK * BLOCK, np.uint8)
        for k, low in enumerate(range(0, len(ones), BLOCK)):
            some = slice(low, low + BLOCK)
            # rows that may have a partner in a block of the other side; then rows of the other side that may have one in this block
            fits = self.may_meet(size_x[some], own_x[some], small_y, large_y, least_y, most_y)
            back = self.may_meet(size_y, own_y, small_x[k : k + 1], large_x[k : k + 1], least_x[k : k + 1], most_x[k : k + 1])[:, 0]
            for at in np.flatnonzero(fits.any(0)).tolist():
                if not crossing and at < k:
                    continue
                x = low + np.flatnonzero(fits[:, at])
                y = at * BLOCK + np.flatnonzero(back[at * BLOCK : (at + 1) * BLOCK])
                if not len(y):
                    continue
                shape = (len(x), len(y))
                mixed, counted, apart = (b[: len(x) * len(y)].reshape(shape) for b in buffers)
                mine, theirs = self.bits[ones[x]], words[:, y]
                for word in range(BITMAP):
                    np.bitwise_xor(mine[:, word][:, None], theirs[word][None, :], out=mixed)
                    np.bitwise_count(mixed, out=counted if word else apart)
                    if word:
                        np.add(apart, counted, out=apart)  # 256 becomes 0: such a pair is kept here, and falls below
                limit_x, limit_y = spare_x[x], spare_y[y]
                if int(limit_x.max()) + int(limit_y.max()) < 256:
                    limit_x, limit_y = limit_x.astype(np.uint8), limit_y.astype(np.uint8)
                found = np.flatnonzero(apart <= limit_x[:, None] + limit_y[None, :])
                a, b = x[found // len(y)], y[found % len(y)]
                if not crossing and at == k:
                    a, b = a[b > a], b[b > a]
                if len(a):
                    held.append((ones[a], twos[b]))
                    waiting += len(a)
            if waiting and (waiting > 1 << 16 or low + BLOCK >= len(ones)):
                a, b = (np.concatenate(x) for x in zip(*held))
                a, b = np.minimum(a, b), np.maximum(a, b)
                good = self.fitting(a, b)
                a, b = a[good], b[good]
                sums = self.size[a] + self.size[b]
                wide = np.bitwise_count(self.more[a, : WIDE * 8] ^ self.more[b, : WIDE * 8]).sum(1, dtype=np.int64)
                good = wide <= sums - 2 * least_overlap(sums, t)
                out.append((a[good], b[good]))
                held, waiting = [], 0
        return out

    def blocks(self, rows: np.ndarray, profile: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sizes of the rows and the range of each block, profiles and the range of each block."""
        lows, size = np.arange(0, len(rows), BLOCK), self.size[rows]
        return rows, size, *(f.reduceat(size, lows) for f in (np.minimum, np.maximum)), profile, *(f.reduceat(profile, lows) for f in (np.minimum, np.maximum))

    def may_meet(self, size: np.ndarray, own: np.ndarray, small: np.ndarray, large: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which rows may have a partner in which blocks, by sizes and by the sequences of each kind that one set must lack."""
        t, size = self.threshold, size[:, None]
        need = t / (1 + t)
        lacks, extra = (np.zeros((len(own), len(most)), np.int16) for _ in range(2))
        for k in range(TOPICS):
            lacks += np.maximum(own[:, k, None] - most[None, :, k], 0)
            extra += np.maximum(least[None, :, k] - own[:, k, None], 0)
        fits = (lacks <= size - need * (size + np.maximum(small[None, :], t * size)) + 1e-6) & (extra <= large[None, :] - need * (size + large[None, :]) + 1e-6)
        return fits & (size >= t * small[None, :] - 1e-6) & (size * t <= large[None, :] + 1e-6)


CANDIDATE = "class_a long, class_b long, family long"


def join_lists(threshold: float) -> Callable:
    """Rows sorted by key and size -> candidate pairs of classes, with the family of the first."""

    def pairs(rows: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        lists = Lists(rows, threshold)
        many = ends - starts > 1
        starts, ends = starts[many], ends[many]
        short = ends - starts <= SHORT
        found = lists.short(starts[short], ends[short])
        for low, high in zip(starts[~short].tolist(), ends[~short].tolist()):
            found += (lists.shared if lists.common[low:high].all() and len(set(lists.crossing[low:high].tolist())) == 1 else lists.long)(low, high)
        if not found:
            return None
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        one, two = rows["class_no"][a], rows["class_no"][b]
        swap = one > two
        family = np.where(swap, rows["family"][b], rows["family"][a])
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        order = np.lexsort((two, one))
        one, two, family = one[order], two[order], family[order]
        new = one != two
        new[1:] &= (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        return pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (one, two, family)], names=["class_a", "class_b", "family"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {c: batch.column(c).to_numpy() for c in ("key", "class_no", "family")}
            place, part = batch.column("place").to_numpy(), batch.column("part").to_numpy()
            now |= {"size": place >> 32, "at": place & 0xFFFFFFFF, "part": part >> 1, "crossing": (part & 1) > 0}
            now["bits"] = np.stack([batch.column(f"bits{k}").to_numpy() for k in range(BITMAP)], 1).view(np.uint64)
            more = batch.column("more")
            now["common"] = more.is_valid().to_numpy(zero_copy_only=False)
            now["more"] = np.zeros((batch.num_rows, WIDE * 8 + TOPICS), np.uint8)
            if now["common"].any():
                now["more"][now["common"]] = np.frombuffer(b"".join(more.drop_null().to_pylist()), np.uint8).reshape(-1, WIDE * 8 + TOPICS)
            if held is not None:
                now = {c: np.concatenate((held[c], now[c])) for c in now}
            new = np.ones(len(now["key"]), bool)
            new[1:] = now["key"][1:] != now["key"][:-1]
            starts = np.flatnonzero(new)
            if len(starts) > 1 and (made := pairs(now, starts[:-1], starts[1:])) is not None:
                yield made
            held = {c: v[starts[-1] :] for c, v in now.items()}
        if held is not None and (made := pairs(held, np.zeros(1, np.int64), np.array([len(held["key"])]))) is not None:
            yield made

    return run


def letters_of(tokens: np.ndarray) -> list[str]:
    """The packed sequences as text."""
    return [chr(x >> 42) + chr(x >> 21 & 0x1FFFFF) + chr(x & 0x1FFFFF) for x in tokens.tolist()]


class Answers:
    """Overlaps of the sets of one family with their candidates, those of later sets derived from those of the first."""

    def __init__(self, threshold: float, reuse: bool):
        self.threshold, self.reuse = threshold, reuse
        self.family: int | None = None
        self.first: np.ndarray | None = None
        self.known: dict[int, tuple[int, int]] = {}  # candidate -> overlap with the first set, size
        self.derived = self.in_full = 0

    def start(self, family: int, text: str) -> None:
        """The next set; those of a family come in turn."""
        if family != self.family:
            self.family, self.first, self.known = family, None, {}
        self.text, self.tokens = text, None

    def _open(self) -> None:
        self.tokens = sequences(self.text)
        self.gained: list[str] | None = None
        self.leads = self.first is None
        if self.leads:
            self.first = self.tokens
        elif self.reuse:
            gained, lost = (np.setdiff1d(x, y, assume_unique=True) for x, y in ((self.tokens, self.first), (self.first, self.tokens)))
            if len(gained) + len(lost) <= CLOSE:
                self.gained, self.lost = letters_of(gained), letters_of(lost)

    def similarity(self, other: int, text: str) -> float | None:
        """Of the set to a candidate, None below the threshold."""
        if self.tokens is None:
            self._open()
        mine = len(self.tokens)
        if self.gained is not None and other in self.known:
            common, size = self.known[other]
            self.derived += 1
            if common + len(self.gained) < least_overlap(mine + size, self.threshold):
                return None
            common += sum(x in text for x in self.gained) - sum(x in text for x in self.lost)
        else:
            tokens = sequences(text)
            common, size = len(np.intersect1d(self.tokens, tokens, assume_unique=True)), len(tokens)
            self.in_full += 1
            if self.leads:
                self.known[other] = common, size
        share = common / (mine + size - common)
        return share if share >= self.threshold else None


def verify(threshold: float, reuse: bool) -> Callable:
    """Rows sorted by family, class_a and class_b, first (class_b null) the text of class_a, then those of its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(threshold, reuse)
        for batch in batches:
            found = []
            for family, one, two, text in zip(*(batch.column(c).to_pylist() for c in ("family", "class_a", "class_b", "text"))):
                if two is None:
                    answers.start(family, text)
                elif (share := answers.similarity(two, text)) is not None:
                    found.append((one, two, share))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["class_a", "class_b", "similarity"])

    return run


def members(records: DataFrame) -> DataFrame:
    """records: rec_key, text -> rec_key, class_id, text (as compared), family of those that take part; a row for each row."""
    made = records.where(F.length("text") * 18 >= MIN_LENGTH).select("rec_key", "text").mapInArrow(normalise, "rec_key string, text string, family long")
    return cut_lineage(made.select("rec_key", F.sha2("text", 256).alias("class_id"), "text", "family"))


def classes_of(of: DataFrame) -> DataFrame:
    """class_no (numbers in no order), class_id, text, family of each class."""
    return cut_lineage(of.groupBy("class_id").agg(F.first("text").alias("text"), F.first("family").alias("family")).withColumn("class_no", F.monotonically_increasing_id()))


def leaders(classes: DataFrame) -> list[str]:
    """Texts with the least hashes; only how fast the join is depends on them."""
    rows = classes.select(F.xxhash64("text").alias("hash"), F.substring("text", 1, LEADING).alias("text")).orderBy("hash", "text").limit(LEADERS)
    return [r["text"] for r in rows.collect()]


def numbered_links(classes: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, reuse: bool = True, least: int = LEAST_COMMON) -> DataFrame:
    """Pairs of different classes at or above the threshold, by number: class_a < class_b, similarity."""
    context = classes.sparkSession.sparkContext
    sketch, kinds = context.broadcast(count_sketch(classes)), context.broadcast(kinds_of(leaders(classes)))
    lists = classes.select("class_no", "text", "family").mapInArrow(postings(lambda: (sketch.value, kinds.value), threshold, hot, least), POSTING)
    grouped = lists.repartition("key").sortWithinPartitions("key", "place")
    candidates = grouped.mapInArrow(join_lists(threshold), CANDIDATE).distinct()
    texts = classes.select(F.col("class_no").alias("class_b"), "text")
    asked = candidates.join(texts, "class_b").select("family", "class_a", "class_b", "text")
    own = classes.select("family", F.col("class_no").alias("class_a"), F.lit(None).cast("long").alias("class_b"), "text")
    own = own.mapInArrow(cut_families(lambda: sketch.value, hot), "family long, class_a long, class_b long, text string")
    by_family = own.unionByName(asked).repartition("family").sortWithinPartitions("family", "class_a", "class_b")
    return by_family.mapInArrow(verify(threshold, reuse), "class_a long, class_b long, similarity double")


def class_links(of: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, reuse: bool = True, least: int = LEAST_COMMON) -> DataFrame:
    """Pairs of different classes at or above the threshold: class_a < class_b, similarity."""
    classes = classes_of(of)
    links = numbered_links(classes, threshold, hot, reuse, least)
    ids = classes.select("class_no", "class_id")
    named = links.join(ids.toDF("class_a", "x"), "class_a").join(ids.toDF("class_b", "y"), "class_b")
    return named.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity")


def near_duplicates(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of records at or above the threshold, copies too: rec_a < rec_b.

    The pairs of a text with very many copies are made by as many keys as it has COPIES of them.
    """
    of = members(records)
    classes = classes_of(of)
    links = numbered_links(classes, threshold)
    slim = cut_lineage(of.select("rec_key", "class_id").distinct().join(classes.select("class_id", "class_no"), "class_id").select("rec_key", "class_no"))
    a, b = slim.toDF("rec_x", "class_a"), slim.toDF("rec_y", "class_b")
    across = links.join(a, "class_a").join(b, "class_b").select("rec_x", "rec_y")
    parts = slim.groupBy("class_no").agg(F.count("*").alias("n")).where("n > 1").select("class_no", F.ceil(F.col("n") / COPIES).cast("int").alias("parts"))
    repeated = slim.join(parts, "class_no")
    one = repeated.select("class_no", F.col("rec_key").alias("rec_x"), F.pmod(F.xxhash64("rec_key"), F.col("parts")).cast("int").alias("salt"))
    two = repeated.select("class_no", F.col("rec_key").alias("rec_y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    copies = one.join(two, ["class_no", "salt"]).where("rec_x < rec_y").select("rec_x", "rec_y")
    return across.unionByName(copies).select(F.least("rec_x", "rec_y").alias("rec_a"), F.greatest("rec_x", "rec_y").alias("rec_b"))


def near_duplicate_classes(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every record that takes part: rec_key, class_id, n_copies (records of its class), n_links (other classes it is near to)."""
    of = members(records)
    classes = classes_of(of)
    links = numbered_links(classes, threshold)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_no")).groupBy("class_no").agg(F.count("*").alias("n_links"))
    slim = of.select("rec_key", "class_id").distinct()
    sizes = slim.groupBy("class_id").agg(F.count("*").alias("n_copies"))
    facts = classes.select("class_id", "class_no").join(ends, "class_no", "left").join(sizes, "class_id")
    return slim.join(facts, "class_id").select("rec_key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
