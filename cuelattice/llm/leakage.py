"""Problem 6: passages of held-out items inside documents.

Documents and items are cut to their letters, whose sequences of WIDTH, hashed to DIMENSIONS columns,
are weighted by TF-IDF over all documents. A randomised SVD of the documents' passages, its pass
over all of them summed up as a matrix of constant size, gives RANK latent directions.

Search: a document's windows, one every STEP letters, are compared by cosine with the windows of the
items, one at each letter. An index of the items' windows, tables of the signs of their latent
coordinates, gives those to compare. Windows are so short that any run of the least length that
document and item share holds a whole window of the document. The item has a window of the very same
letters, whose latent vector is the same to the last bit, so it is in the same cells of the index and
its cosine is 1: no run is lost, whatever lies around it.

Checks: around windows of equal letters the common run is followed to both sides and counts from 40
letters on (20 for items in ja, zh or ko). Items whose windows are near without such a run may be
paraphrased: there the longest common subsequence of the item and the stretch of the document beside
it decides, and whether the stretch has what is rare in the item, its answer.

Items come in blocks of bounded size, each shared with all tasks for a search of all documents.
Defined results: null texts and texts shorter than a run leak nothing; a document with several ids
is reported with each; texts are read whole, long ones in pieces that overlap by more than a run.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.langmodel import DENSE
from cuelattice.session import cut_lineage, spread

RUN, DENSE_RUN = 40, 20
WIDTH = 3
BITS = 11
DIMENSIONS = 1 << BITS
RANK = 48
#: Letters of a passage of the SVD.
PASSAGE = 160
#: Letters of a part and steps between parts. A window is one part for runs of 20 letters and two parts, every
#: other step, for runs of 40: a run holds every letter of some window wherever it begins.
PART, STEP = 11, 10
#: Tables of the index, and signs that make a cell.
TABLES, CELL_BITS = 3, 16
#: Cosine from which windows are near; windows of the same letters have 1.
NEAR = 0.75
#: A paraphrase: windows of a document near to an item, share of the item in a common subsequence, and of the weight of its rare sequences.
SEVERAL, SUBSEQUENCE, ANSWER = 3, 0.7, 0.5
#: Letters of documents compared at a time, and what pieces of a long one overlap by.
PIECE, OVERLAP = 400_000, 400
#: Letters of a block of items; their windows' vectors take some 200 bytes a letter.
BLOCK_LETTERS = 200_000
OTHER = regex.compile(r"\P{L}+")
SEED = 20_240_601


def letters_of(text: str | None) -> str:
    """NFKC, lower case, letters only."""
    return OTHER.sub("", unicodedata.normalize("NFKC", text or "").lower())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def columns_of(cps: np.ndarray) -> np.ndarray:
    """Hashed column of the sequence that starts at each letter."""
    if len(cps) < WIDTH:
        return np.zeros(0, np.int64)
    cps = cps.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = cps[: len(cps) - WIDTH + 1].copy()
        for k in range(1, WIDTH):
            h = h * np.uint64(0x9E3779B97F4A7C15) + cps[k : len(cps) - WIDTH + 1 + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def letter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [letters_of(t) for t in batch.column("text").to_pylist()]
        keep = [k for k, t in enumerate(texts) if len(t) >= DENSE_RUN]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array([texts[k] for k in keep], pa.string())], names=["doc_id", "letters"])


def count_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column("letters").to_pylist():
            held += np.bincount(columns_of(code_points(text)), minlength=DIMENSIONS) > 0
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS), pa.int32()), pa.array(np.concatenate(([n], held)), pa.int64())], names=["column", "n"])


def inverse_frequency(letters: DataFrame) -> np.ndarray:
    """Weight of each column over all documents; DIMENSIONS numbers, however many documents."""
    rows = letters.select("letters").mapInArrow(count_columns, "column int, n long").groupBy("column").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(DIMENSIONS + 1)
    for row in rows:
        held[row["column"] + 1] = row["n"]
    return (np.log((1 + held[0]) / (1 + held[1:])) + 0.1).astype(np.float32)


def _add_gram(passages: list[np.ndarray], weight: np.ndarray, basis: np.ndarray, total: np.ndarray) -> None:
    """Add A'(A Q) of a few passages, as a dense block of weighted counts with rows of length one."""
    columns = np.concatenate(passages)
    row = np.repeat(np.arange(len(passages)), [len(x) for x in passages])
    dense = np.bincount(row * DIMENSIONS + columns, weight[columns], len(passages) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float32)
    dense /= np.maximum(np.sqrt(np.einsum("ij,ij->i", dense, dense)), 1e-9)[:, None]
    total += dense.T @ (dense @ basis)


def gram_product(load: Callable[[], tuple[np.ndarray, np.ndarray]], block: int = 256) -> Callable:
    """A'(A Q) of a task's passages A and a basis Q, in blocks of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, basis = load()
        total = np.zeros(basis.shape, np.float64)
        for batch in batches:
            held: list[np.ndarray] = []
            for text in batch.column("letters").to_pylist():
                columns = columns_of(code_points(text))
                held += [columns[i : i + PASSAGE] for i in range(0, len(columns), PASSAGE)]
                while len(held) >= block:
                    _add_gram(held[:block], weight, basis, total)
                    held = held[block:]
            if held:
                _add_gram(held, weight, basis, total)
        parts = [total[i : i + block].tobytes() for i in range(0, len(total), block)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(np.random.default_rng().integers(0, 64, len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "salt", "part"])

    return run


def add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the parts of each block, of rows in any order."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block, salt, part in zip(*(c.to_pylist() for c in batch.columns)):
            value = np.frombuffer(part, np.float64)
            total[block, salt] = total[block, salt] + value if (block, salt) in total else value
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "salt", "part"])


SUM_ROW = "block int, salt int, part binary"


def multiply(letters: DataFrame, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A Q) over all passages: parts are summed in two steps, and the sum is of constant size."""
    shared = letters.sparkSession.sparkContext.broadcast((weight, basis.astype(np.float32)))
    parts = letters.select("letters").mapInArrow(gram_product(lambda: shared.value), SUM_ROW)
    for keys in (("block", "salt"), ("block",)):
        parts = parts.repartition(16, *keys).mapInArrow(add_parts, SUM_ROW)
    rows = sorted(parts.collect(), key=lambda r: r["block"])
    if not rows:  # no documents
        return np.zeros(basis.shape)
    return np.concatenate([np.frombuffer(r["part"], np.float64) for r in rows]).reshape(basis.shape)


def latent_directions(letters: DataFrame, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors of the weighted passages, from one pass over them.

    The pass applies A'A to a random basis; the vectors are those of the low-rank matrix that has
    the same image of the basis, a little shifted to keep the small factorisation stable.
    """
    basis, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((DIMENSIONS, rank)))
    image = multiply(letters, weight, basis)
    shift = np.sqrt(DIMENSIONS) * 1e-9 * max(1.0, float(np.linalg.norm(image)))
    image = image + shift * basis
    core = basis.T @ image
    factor = np.linalg.cholesky((core + core.T) / 2)
    vectors, _, _ = np.linalg.svd(np.linalg.solve(factor, image.T).T, full_matrices=False)
    return vectors.astype(np.float32)


Item = tuple[int, str, str]


class Texts:
    """Texts in one array of letters, with one between them that no other text has."""

    def __init__(self, texts: list[str], between: int):
        parts = [x for t in texts for x in (code_points(t), np.array([between], np.uint32))]
        self.letters = np.concatenate([np.array([between], np.uint32), *parts]) if parts else np.array([between], np.uint32)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = 1 + np.cumsum(self.length + 1) - self.length - 1
        self.columns = columns_of(np.concatenate((self.letters, np.zeros(WIDTH, np.uint32))))


def grid(length: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and offset of every window of a width, one each step."""
    n = np.maximum(0, (length - width) // step + 1)
    text = np.repeat(np.arange(len(length)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step


def piece_sums(weighted: np.ndarray, columns: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Latent vector of the PART letters from each place on; the same for the same letters, to the last bit."""
    total = weighted[columns[at]]
    for k in range(1, PART - WIDTH + 1):
        total += weighted[columns[at + k]]
    return total


class Kind:
    """The windows of the items that ask for runs of one length, and the index of their latent vectors."""

    def __init__(self, index: ItemIndex, parts: int, wanted: np.ndarray):
        self.parts, self.run = parts, 2 * STEP * parts
        self.width = PART + STEP * (parts - 1)
        text, offset = grid(np.where(wanted, index.texts.length, 0), self.width, 1)
        self.item, self.at = text, index.texts.start[text] + offset
        self.vectors = sum(piece_sums(index.weighted, index.texts.columns, self.at + STEP * k) for k in range(parts))
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.middle = np.median(self.vectors, axis=0) if len(self.at) else np.zeros(index.weighted.shape[1], np.float32)
        self.order, self.first = [], []
        for cells in self.cells(self.vectors):
            self.order.append(np.argsort(cells, kind="stable"))
            self.first.append(np.searchsorted(cells[self.order[-1]], np.arange((1 << CELL_BITS) + 1)))

    def cells(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """The cell of each vector in each table: the signs of every TABLES-th coordinate beside the items' middle."""
        signs = vectors > self.middle
        for t in range(TABLES):
            yield (signs[:, t::TABLES][:, :CELL_BITS] @ (1 << np.arange(CELL_BITS))).astype(np.int64)

    def near(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of vectors and windows of items that share a cell and are near: their places and cosine."""
        keys = []
        for cells, order, first in zip(self.cells(vectors), self.order, self.first):
            n = first[cells + 1] - first[cells]
            mine = np.repeat(np.arange(len(cells)), n)
            place = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + first[cells][mine]
            keys.append(mine * len(self.at) + order[place])
        key = np.unique(np.concatenate(keys))
        a, b = key // max(1, len(self.at)), key % max(1, len(self.at))
        size = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        out = []
        for low in range(0, len(key), 1 << 16):
            x, y = a[low : low + (1 << 16)], b[low : low + (1 << 16)]
            length = size[x] * self.norm[y]
            cosine = np.where(length > 0, np.einsum("ij,ij->i", vectors[x], self.vectors[y]) / np.maximum(length, 1e-30), 1.0)
            kept = cosine >= NEAR
            out.append((x[kept], y[kept], cosine[kept]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (a, b, np.zeros(0))


class ItemIndex:
    """A block of items, ready to be searched."""

    def __init__(self, items: list[Item], weight: np.ndarray, directions: np.ndarray):
        self.ids = [i for i, _, _ in items]
        self.weight = weight
        self.weighted = (weight[:, None] * directions).astype(np.float32)
        self.texts = Texts([t for _, t, _ in items], 0x110001)
        dense = np.array([lang in DENSE for _, _, lang in items], bool)
        self.kinds = [Kind(self, parts, wanted) for parts, wanted in ((1, dense), (2, ~dense)) if wanted.any()]

    def letters(self, item: int) -> str:
        low = self.texts.start[item]
        return self.texts.letters[low : low + self.texts.length[item]].astype("<u4").tobytes().decode("utf-32-le")

    def search(self, pieces: list[str], paraphrases: bool) -> list[tuple[int, int, float, str, float]]:
        """Piece, item, best cosine, kind and share of the common subsequence of each leak."""
        texts = Texts(pieces, 0x110002)
        text, offset = grid(texts.length, PART, STEP)
        at = texts.start[text] + offset
        sums = piece_sums(self.weighted, texts.columns, at)
        found: list[tuple[int, int, float, str, float]] = []
        for kind in self.kinds:
            # windows of two parts begin at every other step and end inside their text
            heads = np.arange(len(at)) if kind.parts == 1 else np.flatnonzero((text[:-1] == text[1:]) & (offset[:-1] % (2 * STEP) == 0)) if len(at) else np.zeros(0, np.int64)
            if not len(heads) or not len(kind.at):
                continue
            x, y, cosine = kind.near(sums[heads] if kind.parts == 1 else sums[heads] + sums[heads + 1])
            x = heads[x]
            pair = text[x] * len(self.ids) + kind.item[y]
            runs = common_runs(texts.letters, at[x], self.texts.letters, kind.at[y], kind.width, kind.run)
            best: dict[int, float] = {}
            for p in np.unique(pair[runs >= kind.run]).tolist():
                best[p] = 1.0
            found += [(p // len(self.ids), p % len(self.ids), 1.0, "run", 1.0) for p in best]
            if paraphrases:
                found += self._paraphrased(pieces, text, offset, x, y, cosine, pair, best, kind)
        return found

    def _paraphrased(self, pieces, text, offset, x, y, cosine, pair, exact, kind) -> list[tuple[int, int, float, str, float]]:
        """Items with several near windows in a stretch of a document, by their subsequence and rare sequences."""
        found = []
        order = np.lexsort((-cosine, pair))
        heads = np.flatnonzero(np.append(True, pair[order][1:] != pair[order][:-1])) if len(order) else np.zeros(0, np.int64)
        for low, high in zip(heads.tolist(), [*heads[1:].tolist(), len(order)]):
            rows = order[low:high]
            p = int(pair[rows[0]])
            item = p % len(self.ids)
            if p in exact or len(np.unique(x[rows])) < SEVERAL:
                continue
            wanted, said, best = self.letters(item), pieces[p // len(self.ids)], rows[0]
            begins = int(offset[x[best]] - (kind.at[y[best]] - self.texts.start[item]))
            spare = len(wanted) // 4
            stretch = said[max(0, begins - spare) : max(0, begins + len(wanted) + spare)]
            share = common_subsequence(wanted, stretch) / max(1, len(wanted))
            if share >= SUBSEQUENCE and self._answered(wanted, stretch):
                found.append((p // len(self.ids), item, float(cosine[best]), "paraphrase", share))
        return found

    def _answered(self, wanted: str, stretch: str) -> bool:
        """Whether a stretch has most of the weight of the item's rarest sequences."""
        mine, other = columns_of(code_points(wanted)), columns_of(code_points(stretch))
        rare = np.unique(mine)
        rare = rare[np.argsort(-self.weight[rare], kind="stable")][: max(1, len(rare) // 4)]
        return float(self.weight[rare[np.isin(rare, other)]].sum()) >= ANSWER * float(self.weight[rare].sum())


def common_runs(one: np.ndarray, at: np.ndarray, two: np.ndarray, place: np.ndarray, width: int, most: int) -> np.ndarray:
    """Letters of the common run around windows of two arrays of letters, 0 where the windows differ; followed for most letters to each side."""
    run = np.zeros(len(at), np.int64)
    alive = np.arange(len(at))
    for k in range(width):
        alive = alive[one[at[alive] + k] == two[place[alive] + k]]
    run[alive] = width
    for step, begin in ((1, width), (-1, -1)):
        now = alive
        for k in range(most):
            now = now[one[at[now] + begin + step * k] == two[place[now] + begin + step * k]]
            if not len(now):
                break
            run[now] += 1
    return run


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bits of whole numbers."""
    places: dict[str, int] = {}
    for k, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        hit = row & places.get(letter, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def search(load: Callable[[], tuple], paraphrases: bool) -> Callable:
    """doc_id, letters -> doc_id, item_id, similarity, kind, subsequence of the leaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, directions = load()
        index = ItemIndex(items, weight, directions)
        for batch in batches:
            found: list[tuple[int, int, float, str, float]] = []
            held: list[str] = []
            rows: list[int] = []
            total = 0
            texts = batch.column("letters").to_pylist()
            for row, text in enumerate(texts):
                for low in range(0, max(1, len(text) - OVERLAP), PIECE):  # a long text in pieces that overlap by more than a run
                    held.append(text[low : low + PIECE + OVERLAP])
                    rows.append(row)
                    total += len(held[-1])
                    if total >= PIECE:
                        found += [(rows[p], *rest) for p, *rest in index.search(held, paraphrases)]
                        held, rows, total = [], [], 0
            found += [(rows[p], *rest) for p, *rest in index.search(held, paraphrases)] if held else []
            best: dict[tuple[int, int], tuple] = {}
            for row, item, cosine, kind, share in found:
                key = (row, index.ids[item])
                best[key] = max(best.get(key, (False,)), (kind == "run", cosine, share, kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([r for r, _ in best], pa.int64())), pa.array([i for _, i in best], pa.int64())]
                + [pa.array([v[k] for v in best.values()], t) for k, t in ((1, pa.float64()), (3, pa.string()), (2, pa.float64()))],
                names=["doc_id", "item_id", "similarity", "kind", "subsequence"],
            )

    return run


def item_blocks(items: DataFrame) -> Iterator[list[Item]]:
    """The items in blocks of at most BLOCK_LETTERS letters, or of one item; one block at a time is on the driver."""
    rows = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text", F.coalesce("lang", F.lit("")).alias("lang")).distinct().orderBy("item_id", "text", "lang")
    block, size = [], 0
    for row in rows.toLocalIterator():
        letters = letters_of(row["text"])
        if block and size + len(letters) > BLOCK_LETTERS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], letters, row["lang"]))
        size += len(letters)
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, paraphrases: bool = True) -> DataFrame:
    """Documents and the items that leaked into them: doc_id, item_id, similarity of the closest windows, kind, subsequence.

    kind is run for a common run of letters, paraphrase for an item that is there without one;
    subsequence is the share of the item's letters in a common subsequence, 1 for runs.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull())).mapInArrow(letter_rows, f"doc_id {kind}, letters string")
    letters = cut_lineage(rows)
    weight = inverse_frequency(letters)
    directions = latent_directions(letters, weight)
    schema = f"doc_id {kind}, item_id long, similarity double, kind string, subsequence double"
    found: DataFrame | None = None
    for block in item_blocks(items):
        shared = documents.sparkSession.sparkContext.broadcast((block, weight, directions))
        now = letters.mapInArrow(search(lambda shared=shared: shared.value, paraphrases), schema)
        found = now if found is None else found.unionByName(now)
    return documents.sparkSession.createDataFrame([], schema) if found is None else found.distinct()
