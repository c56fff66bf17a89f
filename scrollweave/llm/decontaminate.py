"""Benchmark decontamination by SimHash windows of the items' sizes.

Items of nearly one size form a class, and windows of its size move over every document. A window's fingerprint is the
64-bit SimHash of its word shingles. The items' fingerprints are indexed in blocks of 16 bits: two fingerprints within
``radius`` agree in some block up to ``radius // 4`` bits, and a table of each block's values tells every item so near,
so the index finds all within the radius. Found places are confirmed by the exact weighted Jaccard similarity of
shingle multisets, at all offsets around the window.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollweave.llm import _textvec as tv
from scrollweave.llm._scratch import discard, park

#: Bytes of benchmark text in one block of items, which goes to all tasks.
ITEM_BYTES = 4 << 20
BLOCKS, BITS = 4, 16
#: Largest ratio of item sizes in a class.
SPREAD = 1.2


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return tv.words(pc.utf8_lower(texts), tv.PUNCTUATION)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """The 64 bits of each shingle as a row of 0 and 1: its votes."""
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(ones: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of ``width`` shingles by the number of ones for each bit: the majority, a tie being 0."""
    return np.packbits((ones > width // 2).ravel(), bitorder="little").view(np.uint64)


def _running(shingles: np.ndarray, widest: int) -> np.ndarray:
    """Votes for 1 before each shingle. Bytes that wrap do for windows under 256 shingles: differences stay exact."""
    kind = np.uint8 if widest < 256 else np.int32
    out = np.zeros((64, len(shingles) + 1), kind)
    np.cumsum(np.ascontiguousarray(_bits(shingles).T), axis=1, dtype=kind, out=out[:, 1:])
    return np.ascontiguousarray(out.T)


class SizeClass:
    """The items of nearly one word count, from ``least`` to ``most`` shingles, and the block tables of their fingerprints."""

    def __init__(self, k: int, least: int, most: int, items: list[tuple[int, np.ndarray]], radius: int):
        self.k, self.least, self.items, self.radius = k, least, items, radius
        self.width = (least + most) // 2
        self.slack = max(self.width - least, most - self.width)
        self.stride = max(1, self.width // 6)
        prints = np.concatenate([_pack(_bits(s).sum(0, dtype=np.int64), len(s)) for _, s in items])
        values = np.arange(1 << BITS, dtype=np.uint64)
        self.tables = []
        for group in range(0, len(items), 64):
            mine = prints[group : group + 64]
            near = [np.zeros(1 << BITS, np.uint64) for _ in range(BLOCKS)]
            for b, table in enumerate(near):
                for j, x in enumerate(mine):
                    block = (x >> np.uint64(b * BITS)) & np.uint64((1 << BITS) - 1)
                    table[np.bitwise_count(values ^ block) <= radius // BLOCKS] |= np.uint64(1) << np.uint64(j)
            self.tables.append((group, mine, near))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ``(window, item)`` within the radius."""
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        windows, items = [], []
        for group, mine, near in self.tables:
            mask = near[0].take(blocks[:, 0])
            for b in range(1, BLOCKS):
                mask |= near[b].take(blocks[:, b])
            for j, x in enumerate(mine):
                hit = np.flatnonzero((mask & (np.uint64(1) << np.uint64(j))) != 0)
                hit = hit[np.bitwise_count(prints[hit] ^ x) <= self.radius]
                windows.append(hit)
                items.append(np.full(len(hit), group + j))
        return np.concatenate(windows), np.concatenate(items)

    def windows(self, running: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(starts, fingerprints)``: every ``stride``-th window of all texts, the first and the last of each."""
        count = np.diff(bounds) - self.k + 1
        grid = np.arange(0, max(0, len(running) - self.width), self.stride)
        owner = np.searchsorted(bounds, grid, "right") - 1
        inside = grid + self.width <= (bounds[:-1] + count)[owner]
        sums = running[self.width :: self.stride][: len(grid)] - running[: len(running) - self.width : self.stride][: len(grid)]
        full = count >= self.width
        ends = np.concatenate([bounds[:-1][full], (bounds[:-1] + count - self.width)[full]])
        prints = np.concatenate([_pack(sums, self.width)[inside], _pack(running[ends + self.width] - running[ends], self.width)])
        return np.concatenate([grid[inside], ends]), prints


def _shapes(items: DataFrame, k: int) -> DataFrame:
    """``(k, size, shingles)`` of each item: words and number of its shingles, and the distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tv.slices(whole, ("item",)):
                bounds, hashes = _words(batch.column("item"))
                own = [tv.rolling(hashes[a:b], int(min(k, b - a))) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
                words = [int(min(k, n)) for n in np.diff(bounds) if n]
                sets = [np.unique(s).view(np.int64) for s in own]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["k", "size", "shingles"])

    return items.select("item").mapInArrow(run, "k long, size long, shingles array<long>")


def size_classes(shapes: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """For each ``(k, size)`` the least and the largest size of its class."""
    out = {}
    for k in {k for k, _ in shapes}:
        sizes = sorted({n for own, n in shapes if own == k})
        while sizes:
            near = [n for n in sizes if n <= SPREAD * sizes[0]]
            out |= {(k, n): (near[0], near[-1]) for n in near}
            sizes = sizes[len(near) :]
    return out


class Index:
    """A block of benchmark items by size. Size classes (of ``size_classes``) and the ``shared`` shingles, ascending, with
    the number of items that each is in, are those of all items: results don't depend on the split into blocks."""

    def __init__(self, items: list[tuple[int, str]], k: int, radius: int, classes: dict[tuple[int, int], tuple[int, int]], shared: np.ndarray, often: np.ndarray):
        bounds, hashes = _words(pa.array([t for _, t in items], pa.string()))
        groups: dict[tuple[int, int, int], list[tuple[int, np.ndarray]]] = {}
        for (item, _), a, b in zip(items, bounds[:-1], bounds[1:], strict=True):
            if b > a:
                own = int(min(k, b - a))
                shingles = tv.rolling(hashes[a:b], own)
                groups.setdefault((own, *classes[own, len(shingles)]), []).append((item, shingles))
        self.shared, self.often = shared, often
        self.shingles = np.unique(np.concatenate([shared, *(s for group in groups.values() for _, s in group)]))
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.shingles >> np.uint64(48)).astype(np.int64)] = True
        self.classes = [SizeClass(*key, sorted(group, key=lambda x: (len(x[1]), x[0])), radius) for key, group in sorted(groups.items())]

    def weights(self, shingles: np.ndarray) -> dict[int, float]:
        """A shingle that several items have says less; one that is left out weighs 1."""
        if not len(self.shared):
            return {}
        place = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
        hit = self.shared[place] == shingles
        return dict(zip(shingles[hit].tolist(), (1.0 / self.often[place[hit]]).tolist(), strict=True))

    @staticmethod
    def similarity(x: np.ndarray, y: np.ndarray, weights: dict[int, float]) -> float:
        """Weighted Jaccard similarity of two shingle multisets."""
        a, b = Counter(x.tolist()), Counter(y.tolist())
        weight = weights.get
        both = sum(weight(s, 1.0) * min(n, b[s]) for s, n in a.items() if s in b)
        either = sum(weight(s, 1.0) * n for s, n in a.items()) + sum(weight(s, 1.0) * n for s, n in b.items()) - both
        return both / either if either else 0.0

    def _known(self, runs: np.ndarray) -> np.ndarray:
        """Before each shingle, how many shingles are some item's."""
        at = np.flatnonzero(self.near[(runs >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.shingles, runs[at]), len(self.shingles) - 1)
        known = np.zeros(len(runs) + 1, np.int64)
        known[at[self.shingles[place] == runs[at]] + 1] = 1
        return np.cumsum(known)

    def found(self, bounds: np.ndarray, hashes: np.ndarray, threshold: float, most: int = 1 << 17) -> Iterator[tuple[int, int, int, int, float]]:
        """``search``, a text of over ``most`` words in parts that overlap by more than any window and its surroundings, so
        that memory doesn't follow the longest text."""
        wide = max((x.width + 2 * (x.stride + x.slack) + x.k for x in self.classes), default=0)
        most = max(most, 4 * wide)
        part = [np.unique(np.append(np.arange(0, max(1, n - wide), most - wide), max(0, n - most))) if n > most else np.zeros(1, np.int64) for n in np.diff(bounds)]
        if all(len(p) == 1 for p in part):
            yield from self.search(bounds, hashes, threshold)
            return
        for text, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            best: dict[int, tuple[float, int, int]] = {}
            for start in part[text].tolist():
                own = hashes[low + start : min(high, low + start + most)]
                for _, item, at, n, sim in self.search(np.array([0, len(own)]), own, threshold):
                    best[item] = max(best.get(item, (0.0, 0, 0)), (sim, -(at + start), n))
            yield from ((text, item, -at, n, sim) for item, (sim, at, n) in best.items())

    def search(self, bounds: np.ndarray, hashes: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        """``(text, item, first word, words, similarity)``: the best place of each item in each text that reaches the
        threshold. ``bounds`` and ``hashes`` are the words of several texts."""
        made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        length = np.diff(bounds)
        for c in self.classes:
            if c.k not in made:
                runs = tv.rolling(hashes, c.k)
                made[c.k] = runs, _running(runs, max(x.width for x in self.classes)), self._known(runs)
            runs, running, known = made[c.k]
            starts, prints = c.windows(running, bounds)
            window, item = c.within(prints)
            starts, widths = starts[window], np.full(len(window), c.width)
            for text in np.flatnonzero((length - c.k + 1 < c.width) & (length >= c.k) & (length - c.k + 1 >= threshold * c.least)):
                width = int(length[text]) - c.k + 1
                _, more = c.within(_pack(running[bounds[text] + width] - running[bounds[text]], width))
                starts, item, widths = np.append(starts, np.full(len(more), bounds[text])), np.append(item, more), np.append(widths, np.full(len(more), width))
            # At the threshold the best place shares that part of the item's shingles; a window misses few of its ends.
            shared = known[np.minimum(starts + widths, len(runs))] - known[starts]
            near = np.flatnonzero(shared >= 0.5 * threshold * widths)
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for start, j in zip(starts[near].tolist(), item[near].tolist(), strict=True):
                text = int(np.searchsorted(bounds, start, "right")) - 1
                number, own = c.items[j]
                lo, end = int(bounds[text]), int(bounds[text + 1]) - c.k + 1
                width, reach = min(len(own), end - lo), c.stride + c.slack
                if best.get((text, number), (0.0,))[0] == 1.0:
                    continue
                low = max(lo, start - reach)
                for at in (low + np.flatnonzero(runs[low : start + reach + 1] == own[0])).tolist():
                    if at + len(own) <= end and np.array_equal(runs[at : at + len(own)], own):
                        best[text, number] = (1.0, at - lo, len(own) + c.k - 1)
                if best.get((text, number), (0.0,))[0] == 1.0:
                    continue
                weights = self.weights(np.concatenate([own, runs[low : start + reach + width]]))
                for at in range(low, min(start + reach, end - width) + 1):
                    sim = self.similarity(own, runs[at : at + width], weights)
                    if sim >= threshold and sim > best.get((text, number), (0.0,))[0]:
                        best[text, number] = (sim, at - lo, width + c.k - 1)
            for (text, number), (sim, at, n) in best.items():
                yield text, number, at, n, sim


#: The index that this Python worker made last, by its key: a worker serves many tasks of one block of items.
_made: dict[str, Index] = {}


def _index(key: str, *args) -> Index:
    if key not in _made:
        _made.clear()
        _made[key] = Index(*args)
    return _made[key]


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = 19, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, first_word, n_words, similarity``: each benchmark item's best place in each document row that
    holds it at ``threshold`` or more.

    Words are runs of letters and digits (with all non-ASCII characters), lower-cased. An item of fewer than
    ``shingle`` words is one shingle. Windows of n shingles start at every (n // 6)-th place, and at the first and
    last of each document; a document shorter than a window is one window.

    Items go to the tasks in blocks of ITEM_BYTES of text, however many there are; every block sees every document.
    Shingles are counted over all items, and those that several items have go to every task (16 bytes each).
    The similarity is that of an item and a window of its size, so a word put into a short item also pushes one out.

    Null and empty texts and items hold nothing, items with a null id are left out, documents with a null id give rows
    with it. Repeated items are one; repeated documents each give their rows. Other columns don't matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"
    out = None
    for index in _indexes(benchmark, shingle, radius, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], index: Callable[[], Index] = index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in tv.slices(whole, ("text",), 1 << 19):
                    ids = batch.column("doc_id").to_pylist()
                    hits = [(ids[t], *rest) for t, *rest in index().found(*_words(batch.column("text")), threshold)]
                    cols = list(zip(*hits, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == 4 else pa.int64()) for n, c in enumerate(cols)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])
            tv.release()

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _indexes(benchmark: DataFrame, shingle: int, radius: int, item_col: str, item_text_col: str) -> list[Callable[[], Index]]:
    """For each block of items a function that makes its index, or gives the one that the Python worker has."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item")).filter("item_id IS NOT NULL AND item IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // ITEM_BYTES))
    shapes = park(_shapes(items, shingle), "shapes")
    classes = size_classes([tuple(r) for r in shapes.select("k", "size").distinct().collect()])
    counts = shapes.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter("n > 1").toArrow()
    discard(shapes)
    shared, often = counts.column("s").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    order = np.argsort(shared)
    shared, often = shared[order], often[order]
    made = []
    for block in range(n_blocks):
        own = [(r.item_id, r.item) for r in items.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(n_blocks)) == block).collect()]
        made.append(partial(_index, uuid.uuid4().hex, own, shingle, radius, classes, shared, often))
    return made


def keep_clean(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = 19, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names, that hold no item: one pass without a shuffle, or one
    for each block of items.

    Rows are judged by their text alone, so null ids, ids on several texts and repeated rows are rows like others. Null
    and empty texts hold nothing and stay; an empty table stays empty.
    """
    at, names = docs.columns.index(text_col), docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))
    for index in _indexes(benchmark, shingle, radius, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], index: Callable[[], Index] = index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                texts = pa.RecordBatch.from_arrays([whole.column(at).cast(pa.string())], ["text"])
                clean, done = np.ones(whole.num_rows, bool), 0
                for batch in tv.slices(texts, ("text",), 1 << 19):
                    for text, *_ in index().found(*_words(batch.column("text")), threshold):
                        clean[done + text] = False
                    done += batch.num_rows
                yield whole.filter(pa.array(clean))
            tv.release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)
