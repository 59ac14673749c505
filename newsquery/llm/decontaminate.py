"""Benchmark decontamination: rare n-gram seeds join texts to test items, and Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ngram_hashes, words_of

#: Alignment: an equal word, another word in its place, a word too many or too few.
MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """(score, equal words, begin, end) of the best local alignment of two rows of word hashes; begin and end in ``text``.

    Row by row; what a gap along the row carries is a running maximum, so each row is a few vector operations.
    """
    m, n = len(item), len(text)
    if not m or not n:
        return 0, 0, 0, 0
    h = np.zeros((m + 1, n + 1), np.int32)
    slope = np.arange(1, n + 1, dtype=np.int32) * -GAP
    for i in range(1, m + 1):
        equal = text == item[i - 1]
        best = np.maximum(h[i - 1, :-1] + np.where(equal, MATCH, MISMATCH), h[i - 1, 1:] + GAP)
        best = np.maximum(best, 0)
        h[i, 1:] = np.maximum.accumulate(best + slope) - slope
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, end, equal = int(h[i, j]), int(j), 0
    while i and j and h[i, j] > 0:
        same = item[i - 1] == text[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            equal += bool(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, equal, int(j), end


class Items:
    """The words and seeds of a block of test items."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int):
        self.n = n
        words, _, _, ends, _ = words_of([t for _, t in rows], letters_only=True)
        self.ids = [i for i, _ in rows]
        self.words = np.split(words, ends[:-1]) if rows else []
        self.vocabulary = [np.unique(w) for w in self.words]
        seeds, owner, place = [], [], []
        for k, w in enumerate(self.words):
            g = ngram_hashes(w, min(n, max(1, len(w)))) if len(w) else np.empty(0, np.uint64)
            seeds.append(g)
            owner += [k] * len(g)
            place += range(len(g))
        self.seed = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        self.owner, self.place = np.array(owner, np.int64), np.array(place, np.int64)
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})
        self.distinct = np.unique(self.seed)

    def choose(self, df: np.ndarray, rare: float, docs: int) -> None:
        """Keeps of each item the seeds in at most ``rare`` of the documents, and enough others to find every kind of copy.

        Those are the rarer half of its seeds and the rarer one of each two neighbours, so that a copy of any part
        of the item holds some, and all seeds of an item that has no rare one, as thousands of documents hold it.
        """
        of = df[np.searchsorted(self.distinct, self.seed)] if len(self.seed) else np.empty(0)
        keep = of <= rare * docs
        ends = np.searchsorted(self.owner, np.arange(len(self.words) + 1))
        for lo, hi in zip(ends.tolist(), ends[1:].tolist()):
            if not keep[lo:hi].any():
                keep[lo:hi] = True
                continue
            keep[lo + np.argsort(of[lo:hi], kind="stable")[: (hi - lo + 1) // 2]] = True
            first = np.arange(lo, hi - 1, 2)
            keep[np.where(of[first] <= of[first + 1], first, first + 1)] = True
        order = np.flatnonzero(keep)
        order = order[np.argsort(self.seed[order], kind="stable")]
        self.seed, self.owner, self.place = self.seed[order], self.owner[order], self.place[order]
        self.distinct = np.unique(self.seed)

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(seed's number among the distinct ones, ...) and places in the text, by size of seed."""
        for size in self.sizes:
            g = ngram_hashes(words, size)
            if len(g) and len(self.distinct):
                at = np.minimum(np.searchsorted(self.distinct, g), len(self.distinct) - 1)
                found = np.flatnonzero(self.distinct[at] == g)
                if len(found):
                    yield at[found], found

    def matches(self, words: np.ndarray, least: float) -> list[tuple[int, float, int, int, int]]:
        """(item, score, equal words, begin, end) of the items that the text holds a copy of."""
        starts: dict[int, set[int]] = defaultdict(set)
        for at, places in self.hits(words):
            low, high = np.searchsorted(self.seed, self.distinct[at], "left"), np.searchsorted(self.seed, self.distinct[at], "right")
            for p, a, b in zip(places.tolist(), low.tolist(), high.tolist()):
                for s in range(a, b):
                    starts[int(self.owner[s])].add(p - int(self.place[s]))
        out = []
        for k, begins in sorted(starts.items()):
            item = self.words[k]
            m = len(item)
            slack = m // 4 + 4
            best = (0, 0, 0, 0)
            covered = None
            for b in sorted(begins):  # seeds on about one diagonal share a window
                if covered is not None and b - covered <= slack // 2:
                    continue
                covered = b
                lo, hi = max(0, b - slack), min(len(words), b + m + 2 * slack)
                # no alignment has more equal words than the window has words of the item
                own = self.vocabulary[k]
                window = words[lo:hi]
                if np.count_nonzero(own[np.minimum(np.searchsorted(own, window), len(own) - 1)] == window) < least * m:
                    continue
                found = align(item, window)
                if found[0] > best[0]:
                    best = (found[0], found[1], found[2] + lo, found[3] + lo)
            score = best[0] / (MATCH * m)
            if score >= least:
                out.append((self.ids[k], score, best[1], best[2], best[3]))
        return out


def _texts(texts: pa.Array, rows: int) -> Iterator[list[np.ndarray]]:
    """The hashed words of each text, of ``rows`` texts at a time."""
    for at in range(0, len(texts), rows):
        words, _, _, ends, _ = words_of(texts.slice(at, rows).to_pylist(), letters_only=True)
        yield np.split(words, ends[:-1])


def _blocks(texts: DataFrame, items: DataFrame, n: int, rare: float, block_words: int, rows: int, item_col: str, item_text_col: str) -> Iterator[Items]:
    """The test items with the seeds to look for, in blocks of about ``block_words`` words.

    A pass over the corpus counts in how many documents each seed of a block stands; the driver gets one count for
    each seed of the block, as Arrow columns.
    """

    def made(rows_of: list[tuple[int, str]]) -> Items:
        block = Items(rows_of, n)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(len(block.distinct), np.int64), 0
            for batch in batches:
                for texts_words in _texts(batch.column(0), rows):
                    seen += len(texts_words)
                    for w in texts_words:
                        for at, _ in block.hits(w):
                            total[np.unique(at)] += 1
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], seen))], ["seed", "df"])

        counts = texts.mapInArrow(count, "seed long, df long").groupBy("seed").agg(F.sum("df").alias("df")).toArrow()
        seeds, found = counts.column("seed").to_numpy(), counts.column("df").to_numpy()
        df = np.zeros(len(block.distinct), np.int64)
        df[seeds[seeds >= 0]] = found[seeds >= 0]
        block.choose(df, rare, int(found[seeds < 0].sum()))
        return block

    wanted = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("item is not null and text is not null").distinct()
    rows_of, words = [], 0
    for r in wanted.orderBy("item", "text").toLocalIterator():
        rows_of.append((r["item"], r["text"]))
        words += len(r["text"].split())
        if words >= block_words:
            yield made(rows_of)
            rows_of, words = [], 0
    if rows_of:
        yield made(rows_of)


def contaminated(
    docs: DataFrame, items: DataFrame, n: int = 3, least: float = 0.5, rare: float = 1e-4, block_words: int = 1_000_000, rows: int = 256, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id, item id, score, n_equal, begin, end) of every pair of a document and a test item that it holds a copy of.

    Words are runs of letters, digits and non-ASCII bytes, A-Z in lower case. A seed is a run of n words of an item
    (all words of a shorter one). A first pass over the corpus counts the documents of each seed; the second aligns
    every item with the places where one of its kept seeds occurs. ``score`` is the alignment's score over that of
    the whole item; a pair is returned from ``least`` on. ``begin`` and ``end`` are word numbers.

    Tasks hold about ``block_words`` words of items at a time, whatever the number of items: each block takes two
    passes over the corpus. Items or documents without words or with a null text match nothing, as do items with a
    null id. Documents with a null id are compared too. Rows that repeat an id are each compared; one row is
    returned for each pair of row and item.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    schema = f"{id_col} long, {item_col} long, score double, n_equal int, begin int, end int"

    def match(block: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = (w for part in _texts(batch.column(1), rows) for w in part)
                found = [(i, *x) for i, w in zip(batch.column(0).to_pylist(), words) for x in block.matches(w, least)]
                columns = list(zip(*found)) or [()] * 6
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [id_col, item_col, "score", "n_equal", "begin", "end"])

        return run

    found = [texts.mapInArrow(match(block), schema) for block in _blocks(texts.select("text"), items, n, rare, block_words, rows, item_col, item_text_col)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def uncontaminated(docs: DataFrame, items: DataFrame, n: int = 3, least: float = 0.5, rare: float = 1e-4, block_words: int = 1_000_000, rows: int = 256, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no copy of a test item (see ``contaminated``).

    Each row is judged by its own text, whatever its id: null ids and repeated ids are no exceptions, and null and
    empty texts stay. All blocks of items are aligned in one pass.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    at_text, out = docs.columns.index(text_col), docs
    for block in _blocks(texts, items, n, rare, block_words, rows, item_col, item_text_col):

        def keep(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fine = [not block.matches(w, least) for part in _texts(batch.column(at_text), rows) for w in part]
                yield batch.filter(pa.array(fine, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
