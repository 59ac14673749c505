"""Best-fit packing: token ids are cut into pieces, and bin completion puts the pieces into sequences.

Only the number of pieces of each length decides a packing, and there are at most ``capacity`` lengths. So the
search runs over that histogram, whose size does not grow with the corpus, and yields patterns (lengths that share
a sequence) with multiplicities. Every piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import logging
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, tokenizer_path

_log = logging.getLogger(__name__)

#: Where a text may be cut before it is encoded: in front of a single space between characters that are white space in
#: no Unicode version. The byte-level pattern takes such a space with what follows it, and no match goes across it.
_CUT = re.compile(r"(?<=[!-~¡-ԧ])(?= [!-~¡-ԧ])")
#: Arrow patterns: a part as it begins behind a cut, and a text with a space that is no such place or with the mark
#: that stands for a cut meanwhile.
_BEGIN, _ODD, _MARK = r"^ [!-~¡-ԧ]", r"[^!-~¡-ԧ] | [^!-~¡-ԧ]|^ | $|\x1f", "\x1f"
#: Longer parts are encoded but not remembered, and so many are remembered by a task: bounds of memory only.
MOST_BYTES, MOST_PARTS, ROW_BYTES = 64, 1 << 18, 1 << 16


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rows of ``flat`` that begin at ``starts``, one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    number = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    place = np.repeat((starts - (ends - sizes)).astype(number), sizes)
    place += np.arange(total, dtype=number)
    return flat[place]


class _Parts:
    """The ids of the parts of texts that have been frequent of late; others are encoded."""

    def __init__(self, model, vocabulary: dict[str, int]):
        self.model = model
        # a byte-level vocabulary writes each byte as one character
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.keys, self.flat = pa.array([], pa.large_string()), np.empty(0, "<u4")
        self.sizes, self.scores = np.empty(0, np.int64), np.empty(0)

    def _encoded(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each part begin, how many they are)."""
        sizes, starts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        # parts that begin like those behind a cut are encoded in one row, as no match goes across their ends
        behind = pc.match_substring_regex(new, _BEGIN)
        row, at = new.filter(behind), np.flatnonzero(behind.to_numpy(zero_copy_only=False))
        ids = np.empty(0, "<u4")
        if len(row):
            lengths = pc.binary_length(row).to_numpy()
            # the library takes some hundred bytes for each byte of a call
            rows = ["".join(row[a:b].to_pylist()) for a, b in slices(lengths.tolist(), ROW_BYTES)]
            ids = np.concatenate([np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4") for text in rows])
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(lengths)) + 1
            sizes[at] = np.diff(ends, prepend=0)
            starts[at] = ends - sizes[at]
        out, total = [ids], len(ids)
        alone = np.flatnonzero(~behind.to_numpy(zero_copy_only=False))
        for i, x in zip(alone.tolist(), self.model.encode_batch_fast(new.take(pa.array(alone)).to_pylist(), add_special_tokens=False) if len(alone) else ()):
            out.append(np.array(x.ids, "<u4"))
            starts[i], sizes[i] = total, len(out[-1])
            total += len(out[-1])
        return np.concatenate(out), starts, sizes

    def ids_of(self, parts: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each part begin, how many they are) of distinct parts, which stand in the texts so often."""
        found = pc.fill_null(pc.index_in(parts, value_set=self.keys), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(found < 0)
        fresh = parts.take(pa.array(new))
        ids, starts, sizes = self._encoded(fresh)
        known = np.cumsum(self.sizes) - self.sizes
        flat = np.concatenate([self.flat, ids])
        all_starts, all_sizes = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        hit = found >= 0
        all_starts[hit], all_sizes[hit] = known[found[hit]], self.sizes[found[hit]]
        all_starts[new], all_sizes[new] = len(self.flat) + starts, sizes
        self.scores *= 0.9
        self.scores[found[hit]] += counts[hit]
        keep = np.flatnonzero(pc.binary_length(fresh).to_numpy() <= MOST_BYTES)
        self._remember(pa.concat_arrays([self.keys, fresh.take(pa.array(keep))]), flat, np.append(known, len(self.flat) + starts[keep]), np.append(self.sizes, sizes[keep]), np.append(self.scores, counts[new][keep]))
        return flat, all_starts, all_sizes

    def _remember(self, keys: pa.Array, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, scores: np.ndarray) -> None:
        if len(keys) > MOST_PARTS:
            best = np.sort(np.argpartition(-scores, MOST_PARTS)[:MOST_PARTS])
            keys, starts, sizes, scores = keys.take(pa.array(best)), starts[best], sizes[best], scores[best]
        self.keys, self.flat, self.sizes, self.scores = keys, _gathered(flat, starts, sizes), sizes, scores


@lru_cache(maxsize=2)
def id_encoder(name: str):
    """A function from an Arrow array of texts to arrays of ids, as the tokenizers library gives them for the file ``name``.

    If the file splits texts by the byte-level pattern before it merges, texts are cut at the spaces where that
    pattern ends a match (``_CUT``), and the library encodes the distinct parts that a task does not remember. Texts
    with strings of added tokens, and all texts for files of other kinds, go to the library whole. Tests hold the two
    against each other.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path(name))
    model.no_truncation()
    model.no_padding()

    def whole(texts: pa.Array) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]

    with open(tokenizer_path(name), encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    added = [x["content"] for x in spec.get("added_tokens", [])]
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") is not None or spec.get("post_processor") is not None:
        return whole
    memory = _Parts(model, spec["model"]["vocab"])

    def encode(texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string())
        special = np.zeros(len(texts), bool)
        for s in added:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) & ~special
        at = [np.flatnonzero(x) for x in (~odd & ~special, odd, special)]
        plain = pc.split_pattern(pc.replace_substring(texts.take(pa.array(at[0])), " ", _MARK + " "), _MARK)
        cut = [_CUT.split(t) for t in texts.take(pa.array(at[1])).to_pylist()]
        parts = pa.concat_arrays([plain.flatten(), pa.array(list(chain.from_iterable(cut)), pa.large_string())]).dictionary_encode()
        own = parts.indices.to_numpy()
        flat, starts, sizes = memory.ids_of(parts.dictionary, np.bincount(own, minlength=len(parts.dictionary)))
        ids, ends = _gathered(flat, starts[own], sizes[own]), np.cumsum(sizes[own])
        many = np.concatenate([plain.value_lengths().to_numpy(zero_copy_only=False), np.array([len(c) for c in cut], np.int64)]).astype(np.int64)
        stops = ends[np.cumsum(many) - 1].tolist() if len(many) else []
        out: list = [None] * len(texts)
        for i, lo, hi in zip(np.concatenate(at[:2]).tolist(), [0, *stops], stops):
            out[i] = ids[lo:hi]
        for i, x in zip(at[2].tolist(), whole(texts.take(pa.array(at[2]))) if len(at[2]) else ()):
            out[i] = x
        return out

    return encode


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole if they fit, else full pieces behind a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024, batch_bytes: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text, ``end_id`` appended; a null text counts as empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, end = id_encoder(vocabulary), np.array([end_id], "<u4")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            out: list[tuple] = []
            for a, b in slices(pc.binary_length(texts).to_pylist(), batch_bytes):
                for doc, tokens in zip(ids[a:b], encode(texts[a:b])):
                    bounds = piece_bounds(len(tokens) + 1, capacity)
                    out += [(doc, k, s, n, zlib.crc32(tokens[s : s + n])) for k, (s, n) in enumerate(bounds)]
                    out[-1] = (*out[-1][:4], zlib.crc32(end, out[-1][4]))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- bin completion over the histogram of lengths ---------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """A number of sequences that no packing goes below: over all k, the pieces too long to share with one of k or more, and what the rest cannot put beside them."""
    lengths = sorted(counts)
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in [0, *(n for n in lengths if n <= capacity // 2)]:
        big = sum(c for n, c in counts.items() if n > capacity - k)
        middle = [(n, c) for n, c in counts.items() if capacity / 2 < n <= capacity - k]
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity / 2)
        room = sum((capacity - n) * c for n, c in middle)
        best = max(best, big + sum(c for _, c in middle) + max(0, -(-(small - room) // capacity)))
    return best


def _dominated(filling: tuple[int, ...], waste: int, counts: dict[int, int], lengths: list[int]) -> bool:
    """Whether a piece left out could take the place of some of the filling's, which would fit where that piece lies.

    It must leave no more waste, or as much with fewer pieces; in the place of none, it is a piece that still fits.
    """
    one, more = 1, 0  # sums of any pieces, and of two and more, as bits
    for n in filling:
        more |= (more << n) | ((one ^ 1) << n)
        one |= one << n
    for y in lengths:
        if counts[y] > filling.count(y):
            low = max(0, y - waste)
            if (one >> low) & ((1 << (y - low)) - 1) or more >> y & 1:
                return True
    return False


def fillings(room: int, counts: dict[int, int], tolerance: int = 0) -> Iterator[tuple[int, ...] | None]:
    """All undominated ways to fill ``room`` with any number of pieces; None for each dominated one.

    First those that waste no more than ``tolerance``, the longest pieces first, so that short ones are left for what
    is hard to fill; then the others, least waste first. They are found one by one, as far as the caller reads. Only
    sums that the counts can reach are followed.
    """
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    reach = [1]  # sums that the shorter lengths reach, as bits
    for n in reversed(lengths):
        left, k, sums = min(counts[n], room // n), 1, reach[-1]
        while left:
            k = min(k, left)
            sums |= (sums << (k * n)) & mask
            left, k = left - k, 2 * k
        reach.append(sums)
    reach.reverse()

    def within(i: int, r: int, slack: int) -> Iterator[tuple[int, ...]]:
        """The fillings by lengths from the i-th on whose sum is at most r and at least r - slack."""
        low = max(0, r - slack)
        window = (1 << (r - low + 1)) - 1
        for j in range(i, len(lengths)):
            if not (reach[j] >> low) & window:
                return
            n = lengths[j]
            for k in range(min(counts[n], r // n), 0, -1):
                left = r - k * n
                if (reach[j + 1] >> max(0, left - slack)) & ((1 << (min(left, slack) + 1)) - 1):
                    for rest in within(j + 1, left, slack):
                        yield (n,) * k + rest
        if not low:
            yield ()

    tolerance = min(tolerance, room)
    for top, slack in ((room, tolerance), *((t, 0) for t in range(room - tolerance - 1, -1, -1))):
        for filling in within(0, top, slack):
            yield None if _dominated(filling, room - sum(filling), counts, lengths) else filling


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns by taking the longest piece left and then, over and over, the longest that still fits."""
    counts, out = {n: c for n, c in counts.items() if c}, []
    while counts:
        lengths = sorted(counts, reverse=True)
        left, used = capacity, defaultdict(int)
        for n in lengths:
            take = min(left // n, counts[n])
            if take:
                used[n] = take
                left -= take * n
        times = min(counts[n] // k for n, k in used.items())
        out.append((tuple(n for n, k in used.items() for _ in range(k)), times))
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return out


#: What the longest pieces may waste in the orders of branches that the search tries one after the other.
TOLERANCES = (0, 1, 2, 4, 8, 16, 32)


def bin_completion(histogram: dict[int, int], capacity: int, most_nodes: int = 3000) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """([(lengths that share a sequence, number of such sequences)], lower bound).

    Branch and bound: a node takes the longest piece left, branches over all undominated fillings around it and over
    the number of equal sequences (as many as the counts allow, then halves of that: their sums are all numbers), and
    is left when its waste is more than a better packing could have. The best-fit packing is the first incumbent.
    The search runs once for each order of branches (``TOLERANCES``, see ``fillings``) until the bound is met or one
    of them has looked everywhere. Packing is NP-hard: ``most_nodes`` bounds the fillings tried in an order, never
    the pieces packed, and the result beside the bound says what may be left to gain.
    """
    histogram = {n: c for n, c in histogram.items() if c}
    bound = lower_bound(histogram, capacity)
    best = best_fit(histogram, capacity)
    for tolerance in TOLERANCES:
        if sum(t for _, t in best) == bound:
            break
        best, whole = _search(histogram, capacity, best, bound, tolerance, most_nodes)
        if whole:
            break
    return best, bound


def _search(histogram: dict[int, int], capacity: int, best: list, bound: int, tolerance: int, most_nodes: int) -> tuple[list[tuple[tuple[int, ...], int]], bool]:
    """(the best packing found, whether no better one is left to find) of one order of branches."""
    total = sum(n * c for n, c in histogram.items())
    best_n = sum(t for _, t in best)
    counts, path, nodes = dict(histogram), [], 0
    stack: list[list] = []  # of the nodes on the path: [branches left, pattern taken or None, times]
    waste = 0

    def branches(before: int) -> Iterator[tuple[tuple[int, ...], int] | None]:
        """(pattern, times), new patterns and fewer times in turn; None for a dominated or too wasteful filling."""
        own, top = dict(counts), max(counts)
        own[top] -= 1
        fewer: deque = deque()
        for filling in fillings(capacity - top, own, tolerance):
            if filling is None:
                yield None
                continue
            pattern = (top, *filling)
            more = capacity - sum(pattern)
            if before + more > (best_n - 1) * capacity - total:
                if more > tolerance:
                    break  # the others waste no less
                yield None
                continue
            times = min(counts[n] // pattern.count(n) for n in set(pattern))
            yield pattern, times
            fewer.append((pattern, times // 2))
            pattern, times = fewer.popleft()
            if times:
                yield pattern, times
                fewer.append((pattern, times // 2))
        while fewer:
            pattern, times = fewer.popleft()
            if times:
                yield pattern, times
                fewer.append((pattern, times // 2))

    def apply(pattern: tuple[int, ...], times: int) -> None:
        for n in pattern:
            left = counts.get(n, 0) + times
            if left:
                counts[n] = left
            else:
                counts.pop(n, None)

    while best_n > bound and nodes < most_nodes:
        allowed = (best_n - 1) * capacity - total
        if not counts and waste <= allowed:
            best, best_n = list(path), sum(t for _, t in path)
            continue
        if counts and (not stack or stack[-1][1] is not None) and waste <= allowed:
            stack.append([branches(waste), None, 0])
        elif not stack:
            return best, True
        top = stack[-1]
        if top[1] is not None:  # come back to it: undo
            apply(top[1], top[2])
            path.pop()
            waste -= (capacity - sum(top[1])) * top[2]
            top[1] = None
        nodes += 1
        found = next(top[0], "none left")
        if found == "none left":
            stack.pop()
            if not stack:
                return best, True
        elif found is not None:
            pattern, times = found
            apply(pattern, -times)
            path.append((pattern, times))
            waste += (capacity - sum(pattern)) * times
            top[1], top[2] = pattern, times
    return best, best_n <= bound


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces of that length a sequence, their first place) of every pattern and length."""
    used, sequence, out = defaultdict(int), 0, []
    for pattern, times in patterns:
        place = 0
        for n in dict.fromkeys(pattern):
            k = pattern.count(n)
            out.append((n, used[n], sequence, k, place))
            used[n] += k * times
            place += k * n
        sequence += times
    return sorted(out)


def pack(cut: DataFrame, capacity: int = 1024, salts: int = 32, most_nodes: int = 3000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    The driver gets one count for each length (at most ``capacity``). A piece's rank among those of its length comes
    from a window over (length, salt) plus the counts of the salts before, so a length that a third of all pieces
    share is dealt over ``salts`` tasks. Pieces of length 0 can't occur; an empty table gives an empty table.
    """
    cut = materialise(cut, "pieces").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per_salt = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns, bound = bin_completion(counts, capacity, most_nodes)
    _log.info("%d sequences, %d at least are needed", sum(t for _, t in patterns), bound)
    # at most capacity * salts rows: a bound that no corpus changes
    before = per_salt.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order).cast("long")).join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    table = np.array(slots(patterns), np.int64).reshape(-1, 5)
    step = np.int64(1) << 40
    keys = table[:, 0] * step + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * step + rank, side="right") - 1
            _, first, sequence, each, start = table[at].T
            sequence_id, offset = sequence + (rank - first) // each, start + (rank - first) % each * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence_id), pa.array(offset)], [*names, "sequence_id", "offset"])

    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Every piece of every document with its sequence and place.

    Null and empty texts are one piece, ``end_id`` alone. Null ids are kept; repeated rows are packed as often as
    they occur. Other columns of ``docs`` are not read.
    """
    return pack(pieces(docs, vocabulary, end_id, capacity), capacity)
