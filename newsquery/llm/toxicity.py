"""Toxicity: Levenshtein automata run over a lexicon trie find terms and their misspellings; their context weighs them.

The lexicon (whole words and word stems) and the weights are learned from labelled rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, in_share, materialise

_TOKEN = re.compile(r"[^\W_]+")
_QUOTE = re.compile("[\"“”«»„‟]")
_LINE_END = re.compile("\n")

# Words that report what someone else said, and words that address the reader.
REPORTING = frozenset("said says quote quoted quotes wrote called word term insult slur reported according sagte schrieb zitat wort dit mot citation dijo palabra cita".split())
ADDRESSING = frozenset("you your youre u du dich dir dein ihr euch tu toi ton vous votre tú te usted vosotros".split())


class LexiconAutomaton:
    """The trie of a lexicon, intersected with Levenshtein automata of its terms.

    A state holds the trie nodes that what has been read can stand for, each with its number of edits (insertions,
    deletions, substitutions, and swaps of neighbours). States are determinised when first reached, so a token
    costs one lookup a character and most tokens die after a few. A term ending in `*` is a stem: any ending may
    follow it. ``allowed``: the most edits for each term.
    """

    def __init__(self, terms: list[str], allowed: list[int]):
        self.terms, self.allowed, self.most = terms, allowed, max(allowed, default=0)
        self.child: list[dict[str, int]] = [{}]
        self.word: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.need: list[int] = [0]  # the most edits that any term at or below the node allows
        for i, term in enumerate(terms):
            node = 0
            self.need[0] = max(self.need[0], allowed[i])
            for ch in term.rstrip("*"):
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.need.append(0)
                node = self.child[node][ch]
                self.need[node] = max(self.need[node], allowed[i])
            (self.stem if term.endswith("*") else self.word)[node] = i
        self.start = self._closed({(0, 0, "")})
        self.steps: dict[frozenset, dict[str, frozenset]] = defaultdict(dict)
        self.stems: dict[frozenset, tuple[int, int] | None] = {}

    def _closed(self, items: set[tuple[int, int, str]]) -> frozenset:
        """With deletions, and of each node and pending swap only the fewest edits."""
        todo, least = list(items), {}
        while todo:
            node, e, swap = todo.pop()
            if e > self.need[node] or least.get((node, swap), 99) <= e:
                continue
            least[node, swap] = e
            if not swap:
                todo += [(c, e + 1, "") for c in self.child[node].values()]
        return frozenset((n, e, s) for (n, s), e in least.items())

    def _step(self, state: frozenset, ch: str) -> frozenset:
        out = set()
        for node, e, swap in state:
            if swap:
                mid = self.child[node].get(ch)
                if mid is not None and swap in self.child[mid]:
                    out.add((self.child[mid][swap], e, ""))
                continue
            for x, c in self.child[node].items():
                out.add((c, e if x == ch else e + 1, ""))
                if x != ch and ch in self.child[c]:
                    out.add((node, e + 1, ch))
            out.add((node, e + 1, ""))
        return self._closed(out)

    def _best(self, state: frozenset, ends: dict[int, int]) -> tuple[int, int] | None:
        found = [(e, ends[n]) for n, e, s in state if not s and n in ends and e <= self.allowed[ends[n]]]
        return (min(found)[1], min(found)[0]) if found else None

    def match(self, token: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term that the whole token is, or whose stem it begins with; else None."""
        state, stem = self.start, None
        for ch in token:
            after = self.steps[state].get(ch)
            if after is None:
                if len(self.steps) > 50_000:  # memory only: states are found again when needed
                    self.steps.clear()
                    self.stems.clear()
                after = self.steps[state][ch] = self._step(state, ch)
                if after not in self.stems:
                    self.stems[after] = self._best(after, self.stem)
            state = after
            if not state:
                return stem
            found = self.stems[state]
            if found and (stem is None or found[1] < stem[1]):
                stem = found
        whole = self._best(state, self.word)
        return whole if whole and (stem is None or whole[1] <= stem[1]) else stem


@dataclass(frozen=True)
class ToxicityModel:
    terms: list[str]
    allowed: list[int]
    weights: np.ndarray  # of the features, the last for the constant
    most_seen: int = 200_000  # distinct tokens that a task remembers


#: Of a hit with 0, 1, 2 edits.
_BY_EDITS = (1.0, 0.8, 0.6)


class Scanner:
    """Finds the hits of a whole text; tokens once looked up are kept, up to ``most_seen`` of them."""

    def __init__(self, terms: list[str], allowed: list[int], most_seen: int = 200_000):
        self.automaton, self.most_seen = LexiconAutomaton(terms, allowed), most_seen
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def found(self, text: str) -> dict[str, tuple[int, int]]:
        """The text's distinct tokens that match a term."""
        tokens = set(_TOKEN.findall(text)) - self.clean
        out = {}
        for t in tokens:
            m = self.hits.get(t) or self.automaton.match(t)
            if m:
                self.hits[t] = out[t] = m
            else:
                self.clean.add(t)
        if len(self.clean) > self.most_seen:
            self.clean.clear()
        if len(self.hits) > self.most_seen:
            self.hits.clear()
        return out

    def scan(self, text: str | None, window: int = 6) -> list[tuple[int, int, int, int, float]]:
        """(term, edits, begin, end, weight of its context) of every hit.

        The context is ``window`` tokens to either side. A hit between quotation marks of one line, or near a
        reporting word, is taken for a quotation and weighs less; a word of address, another hit or an exclamation
        mark nearby speaks for abuse and takes that back.
        """
        if not text:
            return []
        low = text.lower()
        found = self.found(low)
        if not found:
            return []
        tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(low)]
        # places of quotation marks, and of each line's end how many marks stand before it
        quotes = [m.start() for m in _QUOTE.finditer(low)]
        ends = [*(m.start() for m in _LINE_END.finditer(low)), len(low)] if quotes else []
        until = [bisect_left(quotes, e) for e in ends]
        out = []
        for i, (t, begin, end) in enumerate(tokens):
            if t not in found:
                continue
            near = tokens[max(0, i - window) : i] + tokens[i + 1 : i + 1 + window]
            quoted = False
            if quotes:
                line = bisect_left(ends, begin)
                before = bisect_left(quotes, begin)
                quoted = (before - (until[line - 1] if line else 0)) % 2 == 1 and until[line] > before
            quotation = 0.6 * quoted + 0.4 * any(x in REPORTING for x, *_ in near)
            left, right = (near[0][1], near[-1][2]) if near else (begin, end)
            abuse = 0.4 * any(x in ADDRESSING for x, *_ in near) + 0.4 * any(x in found for x, *_ in near) + 0.2 * ("!" in low[left : right + 2])
            term, edits = found[t]
            out.append((term, edits, begin, end, 1 - 0.8 * max(0.0, quotation - 0.5 * abuse)))
        return out


def features(hits: list[tuple], words: int) -> list[float]:
    """Of a text: its strongest hit, all its hits, how many different terms, how dense they are, and a constant."""
    strength = [_BY_EDITS[e] * w for _, e, _, _, w in hits]
    kinds = {t: 0.0 for t, *_ in hits}
    for (t, *_), s in zip(hits, strength):
        kinds[t] = max(kinds[t], s)
    return [max(strength, default=0.0), float(np.log1p(sum(strength))), float(np.log1p(sum(kinds.values()))), min(1.0, 20 * sum(strength) / max(words, 1)), 1.0]


def edits_allowed(term: str) -> int:
    """By length; a learned model may allow fewer."""
    n = len(term.rstrip("*"))
    return 0 if n < 4 or term.endswith("*") and n < 7 else 1 if n < 8 else 2


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str, leave: bool) -> DataFrame:
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    if leave:
        marks = marks.filter(~held_out(F.col("id")))
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # about `sample` ids a label, never over 1.2 times that: the size bound of the broadcast
    chosen = [marks.filter(F.col("y") == y).filter(in_share("id", min(1.0, sample / n[y]))).limit(sample + sample // 5) for y in n]
    if not chosen:
        return docs.select(F.lit(0).cast("long").alias("id"), F.lit("").alias("text"), F.lit(0).alias("y")).limit(0)
    picked = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return materialise(rows.join(F.broadcast(picked), "id"), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, most_terms: int = 400, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", leave: bool = True) -> ToxicityModel:
    """Learns the lexicon and the weights from about ``sample`` labelled texts a label, chosen by a hash of their id.

    Candidates are words and word beginnings of 4 to 8 letters that are at least 20 times as frequent in toxic
    texts as in clean ones, counted in Spark. Near copies count once there (texts whose three minimal word hashes
    agree). The driver gets at most 3000 candidates and each sampled text's hits of them; it chooses greedily
    those that cover toxic texts not yet well covered, leaves edits to the terms that stay clean with them, and
    fits a logistic regression. Labels of several rows for an id: the largest counts. Null labels and texts are
    not learned from; without both labels the model has no terms and scores 0.
    """
    rows = _sampled(docs, labels, sample, id_col, text_col, label_col, leave)
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    bags = rows.select("y", words.alias("w"))
    for seed in range(3):
        bags = bags.withColumn(f"m{seed}", F.array_min(F.transform("w", lambda w: F.xxhash64(w, F.lit(seed)))))  # noqa: B023
    bags = materialise(bags.dropDuplicates(["y", "m0", "m1", "m2"]).select("y", "w"), "toxic-bags")
    totals = {r["y"]: r["n"] for r in bags.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return ToxicityModel([], [], np.array([0, 0, 0, 0, -8.0]))
    counts = bags.select("y", F.explode("w").alias("w")).groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    kinds = F.array(F.col("w"), *(F.when(F.length("w") >= k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in range(4, 9)))
    support = max(3, totals[1] // 250)
    grams = counts.filter(F.length("w") <= 40).select(F.explode(F.array_compact(kinds)).alias("f"), "t", "c").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    good = grams.filter((F.col("t") >= support) & (F.col("t") / totals[1] >= 20 * (F.col("c") + 0.5) / totals[0]))
    found = good.orderBy(F.desc("t"), F.length("f").desc(), "f").limit(3000).collect()
    # of equal counts the word goes before its stems, and a longer stem before a shorter
    found.sort(key=lambda r: (-r["t"], r["c"], r["f"].endswith("*"), -len(r["f"]), r["f"]))
    model = _weigh(rows, _cover(rows, [r["f"] for r in found], most_terms, totals[1]))
    discard(rows, bags)
    return model


def _hits(rows: DataFrame, terms: list[str], allowed: list[int]) -> list[tuple[int, int, list[tuple]]]:
    """(label, number of words, hits) of each sampled text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms, allowed)
        for batch in batches:
            out = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = scanner.scan(text)
                out.append((y, len(text.split()), [float(x) for h in hits for x in h]))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.float64()))], ["y", "n", "h"])

    got = rows.select("y", "text").mapInArrow(scan, "y int, n int, h array<double>").collect()
    return sorted((r["y"], r["n"], [(int(r["h"][i]), int(r["h"][i + 1]), int(r["h"][i + 2]), int(r["h"][i + 3]), r["h"][i + 4]) for i in range(0, len(r["h"]), 5)]) for r in got)


def _cover(rows: DataFrame, found: list[str], most: int, toxic: int) -> list[str]:
    """Candidates taken greedily by the toxic texts they add; one covered n times already counts 1 / (1 + n)^2.

    What begins with a taken candidate, or what a taken one begins with, is the same term and left out.
    """
    stems = [f.rstrip("*") for f in found]
    by_text: list[set[int]] = []
    exact = {f: i for i, f in enumerate(found) if not f.endswith("*")}
    begins = {f[:-1]: i for i, f in enumerate(found) if f.endswith("*")}

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                own = set()
                for t in set(re.findall(r"[^\W\d_]+", text.lower())):
                    if t in exact:
                        own.add(exact[t])
                    own.update(begins[t[:k]] for k in range(4, 9) if len(t) >= k and t[:k] in begins)
                out.append(sorted(own))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["i"])

    if found:
        by_text = [set(r["i"]) for r in rows.filter("y = 1").select("text").mapInArrow(which, "i array<int>").collect()]
    members = defaultdict(list)
    for d, own in enumerate(by_text):
        for i in own:
            members[i].append(d)
    covered, taken, left = np.zeros(len(by_text)), [], set(members)
    while left and len(taken) < most:
        gain = {i: float((1 / (1 + covered[members[i]]) ** 2).sum()) for i in left}
        best = max(left, key=lambda i: (round(gain[i], 9), -i))
        if gain[best] < max(2.0, toxic / 400):
            break
        taken.append(best)
        covered[members[best]] += 1
        left = {i for i in left if not (stems[i].startswith(stems[best]) or stems[best].startswith(stems[i]))}
    return [found[i] for i in taken]


def _weigh(rows: DataFrame, terms: list[str]) -> ToxicityModel:
    """Edits for the terms that keep clean texts clean with them, then the weights."""
    allowed = [edits_allowed(t) for t in terms]
    got = _hits(rows, terms, allowed)
    clean, seen = sum(y == 0 for y, _, _ in got), defaultdict(set)
    for d, (y, _, hits) in enumerate(got):
        if y == 0:
            for t, e, *_ in hits:
                seen[t, e].add(d)
    for t in range(len(terms)):
        while allowed[t] and len(seen[t, allowed[t]]) > max(1, clean / 1000):
            allowed[t] -= 1
    got = [(y, n, [h for h in hits if h[1] <= allowed[h[0]]]) for y, n, hits in got]
    x = np.array([features(hits, n) for _, n, hits in got])
    y = np.array([y for y, _, _ in got], float)
    return ToxicityModel(terms, allowed, _logistic(x, y))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the constant is not shrunk and no feature may speak against toxicity."""
    w = np.zeros(x.shape[1])
    free = np.ones(x.shape[1], bool)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        bad = (w[:-1] < 0) & free[:-1]
        if bad.any():
            free[:-1] &= ~bad
            w[:-1][bad] = 0
        elif np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, spans: bool = False) -> DataFrame:
    """(id, score, predicted) of every whole text, with ``spans`` also its hits (term, edits, begin, end, weight).

    One narrow stage without a shuffle; what a task keeps is bounded by the model. Null and empty texts have no
    hits and get the score of a text without any. Null ids are kept; repeated rows give repeated rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("__text"))
    hit = pa.struct([("term", pa.string()), ("edits", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())])
    weights, terms = model.weights, model.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms, model.allowed, model.most_seen)
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                hits = scanner.scan(text)
                x = features(hits, len(text.split()) if hits else 1)
                scores.append(float(1 / (1 + np.exp(-np.clip(float(np.dot(weights, x)), -30, 30)))))
                found.append([{"term": terms[t], "edits": e, "begin": a, "end": b, "weight": w} for t, e, a, b, w in hits] if spans else None)
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(found, pa.list_(hit))] if spans else [])], [id_col, "score", "predicted", *(["hits"] if spans else [])])

    more = ", hits array<struct<term: string, edits: int, begin: int, end: int, weight: double>>" if spans else ""
    return rows.mapInArrow(run, f"{id_col} long, score double, predicted int{more}")
