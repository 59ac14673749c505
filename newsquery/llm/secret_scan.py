"""Secret scans: a random forest, trained from labelled findings, takes the false positives out of a broad search.

Candidates are unbroken runs of key-like characters. The forest judges each by its length, how its characters follow
one another, how much of it dictionary words cover, whether it looks like a path, and the words around it.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Candidates: 12 and more characters, with a digit or both cases among them (prose words have neither).
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-.~])[A-Za-z0-9+/_\-.~]{12,}={0,2}(?![A-Za-z0-9+/_\-.~])")
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z][a-z]+[A-Z]")
_WORD = re.compile(r"[^\W\d_]+")

# Words near a candidate that speak for a secret, and words that speak against one.
SECRET_WORDS = frozenset("password passwd pwd secret token key apikey api auth authorization bearer credential credentials access private aws client signature passphrase".split())
PLAIN_WORDS = frozenset("commit sha sha1 sha256 md5 checksum hash digest uuid guid id revision build version example sample test dummy placeholder your changeme xxx url http https www path file image data".split())
# Beginnings that providers give their keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "SG.", "npm_", "pypi-")

NAMES = ("length", "entropy", "distinct", "transitions", "class_changes", "longest_class", "digits", "upper", "hex", "words", "longest_word", "repeats", "slashes", "dots", "dashes", "extension", "prefix", "assigned", "quoted", "secret_near", "plain_near", "sequence")


class Context:
    """What candidates are compared with: a dictionary, and how likely letters follow one another in its words."""

    def __init__(self, dictionary: list[str]):
        self.words = frozenset(w for w in dictionary if len(w) >= 3)
        self.longest = max(map(len, self.words), default=0)
        counts = Counter(p for w in dictionary for p in zip(" " + w, w + " "))
        totals = Counter()
        for (a, _), n in counts.items():
            totals[a] += n
        self.follow = {p: math.log((n + 0.1) / (totals[p[0]] + 3.0)) for p, n in counts.items()}
        self.unseen = math.log(0.1 / 30)

    def coverage(self, low: str) -> tuple[int, int]:
        """Letters covered by dictionary words, longest first from the left, and the longest word."""
        i = covered = best = 0
        while i < len(low):
            for n in range(min(self.longest, len(low) - i), 2, -1):
                if low[i : i + n] in self.words:
                    covered, best, i = covered + n, max(best, n), i + n
                    break
            else:
                i += 1
        return covered, best


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(text: str, begin: int, end: int, context: Context, window: int = 48) -> list[float]:
    """The numbers in ``NAMES`` of one candidate."""
    s = text[begin:end]
    n, low = len(s), s.lower()
    counts = Counter(s)
    classes = [_class(c) for c in s]
    runs, run = [1], 1
    for a, b in zip(classes, classes[1:]):
        run = run + 1 if a == b else 1
        runs.append(run)
    letters = [c for c in low if c.isalpha()]
    follow = [context.follow.get(p, context.unseen) for p in zip(low, low[1:]) if p[0].isalpha() and p[1].isalpha()]
    covered, longest = context.coverage(low)
    left, right = text[max(0, begin - window) : begin], text[end : end + window]
    near = {w.lower() for w in _WORD.findall(left)[-4:] + _WORD.findall(right)[:2]} | {w for w in re.split(r"[^a-z]+", low) if len(w) > 2}
    steps = Counter(ord(b) - ord(a) for a, b in zip(s, s[1:]))
    return [
        math.log(n),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(counts) / n,
        sum(follow) / len(follow) if follow else 0.0,
        sum(a != b for a, b in zip(classes, classes[1:])) / n,
        max(runs) / n,
        sum(c.isdigit() for c in s) / n,
        sum(c.isupper() for c in s) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        covered / max(1, len(letters)),
        longest / n,
        max(counts.values()) / n,
        s.count("/") / n,
        s.count(".") / n,
        (s.count("-") + s.count("_")) / n,
        float(bool(re.search(r"\.[a-z]{2,4}$", low))),
        float(s.startswith(PREFIXES)),
        float(bool(re.search(r"[=:]\s*[\"']?$", left))),
        float(left[-1:] in "\"'" and right[:1] in "\"'" and bool(left)),
        float(bool(near & SECRET_WORDS)),
        float(bool(near & PLAIN_WORDS)),
        max(steps.get(1, 0), steps.get(0, 0)) / n,
    ]


# --- the forest --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: the feature and threshold of each node, its children, and the share of secrets at it."""

    trees: tuple[tuple[np.ndarray, ...], ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])
            out += share[at]
        return out / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 5) -> Forest:
    """Bootstrapped trees; each node takes the best Gini split of a random third of the features at their quantiles."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        feature, threshold, left, right, share = [], [], [], [], []

        def node(rows: np.ndarray, d: int) -> int:
            me = len(feature)
            feature.append(-1)
            threshold.append(0.0)
            left.append(0)
            right.append(0)
            share.append((y[rows].sum() + 0.5) / (len(rows) + 1))
            if d == 0 or len(rows) < 2 * least or y[rows].min() == y[rows].max():
                return me
            best = (1e-9, -1, 0.0)
            p = y[rows].mean()
            for f in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
                own = x[rows, f]
                for t in np.unique(np.quantile(own, np.linspace(0.05, 0.95, 12), method="lower")):
                    low = own <= t
                    n = int(low.sum())
                    if least <= n <= len(rows) - least:
                        a, b = y[rows[low]].mean(), y[rows[~low]].mean()
                        gain = p * (1 - p) - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
                        if gain > best[0]:
                            best = (gain, int(f), float(t))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                feature[me], threshold[me] = best[1], best[2]
                left[me] = node(rows[low], d - 1)
                right[me] = node(rows[~low], d - 1)
            return me

        node(rng.integers(0, len(x), len(x)), depth)
        out.append(tuple(np.array(a) for a in (feature, threshold, left, right, share)))
    return Forest(tuple(out))


# --- labelled findings -------------------------------------------------------------------------


def example_findings(words: list[str], n: int = 3000, seed: int = 1) -> list[tuple[str, int, int, int]]:
    """(text, begin, end, label) made by rule, for a corpus without labelled findings of its own.

    Half are keys of common forms in the contexts they leak in; half are what scanners take for keys: commit and
    file hashes, identifiers, paths, addresses, versions, placeholders, numbered and joined words.
    """
    rng = random.Random(seed)
    hexa, upper, base64, lower = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    words = [w for w in words if w] or ["the", "and", "value"]
    word = lambda: rng.choice(words)
    prose = lambda k: " ".join(word() for _ in range(k))
    named = lambda: rng.choice(["password", "token", "api_key", "secret", "API_KEY", "auth_token", "client_secret", "aws_secret_access_key"])
    secrets = [
        lambda: ("", "AKIA" + draw(upper, 16), ""),
        lambda: (f"{named()} = \"", draw(hexa, rng.choice([32, 40, 64])), '"'),
        lambda: (f"{named()}=", draw(hexa, rng.randint(16, 40)), ""),
        lambda: (f"{named()}: ", draw(base64 + "+/", rng.choice([32, 40, 44])), ""),
        lambda: (f"{named()} = '", draw(base64, rng.randint(20, 48)), "'"),
        lambda: ("Bearer ", "eyJ" + draw(base64, rng.randint(30, 120)) + "." + draw(base64, 43), ""),
        lambda: (rng.choice(["", "token "]), rng.choice(["ghp_", "sk_live_", "xoxb-", "AIza", "npm_"]) + draw(base64, rng.randint(24, 36)), ""),
        lambda: (f"{named()} ", draw(base64, rng.randint(24, 40)), ""),
    ]
    others = [
        lambda: (rng.choice(["commit ", "sha1 ", "revision ", "md5: ", "checksum ", "digest: sha256 "]), draw(hexa, rng.choice([32, 40, 64])), ""),
        lambda: (rng.choice(["", "id ", "uuid "]), "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), ""),
        lambda: ("", "/".join([word() for _ in range(rng.randint(2, 5))]) + f"/{word()}{rng.randint(1, 99)}.{rng.choice(['html', 'png', 'py', 'txt'])}", ""),
        lambda: ("", "".join(word().capitalize() for _ in range(rng.randint(2, 4))) + str(rng.randint(0, 99)), ""),
        lambda: ("", "_".join(word() for _ in range(rng.randint(2, 4))) + f"_{rng.randint(1, 99)}", ""),
        lambda: ("version ", ".".join(str(rng.randint(0, 30)) for _ in range(4)) + "-" + word() + str(rng.randint(1, 9)), ""),
        lambda: (f"{named()}=", rng.choice(["your_api_key_here1", "xxxxxxxxxxxxxxxx1", "changeme12345678", "EXAMPLE_TOKEN_0000", "placeholder-key-1"]), ""),
        lambda: ("", str(rng.randint(10**12, 10**19)), ""),
        lambda: ("", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}", ""),
        lambda: ("", f"{word()}.{rng.randint(1, 99)}.{word()}.{rng.choice(['com', 'org', 'net'])}", ""),
        lambda: ("", "".join(word() for _ in range(rng.randint(3, 6))) + rng.choice(["1", "2X", "A"]), ""),
        lambda: ("", draw(lower, 1) * rng.randint(12, 30) + "1", ""),
        lambda: ("", "abcdefghijklmnopqrstuvwxyz0123456789"[: rng.randint(14, 36)] + "9", ""),
    ]
    out = []
    for k in range(n):
        label = k % 2
        before, value, after = rng.choice(secrets if label else others)()
        head = prose(rng.randint(0, 8)) + " "
        text = head + before + value + after + " " + prose(rng.randint(0, 8))
        out.append((text, len(head) + len(before), len(head) + len(before) + len(value), label))
    return out


@dataclass(frozen=True)
class SecretModel:
    forest: Forest
    dictionary: list[str]


def fit(docs: DataFrame, findings: DataFrame | None = None, most_words: int = 5000, most_findings: int = 20000, text_col: str = "text") -> SecretModel:
    """Learns the dictionary from the words of all texts, the most frequent ``most_words`` of them, and the forest from findings.

    ``findings``: (text, begin, end, label) judged by people, of which at most ``most_findings`` are read; without
    them, ``example_findings``. Rows with a null are not learned from. The driver gets ``most_words`` words.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    # runs of letters alone: the letters of a key with digits are no words
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[\s\p{Punct}]+"), lambda w: w.rlike(r"^\p{L}{2,14}$")))
    made: list[DataFrame] = []
    counts = materialise(rows.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words", made)
    # each task would send its own most frequent words: only those as frequent as the last one wanted, by powers of two
    level, least, above = F.floor(F.log2(F.col("n"))).cast("int"), 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["level"]):
        least, above = r["level"], above + r["words"]
        if above >= most_words:
            break
    dictionary = [r["w"] for r in counts.filter(level >= least).orderBy(F.desc("n"), "w").limit(most_words).collect()]
    discard(*made)
    if findings is None:
        labelled = example_findings(dictionary[:1500])
    else:
        fine = findings.select("text", F.col("begin").cast("int"), F.col("end").cast("int"), F.col("label").cast("int")).dropna()
        labelled = [tuple(r) for r in fine.orderBy(F.xxhash64("text", "begin"), "text", "begin", "end").limit(most_findings).collect()]
    context = Context(dictionary)
    x = np.array([features(t, a, b, context) for t, a, b, _ in labelled]).reshape(-1, len(NAMES))
    y = np.array([label for *_, label in labelled], float)
    return SecretModel(grow(x, y) if len(x) else Forest(()), dictionary)


def scan(docs: DataFrame, model: SecretModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", all_candidates: bool = True) -> DataFrame:
    """(id, begin, end, probability, is_secret) of every candidate in every whole text, or of the secrets alone.

    One narrow stage. ``begin`` and ``end`` count characters; a candidate may be of any length.
    Null and empty texts have none; a null id is kept. Repeated rows give repeated findings. The value itself is
    not returned, so that results hold no secrets.
    """
    names = [id_col, "begin", "end", "probability", "is_secret"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = Context(model.dictionary)
        for batch in batches:
            where, x = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                for m in CANDIDATE.finditer(text):
                    begin, end = m.span()
                    while end > begin and text[end - 1] in ".-~":  # the end of a sentence isn't part of it
                        end -= 1
                    if end - begin >= 12 and _MIXED.search(text, begin, end):
                        where.append((i, begin, end))
                        x.append(features(text, begin, end, context))
            p = model.forest.probability(np.array(x)) if x else np.zeros(0)
            keep = np.ones(len(p), bool) if all_candidates else p >= threshold
            ids, begins, ends = ([w[k] for w, own in zip(where, keep) if own] for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(p[keep]), pa.array(p[keep] >= threshold)], names)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"{id_col} long, begin int, end int, probability double, is_secret boolean")
