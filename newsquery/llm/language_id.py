"""Language identification: nearest of several TF-IDF n-gram centroids per language, with rejection by distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, in_share

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes other than letters part words; bytes of longer characters stay.
_PART = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
UNKNOWN = "und"
#: Numbers of distinct n-grams that thresholds are fitted for; a text that repeats itself is as long as what it repeats.
LENGTHS = 2.0 ** np.arange(4, 13)


def term_counts(text: str, dims: int) -> np.ndarray:
    """Counts of the hashed 2- and 3-byte runs of the whole text's words, a space before and after each."""
    words = text.lower().encode().translate(_PART).split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(dims, np.float32)
    pairs = b[:-1] << np.uint32(8) | b[1:]
    runs = pairs[:-1] << np.uint32(8) | b[2:]
    shift = np.uint32(32 - (dims.bit_length() - 1))
    counts = np.bincount((pairs * np.uint32(2654435761)) >> shift, minlength=dims)
    return (counts + np.bincount((runs * np.uint32(2246822519)) >> shift, minlength=dims)).astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray  # rows of length 1
    idf: np.ndarray
    least: np.ndarray  # of each length of LENGTHS and each centroid: similarities below are rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest centroid and the cosine to it."""
        near = self.vectors(counts) @ self.centroids.T
        best = near.argmax(axis=1)
        return best, np.clip(near[np.arange(len(best)), best], 0, 1)

    def accepts(self, counts: np.ndarray, best: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Whether the score reaches what the centroid asks for in a text of as many distinct n-grams; thresholds between two lengths are interpolated."""
        at = np.interp(np.log2(np.maximum(np.count_nonzero(counts, axis=1), 1)), np.log2(LENGTHS), np.arange(len(LENGTHS)))
        low = np.minimum(at.astype(int), len(LENGTHS) - 2)
        part = at - low
        return score >= (1 - part) * self.least[low, best] + part * self.least[low + 1, best]


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; it starts from rows evenly spread by their nearness to the mean, as the farthest are odd ones."""
    order = np.argsort(x @ x.mean(axis=0), kind="stable")
    k = min(k, len(x))
    centres = x[order[(2 * np.arange(k) + 1) * len(x) // (2 * k)]]
    for _ in range(rounds):
        near = x @ centres.T
        own, near = near.argmax(axis=1), near.max(axis=1)
        # odd texts, such as those under a wrong label, have no part in a centroid
        fine = [(own == j) & (near >= 0.3 * np.median(near[own == j])) if (own == j).any() else own == j for j in range(len(centres))]
        centres = np.stack([x[rows].mean(axis=0) if rows.any() else centre for rows, centre in zip(fine, centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, sample: int = 2000, dims: int = 8192, per_language: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", leave: bool = True, noise: float = 0.99, beyond: float = 0.08, most_part: float = 0.45) -> LanguageModel | None:
    """Learns from about ``sample`` texts in all, evenly over the languages and chosen by a hash of their id.

    The bound holds for what reaches the driver: hashed counts of at most 1.2 * ``sample`` + 100 texts. With
    ``leave``, the held-out fifth of the ids is never learned from. Texts without a letter and null languages are
    not learned from either. None if nothing is left to learn from. See ``_thresholds`` for the rejection.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    if leave:
        rows = rows.filter(~F.coalesce(held_out(F.col("id")), F.lit(False)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(2, sample // len(counts))
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))))

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if _LETTER.search(text):
                    c = term_counts(text, dims)
                    at = np.flatnonzero(c)
                    out.append((lang, at.astype(np.uint16).tobytes(), c[at].tobytes()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["lang", "at", "n"])

    chosen = rows.filter(in_share("id", share[F.col("lang")])).select("lang", "text")
    got = sorted(chosen.mapInArrow(vectorise, "lang string, at binary, n binary").limit(int(1.2 * sample) + 100).collect(), key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    if not got:
        return None
    sparse = [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["n"], np.float32)) for r in got]
    names = np.array([r["lang"] for r in got])
    df = np.bincount(np.concatenate([at for at, _ in sparse]), minlength=dims)
    idf = np.log((1 + len(sparse)) / (1 + df)).astype(np.float32) + np.float32(0.1)
    languages, centres, excerpts, rng = [], [], [], np.random.default_rng(5)
    for lang in sorted(set(names)):
        mine = [x for x, name in zip(sparse, names) if name == lang]
        own = np.zeros((len(mine), dims), np.float32)  # of one language at a time
        for row, (at, n) in zip(own, mine):
            row[at] = np.log1p(n) * idf[at]
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        c = _clusters(own, per_language)
        # a few odd texts under a wrong label make no centroid
        sizes = np.bincount((own @ c.T).argmax(axis=1), minlength=len(c))
        enough = sizes >= max(2, len(own) / 50)
        c = c[enough] if enough.any() else c
        languages += [str(lang)] * len(c)
        centres += list(c)
        excerpts.append((mine, slice(len(languages) - len(c), len(languages))))
    model = LanguageModel(tuple(languages), np.stack(centres), idf, np.zeros((len(LENGTHS), len(languages))))
    return replace(model, least=_thresholds(model, excerpts, rng, noise, beyond, most_part))


def _thresholds(model: LanguageModel, excerpts: list[tuple[list, slice]], rng: np.random.Generator, noise: float, beyond: float, most_part: float, texts: int = 150) -> np.ndarray:
    """What similarity a text of each length must reach, of each centroid.

    That is what the share ``noise`` of as long texts of random letters stays below, and the part ``beyond`` of the
    way from there to what all but a hundredth of as long excerpts of the language's learned texts reach: noise and
    most languages not learned are rejected. It is never more than ``most_part`` of the latter, and texts under 256
    n-grams go less far beyond, so that short and noisy text stays. Excerpts are random parts of a text's n-grams; lengths that too few texts have take the next shorter's.
    """
    dims, out = len(model.idf), np.zeros((len(LENGTHS), len(model.languages)))
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    distinct = lambda counts: np.log2(np.count_nonzero(counts, axis=1).mean())
    at_noise, chance, at_learned, learned = [], [], [[] for _ in excerpts], [[] for _ in excerpts]
    for length in 2 ** np.arange(4, 15):
        drawn = letters[rng.integers(0, 26, (texts, length // 2))]
        drawn[rng.random(drawn.shape) < 1 / 6] = 32
        counts = np.stack([term_counts(x.tobytes().decode(), dims) for x in drawn])
        at_noise.append(distinct(counts))
        chance.append(float(np.quantile(model.predict(counts)[1], noise)))
        for j, (own, columns) in enumerate(excerpts):
            long = [c for c in own if c[1].sum() >= length][:texts]
            if len(long) >= 10 or long and not learned[j]:
                counts = np.zeros((len(long), dims), np.float32)
                for row, (at, n) in zip(counts, long):
                    row[at] = rng.multivariate_hypergeometric(n.astype(np.int64), length)
                at_learned[j].append(distinct(counts))
                learned[j].append(float(np.quantile((model.vectors(counts) @ model.centroids[columns].T).max(axis=1), 0.01)))
    rising = lambda x: np.maximum.accumulate(x)
    by_chance = np.interp(np.log2(LENGTHS), rising(at_noise), chance)
    for j, (_, columns) in enumerate(excerpts):
        own = np.interp(np.log2(LENGTHS), rising(at_learned[j]), learned[j]) if learned[j] else np.ones(len(LENGTHS))
        far = beyond * np.minimum(1.0, LENGTHS / 256) * np.maximum(0.0, own - by_chance)
        out[:, columns] = np.minimum(by_chance + far, most_part * own)[:, None]
    return out


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), batch_rows: int = 256) -> DataFrame:
    """(id, lang_pred, score, rejected) and the columns in ``keep``, of every whole text, in one narrow stage.

    lang_pred is the language of the nearest centroid and score the cosine to it. ``rejected``: the text is farther
    from that centroid than the threshold for its length (see ``_thresholds``): one that resembles none of the
    languages, not merely one that is short or noisy. Null texts, texts without a letter, and all texts if there is
    no model: `und`, score 0, rejected. Null ids are kept; repeated rows give repeated rows.
    """
    extra = [docs.schema[c] for c in keep]
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), *keep, F.col(text_col).cast("string").alias("__text"))
    schema = rows.select(id_col, *keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    names = [id_col, *(f.name for f in extra), "lang_pred", "score", "rejected"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if at := [i for i, t in enumerate(texts) if t and model is not None and _LETTER.search(t)]:
                    counts = np.stack([term_counts(texts[i], len(model.idf)) for i in at])
                    best, near = model.predict(counts)
                    for i, j, s, fine in zip(at, best.tolist(), near.tolist(), model.accepts(counts, best, near).tolist()):
                        langs[i], scores[i], rejected[i] = model.languages[j], s, not fine
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected)], names)

    return rows.mapInArrow(predict, schema)


def accepted(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", batch_rows: int = 256) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose whole text isn't rejected (see ``identify``)."""
    at_text = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                texts = batch.column(at_text).to_pylist()
                fine = np.zeros(len(texts), bool)
                if at := [i for i, t in enumerate(texts) if t and model is not None and _LETTER.search(t)]:
                    counts = np.stack([term_counts(texts[i], len(model.idf)) for i in at])
                    fine[at] = model.accepts(counts, *model.predict(counts))
                yield batch.filter(pa.array(fine))

    return docs.mapInArrow(keep, docs.schema)
