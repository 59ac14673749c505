"""Enrichment: a protocol for models, deterministic defaults without one, and the exact post-processing of results."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import first_text, rounded
from ..functions.rules import infer_category, infer_sentiment
from .filters import long_enough

COL = F.col


class Enricher(Protocol):
    """A model: ``load`` runs once in each worker, ``apply`` on each batch of texts."""

    schema: str

    def load(self) -> object: ...

    def apply(self, model: object, texts: pd.Series) -> pd.Series | pd.DataFrame: ...


def enrich(df: DataFrame, text: str, out: str, enricher: Enricher, distinct: bool = False) -> DataFrame:
    """``df`` with ``out`` from the model, in Arrow batches. ``distinct``: each text is given to it only once."""

    @F.pandas_udf(enricher.schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = enricher.load()
        for batch in batches:
            yield enricher.apply(model, batch)

    if not distinct:
        return df.withColumn(out, run(COL(text)))
    done = df.select(COL(text).alias("__t")).distinct().withColumn(out, run(COL("__t")))
    return df.join(done, COL(text).eqNullSafe(COL("__t")), "left").drop("__t")


def summarise(text: Column, sentences: int = 3, chars: int = 600) -> Column:
    """The first sentences; empty for texts too short to need it."""
    parts = F.split(F.regexp_replace(F.trim(text), r"\s+", " "), r"(?<=[.!?])\s")
    return F.when(long_enough(text, 50, 10), F.substring(F.array_join(F.slice(parts, 1, sentences), " "), 1, chars)).otherwise(F.lit(""))


def category(text: Column) -> Column:
    return infer_category(text)


def sentiment(text: Column) -> Column:
    return infer_sentiment(text)


def best_label(scores: Column, least: float = 0.0, unknown: str = "Unknown", mapping: dict[str, str] | None = None) -> Column:
    """From a map of scores the label of the highest, ties by name, to 4 places; ``unknown`` below ``least``."""
    entries = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    top = F.element_at(entries, 1)
    name = top["k"]
    if mapping:
        name = F.coalesce(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[name], name)
    return F.struct(F.when(-top["s"] >= least, name).otherwise(F.lit(unknown)).alias("label"), rounded(-top["s"], 4).alias("score"))


def top_labels(labels: Column, scores: Column, k: int = 3) -> Column:
    zipped = F.arrays_zip(labels.alias("label"), scores.alias("score"))
    keyed = F.array_sort(F.transform(zipped, lambda z: F.struct((-z["score"]).alias("s"), z["label"].alias("l"))))
    return F.transform(F.slice(keyed, 1, k), lambda z: F.struct(z["l"].alias("label"), rounded(-z["s"], 4).alias("score")))


def keep_or_run(existing: Column, new: Column) -> Column:
    """A stage's result that is there already, else the new one."""
    return first_text(existing, new)


def run_stages(df: DataFrame, text: str, dimension: int = 64) -> DataFrame:
    """Summary, sentiment, category and keywords where they are missing, as one chain of projections."""
    has = lambda c: COL(c) if c in df.columns else F.lit(None).cast("string")
    t = COL(text)
    return df.withColumns({"summary": keep_or_run(has("summary"), summarise(t)), "sentiment": keep_or_run(has("sentiment"), sentiment(t)), "category": keep_or_run(has("category"), category(t))}).withColumn("keyword_list", extract_keywords(t)).withColumn("vector", hashed_vector(t, F.lit(dimension)))


_WORD = re.compile(r"[^\W\d_]{3,}")
# Words that are no keywords.
STOP = frozenset("the and for are was were with this that from have has had not but they you his her its our their which will would there been when what who der die das und les des une est que los las una por con para del".split())


def _candidates(text: str) -> Counter:
    """Runs of up to three words between stop words and punctuation."""
    out: Counter = Counter()
    for part in re.split(r"[^\w\s'-]+", text):
        run: list[str] = []
        for w in [*part.split(), "the"]:
            if w.lower() in STOP or not _WORD.fullmatch(w):
                for n in (1, 2, 3):
                    out.update(" ".join(run[i : i + n]).lower() for i in range(len(run) - n + 1))
                run = []
            else:
                run.append(w)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_keywords(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Ten phrases by frequency and early place; a phrase inside a better one is left out."""
    for batch in texts:
        rows = []
        for text in batch:
            counts = _candidates(text or "")
            place = {p: i for i, p in enumerate(counts)}  # in the order of first occurrence
            ranked = heapq.nsmallest(200, counts, key=lambda p: (-counts[p] * (1 + 0.3 * p.count(" ")) / math.log(3 + place[p]), p))
            kept: list[str] = []
            for p in ranked:
                if len(kept) == 10:
                    break
                if not any(p in q or q in p for q in kept):
                    kept.append(p)
            rows.append(kept)
        yield pd.Series(rows)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashed_vector(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Signed hashes of the words, length 1; empty for texts without words."""
    for batch, dims in texts:
        rows = []
        for text, d in zip(batch, dims):
            v = [0.0] * int(d)
            for w in _WORD.findall((text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % int(d)] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v))
            rows.append([x / norm for x in v] if norm else [])
        yield pd.Series(rows)


def named_entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entity, label, confidence): runs of two and more capitalised words, by rule; confidence by frequency."""
    found = F.regexp_extract_all(COL(text), F.lit(r"\b\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)+"), F.lit(0))
    rows = df.select(key, F.explode(found).alias("entity")).groupBy(key, "entity").agg(F.count("*").alias("n"))
    return rows.select(key, "entity", F.lit("Name").alias("label"), rounded(1.0 - 1.0 / (1.0 + COL("n")), 4).alias("confidence"))
