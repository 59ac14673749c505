"""The corpus pipeline: documents become packed training sequences in five stages.

Every stage works on all that the one before kept. Its result is written as Parquet and read again before the next
begins, so that a lost executor costs no more than a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquery.llm import common, language_id, pii
from newsquery.llm.common import table
from newsquery.llm.decontaminate import uncontaminated
from newsquery.llm.jaccard_join import jaccard_components
from newsquery.llm.packing import pack_documents
from newsquery.llm.queries import PII_KEY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that resemble none of the learned languages, null texts and texts without a letter among them."""
    return language_id.accepted(docs, language_id.fit(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 and more) the smallest doc_id stays.

    Of rows that repeat a doc_id one stays. Rows without a doc_id can't be told apart by it and stay.
    """
    groups = jaccard_components(docs, n=5, percent=80)
    kept = docs.join(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    repeated = groups.filter("doc_id is not null and doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy, exact or edited, of a benchmark item; each row by its own text, whatever its id."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values by pseudonyms; n_chars follows the new text."""
    done = pii.pseudonymise(docs, PII_KEY, found_col=None)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("jaccard_join", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("pii_pseudonyms", pseudonymise),
    ("best_fit_packing", pack),
]

#: No stage but the last few could be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's result. What a stage wrote goes when the next one's is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialise(stage(spark, docs, sf_dir), name)
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
