"""De-duplication by keys, of labelled lists, and exact copies of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str | Column, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def entities(rows: DataFrame, item: str, entity: str, label: str, confidence: str) -> DataFrame:
    """(item, entity, label, confidence): of entities that differ in case only the most confident."""
    best = rows.groupBy(item, F.lower(entity).alias("__e"), F.lower(label).alias("__l")).agg(F.max_by(F.struct(entity, label, confidence), F.struct(confidence, entity, label)).alias("b"))
    return best.select(item, "b.*")


def keywords(rows: DataFrame, item: str, text: str, score: str, limit: int = 20) -> DataFrame:
    """(item, text, score): of keywords that differ in case only the best score, and of each item the ``limit`` best."""
    best = rows.groupBy(item, F.lower(text).alias(text)).agg(F.max(score).alias(score))
    w = Window.partitionBy(item).orderBy(F.desc(score), text)
    return best.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit).drop("__rn")


def sorted_entities(column: Column) -> Column:
    """An array of entities by falling confidence, then by name and label."""
    keyed = F.transform(column, lambda e: F.struct((-e["confidence"]).alias("a"), F.lower(e["entity"]).alias("b"), F.lower(e["label"]).alias("c"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def exact_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, count, first): texts that occur more than once; what is shuffled are digests, not texts."""
    return df.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count("*").alias("count"), F.min(key).alias("first")).filter("count > 1")
