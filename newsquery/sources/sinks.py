"""Sinks: appends without duplicates, upserts, quarantine, queues, index tables, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import merge, new_only
from ..operators.quality import split
from ..operators.search import field_statistics, postings

COL = F.col


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def insert_new(articles: DataFrame, path: str, keys: tuple[str, ...] = ("article_id", "link")) -> DataFrame:
    """Appends the articles that share no key with the table or with an earlier row of the batch; returns the table."""
    spark = articles.sparkSession
    fresh = articles
    for k in keys:
        fresh = fresh.dropDuplicates([k])
    if exists(spark, path):
        fresh = new_only(fresh, spark.read.parquet(path), *keys)
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def upsert(source: DataFrame, path: str, key: str, to: str, update: dict[str, Column] | None = None) -> DataFrame:
    """Writes the merge of the table at ``path`` and the source to ``to``: a new version, never the files being read."""
    spark = source.sparkSession
    merged = merge(spark.read.parquet(path), source, key, update) if exists(spark, path) else source
    merged.write.mode("errorifexists").parquet(to)
    return spark.read.parquet(to)


def route(scored: DataFrame, passed_path: str, quarantine_path: str) -> None:
    """Passed articles to one table, quarantined ones with their scores and messages to another."""
    passed, quarantined = split(scored)
    passed.write.mode("append").parquet(passed_path)
    quarantined.write.mode("append").parquet(quarantine_path)


def queue_rows(articles: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, value) with the article as JSON, as a queue takes them."""
    return articles.select(COL(key).cast("string").alias("key"), F.to_json(F.struct(*articles.columns)).alias("value"))


def publish(articles: DataFrame, servers: str, topic: str, key: str = "article_id") -> None:
    """Writes to a Kafka topic, acknowledged by all replicas. Needs the Kafka connector on the class path."""
    queue_rows(articles, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("topic", topic).save()


def write_index(articles: DataFrame, path: str, key: str, fields: dict[str, Column]) -> None:
    """The postings, by field and term, and the statistics of an index; written anew, so repeating changes nothing."""
    rows = articles.select(key, *(c.alias(n) for n, c in fields.items())).dropDuplicates([key])
    named = {n: COL(n) for n in fields}
    index = postings(rows, key, named)
    index.repartitionByRange("field", "term").sortWithinPartitions("field", "term", key).write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")
    field_statistics(rows, named).write.mode("overwrite").parquet(f"{path}/statistics")


def state_rows(articles: DataFrame) -> DataFrame:
    """What an ingestion remembers of an article."""
    return articles.select("article_id", "link", "source", COL("event_ts").alias("published_at"))
