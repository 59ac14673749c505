"""Reports composed of the operators: by days, months, sources, terms. Nothing is made up for what isn't there."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import percent
from ..functions.rules import is_noise, no_noise_title, topic_gate
from ..operators.aggregates import counts_by
from ..operators.filters import mentions

COL = F.col
SENTIMENTS = ("Positive", "Neutral", "Negative")


def _days(articles: DataFrame, start: date, end: date) -> DataFrame:
    """The articles of the days, in the right order whichever way they are given; a range that reaches the scan."""
    start, end = min(start, end), max(start, end)
    kind = articles.schema["event_ts"].dataType
    low, high = F.lit(datetime(start.year, start.month, start.day)).cast(kind), F.lit(datetime(end.year, end.month, end.day, 23, 59, 59, 999999)).cast(kind)
    return articles.filter(COL("event_ts").between(low, high))


def _ranked(counts: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("dimension").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(COL("rank") <= n)


def date_explorer(articles: DataFrame, start: date, end: date, top: int = 5) -> DataFrame:
    """(dimension, value, count, rank): the top sources, categories, sentiments and keywords of the days."""
    return _ranked(counts_by(_days(articles, start, end), "source", "category", "sentiment", "keyword"), top)


def daily_heads(articles: DataFrame, start: date, end: date) -> DataFrame:
    """(day, count, first_article): the timeline of a month."""
    day = F.date_format("event_ts", "yyyy-MM-dd").alias("day")
    return _days(articles, start, end).groupBy(day).agg(F.count("*").alias("count"), F.min_by("article_id", F.struct("event_ts", "article_id")).alias("first_article"))


def time_machine(articles: DataFrame, start: date, end: date, category: str | None = None) -> DataFrame:
    """(dimension, value, count) of the days, of one category if given."""
    rows = _days(articles, start, end)
    return counts_by(rows if category is None else rows.filter(F.lower("category") == category.lower()), "source", "category", "sentiment")


def compare_sources(articles: DataFrame, topic: str, title: str = "title", samples: int = 3) -> DataFrame:
    """(source, count, earliest, sample titles): how each source covers a topic, noise left out."""
    rows = articles.filter(~is_noise(COL(title)) & topic_gate(topic, COL(title)))
    w = Window.partitionBy("source").orderBy("event_ts", "article_id")
    marked = rows.withColumn("rn", F.row_number().over(w))
    return marked.groupBy("source").agg(F.count("*").alias("count"), F.min("event_ts").alias("earliest"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(COL("rn") <= samples, F.struct("rn", COL(title).alias("t"))))), lambda x: x["t"]), " | ").alias("samples"))


def term_profile(articles: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """One row: mentions of a term, first and last seen, sources, and the split of sentiments."""
    rows = articles.filter(mentions(term, *(COL(c) for c in columns)))
    split = [percent(F.count_if(COL("sentiment") == s), F.count("*")).alias(f"{s.lower()}_pct") for s in SENTIMENTS]
    return rows.agg(F.count("*").alias("mentions"), F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"), F.count_distinct("source").alias("n_sources"), *split)


def related_terms(articles: DataFrame, term: str, columns: list[str], related: str, top: int = 8) -> DataFrame:
    rows = articles.filter(mentions(term, *(COL(c) for c in columns)) & (F.lower(related) != term.lower()))
    return rows.groupBy(COL(related).alias("related")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "related").limit(top)


def topic_report(articles: DataFrame, query: str, title: str, content: str) -> DataFrame:
    """One row: distinct titles about a topic, their sources and sentiments, without noise."""
    rows = articles.filter(mentions(query, COL(title), COL(content)) & no_noise_title(COL(title)))
    once = rows.groupBy(F.lower(F.trim(title)).alias("t")).agg(F.min_by(F.struct("source", "sentiment"), F.struct("event_ts", "article_id")).alias("f"))
    split = [percent(F.count_if(COL("f.sentiment") == s), F.count("*")).alias(f"{s.lower()}_pct") for s in SENTIMENTS]
    return once.agg(F.count("*").alias("articles"), F.count_distinct("f.source").alias("n_sources"), *split)


def briefing(articles: DataFrame, start: date, end: date, per_category: int = 3) -> DataFrame:
    """(category, rank, article_id): the latest articles of each category in the days."""
    w = Window.partitionBy("category").orderBy(F.desc("event_ts"), F.desc("article_id"))
    return _days(articles, start, end).withColumn("rank", F.row_number().over(w)).filter(COL("rank") <= per_category).select("category", "rank", "article_id")


def cross_source(articles: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """(source, count, first_article, first_seen): who reported a topic, and who first."""
    rows = articles.filter(mentions(query, *(COL(c) for c in columns)))
    return rows.groupBy("source").agg(F.count("*").alias("count"), F.min_by("article_id", F.struct("event_ts", "article_id")).alias("first_article"), F.min("event_ts").alias("first_seen"))


def dashboard(articles: DataFrame, as_of: datetime) -> DataFrame:
    """One row: total, of the day of ``as_of``, and of each sentiment."""
    kind = articles.schema["event_ts"].dataType
    day = F.lit(datetime(as_of.year, as_of.month, as_of.day)).cast(kind)
    return articles.agg(F.count("*").alias("total"), F.count_if(COL("event_ts") >= day).alias("today"), *(F.count_if(COL("sentiment") == s).alias(s.lower()) for s in SENTIMENTS), F.count_distinct("source").alias("sources"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
