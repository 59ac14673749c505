"""Temporal analytics over articles (event_ts, source, category, sentiment, keyword, entity).

Every function takes ``as_of`` and puts it into the plan as a literal, so the range of event_ts reaches the scan. A
window is [as_of - width, as_of], the period before it [as_of - 2 width, as_of - width). Aggregations are partial
before they shuffle, and what they shuffle is (bucket, dimension): thousands of rows, whatever the input. Ties go to
the smaller key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bucket_key, periods, recommended_bucket
from ..functions.exprs import percent, rounded, trend

COL = F.col


def _lit(df: DataFrame, t: datetime) -> Column:
    return F.lit(t).cast(df.schema["event_ts"].dataType)


def with_period(articles: DataFrame, as_of: datetime, window: str) -> DataFrame:
    """The articles of both periods; ``cur`` is 1 in the window and 0 in the one before."""
    before, start = (_lit(articles, t) for t in periods(as_of, window))
    return articles.filter(COL("event_ts").between(before, _lit(articles, as_of))).withColumn("cur", (COL("event_ts") >= start).cast("int"))


def in_window(articles: DataFrame, as_of: datetime, window: str) -> DataFrame:
    return articles.filter(COL("event_ts").between(_lit(articles, periods(as_of, window)[1]), _lit(articles, as_of)))


def volume_buckets(articles: DataFrame, as_of: datetime, window: str, bucket: str | None = None) -> DataFrame:
    """(timestamp, count) of the buckets that have articles."""
    key = bucket_key(COL("event_ts"), bucket or recommended_bucket(window))
    return in_window(articles, as_of, window).groupBy(key.alias("timestamp")).agg(F.count("*").alias("count"))


def volume_summary(articles: DataFrame, as_of: datetime, window: str, bucket: str | None = None) -> DataFrame:
    """One row: totals of both periods, mean, peak, lowest and last bucket, trend. One scan of both periods."""
    key = bucket_key(COL("event_ts"), bucket or recommended_bucket(window))
    per = with_period(articles, as_of, window).groupBy("cur", key.alias("timestamp")).agg(F.count("*").alias("n"))
    now = COL("cur") == 1
    mine = lambda f, c: f(F.when(now, COL(c)))
    one = per.agg(
        F.coalesce(mine(F.sum, "n"), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum(F.when(~now, COL("n"))), F.lit(0)).alias("previous_period_count"),
        F.coalesce(rounded(mine(F.avg, "n"), 1), F.lit(0.0)).alias("average_per_bucket"),
        F.coalesce(mine(F.max, "n"), F.lit(0)).alias("peak_bucket_count"),
        F.coalesce(mine(F.min, "n"), F.lit(0)).alias("lowest_bucket_count"),
        F.coalesce(F.max_by(F.when(now, COL("n")), F.when(now, COL("timestamp"))), F.lit(0)).alias("current_bucket_count"),
    )
    direction, growth = trend(COL("total_count"), COL("previous_period_count"))
    return one.select("*", direction.alias("trend_direction"), growth.alias("growth_pct"), (COL("total_count") - COL("previous_period_count")).alias("abs_change"))


def dimension_trends(articles: DataFrame, dimension: str, as_of: datetime, window: str, bucket: str | None = None) -> DataFrame:
    """(timestamp, value, count) for every bucket that has articles and every value of the dimension, zeros filled in."""
    key = bucket_key(COL("event_ts"), bucket or recommended_bucket(window))
    counts = in_window(articles, as_of, window).groupBy(key.alias("timestamp"), COL(dimension).alias("value")).agg(F.count("*").alias("count"))
    return _filled(counts)


def _filled(counts: DataFrame) -> DataFrame:
    """Bucket by value with zeros: both sides of the product are distinct keys of an aggregate."""
    grid = counts.select("timestamp").distinct().crossJoin(counts.select("value").distinct())
    return grid.join(counts, ["timestamp", "value"], "left").select("timestamp", "value", F.coalesce("count", F.lit(0)).alias("count"))


def shares(articles: DataFrame, dimension: str, as_of: datetime, window: str) -> DataFrame:
    """(value, count, share_pct): the dimension's split of the window."""
    counts = in_window(articles, as_of, window).groupBy(COL(dimension).alias("value")).agg(F.count("*").alias("count"))
    return counts.select("value", "count", percent(COL("count"), F.sum("count").over(Window.partitionBy())).alias("share_pct"))


def pivoted_trends(articles: DataFrame, dimension: str, values: list[str], as_of: datetime, window: str, bucket: str | None = None) -> DataFrame:
    """One row a bucket, one column a value: counts, zeros filled in. The values are given, so no job finds them."""
    key = bucket_key(COL("event_ts"), bucket or recommended_bucket(window))
    return in_window(articles, as_of, window).groupBy(key.alias("timestamp")).agg(*(F.count_if(COL(dimension) == v).alias(v.lower()) for v in values))


def date_quality(articles: DataFrame) -> DataFrame:
    """Counts of articles by the date that supplied their time, the valid share, and a verdict on it."""
    one = articles.agg(F.count("*").alias("total"), *(F.count_if(COL("event_ts_field") == f).alias(f"{f}_count") for f in ("published", "created", "updated", "fetched")), F.count_if(COL("event_ts").isNull()).alias("missing_count"))
    pct = percent(COL("total") - COL("missing_count"), COL("total"))
    return one.select("*", pct.alias("valid_pct"), F.when(pct >= 90, "EXCELLENT").when(pct >= 70, "ACCEPTABLE").otherwise("DEGRADED").alias("verdict"))


def overall_spike(articles: DataFrame, as_of: datetime, window: str, bucket: str | None = None) -> DataFrame:
    """The last bucket against the mean and population deviation of the others; five buckets at least."""
    per = volume_buckets(articles, as_of, window, bucket).withColumnRenamed("count", "n")
    marked = per.withColumn("last", F.max("timestamp").over(Window.partitionBy()))
    old = COL("timestamp") < COL("last")
    one = marked.agg(
        F.count("*").alias("buckets"),
        F.coalesce(F.max(F.when(~old, COL("n"))), F.lit(0)).alias("current_value"),
        F.coalesce(F.avg(F.when(old, COL("n"))), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop(F.when(old, COL("n"))), F.lit(0.0)).alias("sd"),
    )
    threshold = F.greatest(rounded(COL("mean") + 2 * COL("sd"), 1), F.lit(5.0))
    return one.select(COL("buckets"), "current_value", rounded(COL("mean"), 1).alias("baseline_mean"), rounded(COL("sd"), 2).alias("baseline_std"), threshold.alias("threshold"), ((COL("buckets") >= 5) & (COL("current_value") >= threshold)).alias("is_spike"))


def dimension_spikes(articles: DataFrame, dimension: str, as_of: datetime, window: str, bucket: str | None = None) -> DataFrame:
    """Per value: its count in the last bucket against all its buckets, those without articles as zeros."""
    filled = dimension_trends(articles, dimension, as_of, window, bucket)
    marked = filled.withColumn("last", F.max("timestamp").over(Window.partitionBy()))
    one = marked.groupBy("value").agg(F.sum(F.when(COL("timestamp") == COL("last"), COL("count")).otherwise(0)).alias("current_value"), F.avg("count").alias("mean"), F.stddev_pop("count").alias("sd"))
    threshold = F.greatest(rounded(COL("mean") + 2 * COL("sd"), 1), F.lit(3.0))
    growth = rounded((COL("current_value") - COL("mean")) / F.greatest(COL("mean"), F.lit(1.0)) * 100.0, 1)
    spike = (COL("current_value") >= threshold) & (COL("current_value") >= 3)
    return one.select("value", "current_value", rounded(COL("mean"), 1).alias("baseline_mean"), threshold.alias("threshold"), growth.alias("growth_pct"), spike.alias("is_spike"))


def emerging(articles: DataFrame, term: str, as_of: datetime, window: str, least_length: int, top: int = 50, limit: int = 15, kind: str | None = None) -> DataFrame:
    """Of the terms most frequent in the window, those that grew most against the period before.

    The candidates are the ``top`` by recent count, and the result the ``limit`` by growth: both are the report's
    own sizes. ``kind``: a column whose last value in time goes with the term.
    """
    both = with_period(articles, as_of, window).filter(F.length(term) > least_length)
    extra = [] if kind is None else [F.max_by(COL(kind), F.struct("event_ts", kind)).alias(kind)]
    counts = both.groupBy(COL(term).alias("term")).agg(F.sum("cur").alias("recent_count"), F.sum(1 - COL("cur")).alias("baseline_count"), *extra)
    candidates = counts.filter("recent_count > 0").orderBy(F.desc("recent_count"), "term").limit(top)
    growth = rounded((COL("recent_count") - COL("baseline_count")) / F.greatest(COL("baseline_count"), F.lit(1)) * 100.0, 1)
    level = F.when(COL("recent_count") + COL("baseline_count") >= 4, "HIGH").otherwise("LOW CONFIDENCE")
    return candidates.select("*", growth.alias("growth_pct"), level.alias("confidence")).orderBy(F.desc("growth_pct"), F.desc("recent_count"), "term").limit(limit)


def cross_source_topics(articles: DataFrame, as_of: datetime, window: str, least_sources: int = 2, limit: int = 10, samples: int = 2) -> DataFrame:
    """Keywords that several sources cover, with the sources and the latest sample articles.

    The samples of a keyword are found with partial top-n lists, not by collecting its articles.
    """
    rows = in_window(articles, as_of, window).filter(F.length("keyword") > 3)
    per_source = rows.groupBy("keyword", "source").agg(F.count("*").alias("n"))
    topics = per_source.groupBy("keyword").agg(F.count("*").alias("source_count"), F.sum("n").alias("article_count"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    best = topics.filter(COL("source_count") >= least_sources).orderBy(F.desc("source_count"), F.desc("article_count"), "keyword").limit(limit)
    order = Window.partitionBy("keyword").orderBy(F.desc("event_ts"), F.desc("article_id"))
    firsts = rows.join(F.broadcast(best.select("keyword")), "keyword").withColumn("rn", F.row_number().over(order)).filter(COL("rn") <= samples)
    lists = firsts.groupBy("keyword").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "article_id"))), lambda x: x["article_id"]), ",").alias("samples"))
    return best.join(lists, "keyword")


def explain_trend(articles: DataFrame, as_of: datetime, window: str, source: str | None = None, category: str | None = None, top: int = 5) -> DataFrame:
    """(dimension, value, count, rank): both periods' totals and the top sources, categories and keywords of the window.

    One scan and one aggregation by grouping sets; the optional filters are substrings, as text and not as patterns.
    """
    rows = with_period(articles, as_of, window)
    for name, part in (("source", source), ("category", category)):
        if part:
            rows = rows.filter(F.contains(F.lower(name), F.lit(part.lower())))
    sets = rows.groupingSets([[COL("cur")], [COL("cur"), COL("source")], [COL("cur"), COL("category")], [COL("cur"), COL("keyword")]], "cur", "source", "category", "keyword").agg(F.count("*").alias("count"), F.grouping_id().alias("g"))
    named = sets.filter((COL("g") == 7) | (COL("cur") == 1)).select(
        F.when(COL("g") == 7, F.when(COL("cur") == 1, "current").otherwise("previous")).when(COL("g") == 3, "source").when(COL("g") == 5, "category").otherwise("keyword").alias("dimension"),
        F.coalesce("source", "category", "keyword", F.lit("")).alias("value"),
        "count",
    )
    order = Window.partitionBy("dimension").orderBy(F.desc("count"), "value")
    return named.withColumn("rank", F.row_number().over(order)).filter(COL("rank") <= top)


def hour_of_day(articles: DataFrame) -> DataFrame:
    """(hour, count) for all 24 hours."""
    counts = articles.groupBy(F.hour("event_ts").alias("hour")).agg(F.count("*").alias("n"))
    hours = articles.sparkSession.range(24).select(COL("id").cast("int").alias("hour"))
    return hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("count"))


def rolling_baseline(articles: DataFrame, bucket: str = "1d") -> DataFrame:
    """Each bucket against all before it: mean and population deviation of the earlier counts."""
    per = articles.groupBy(bucket_key(COL("event_ts"), bucket).alias("timestamp")).agg(F.count("*").alias("count"))
    # one row a bucket, so one task is no bottleneck
    earlier = Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("timestamp", "count", rounded(F.avg("count").over(earlier), 2).alias("mean_before"), rounded(F.stddev_pop("count").over(earlier), 2).alias("std_before"))
