"""Counts and coverage: group counts fused into one scan, coverage shares, audits, modes and top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import percent, rounded, safe_div

COL = F.col


def counts_by(df: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, value, count) of several dimensions in one scan and one exchange, by grouping sets."""
    n = len(dimensions)
    sets = df.groupingSets([[COL(d)] for d in dimensions], *dimensions).agg(F.count("*").alias("count"), F.grouping_id().alias("g"))
    # of a set, the bit of its own column is 0 and all others are 1
    name = reduce(lambda w, i: w.when(COL("g") == (2**n - 1) - 2 ** (n - 1 - i), dimensions[i]), range(n), F.when(F.lit(False), ""))
    value = reduce(lambda w, i: w.when(COL("g") == (2**n - 1) - 2 ** (n - 1 - i), COL(dimensions[i]).cast("string")), range(n), F.when(F.lit(False), ""))
    return sets.select(name.alias("dimension"), value.alias("value"), "count")


def top_values(df: DataFrame, value: Column, limit: int = 15) -> DataFrame:
    """(value, count) of the most frequent values, ties by value; arrays are exploded."""
    return df.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def top_per_group(df: DataFrame, group: str, value: str, n: int = 1) -> DataFrame:
    """(group, value, count, rank): the n most frequent values of each group, ties by value; n = 1 is the mode."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("count"))
    order = Window.partitionBy(group).orderBy(F.desc("count"), value)
    return counts.withColumn("rank", F.row_number().over(order)).filter(COL("rank") <= n)


def coverage(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, filled, pct): how many rows have each field, in one aggregation."""
    one = df.agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in fields.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), COL(n).alias("filled"), percent(COL(n), COL("total")).alias("pct")) for n in fields)))
    return one.select(rows.alias("r")).select("r.*")


def status_counts(df: DataFrame, status: str, values: list[str]) -> DataFrame:
    """(stage, count) for the given values, zeros included."""
    one = df.agg(*(F.count_if(COL(status) == v).alias(v) for v in values))
    return one.unpivot([], values, "stage", "count")


def label_split(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """One row: the share of each label in percent."""
    total = F.count("*")
    return df.agg(*(percent(F.count_if(COL(label) == v), total).alias(f"{v.lower()}_pct") for v in values))


def freshness(df: DataFrame, dimension: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, latest, status) for every key of a small dimension, those without articles too."""
    latest = df.groupBy(key).agg(F.max(ts).alias("latest"))
    return dimension.join(latest, key, "left").select(key, "latest", F.when(COL("latest").isNull(), "NO RECENT DATA").otherwise("FRESH").alias("status"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, count) of the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).filter(COL("count") > 1)


def missing_audit(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: how many rows lack each field (null or blank), in one scan."""
    return df.agg(*(F.count_if(COL(f).isNull() | (F.trim(COL(f).cast("string")) == "")).alias(f"{f}_missing") for f in fields))


def first_last(df: DataFrame, group: str, ts: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("count"))


def mean_scores(scores: DataFrame, item: str, label: str, score: str) -> DataFrame:
    """(item, label, score): per item the label whose mean score is highest, to 4 places; ties by label."""
    means = scores.groupBy(item, label).agg(rounded(F.avg(score), 4).alias("score"))
    order = Window.partitionBy(item).orderBy(F.desc("score"), label)
    return means.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def progress(df: DataFrame, done: Column) -> DataFrame:
    one = df.agg(F.count("*").alias("total"), F.count_if(F.coalesce(done, F.lit(False))).alias("completed"))
    return one.select("*", (COL("total") - COL("completed")).alias("remaining"), percent(COL("completed"), COL("total"), 2).alias("pct"))


def acceptance(df: DataFrame, discovered: str, stored: str, quarantined: str, least_yield: float = 0.5, least_quality: float = 0.6) -> DataFrame:
    """One row: whether a trial collection stored enough of what it found, and enough of it good."""
    one = df.agg(*(F.sum(c).alias(c) for c in (discovered, stored, quarantined)))
    found, good = safe_div(COL(stored), COL(discovered)), safe_div(COL(stored), COL(stored) + COL(quarantined))
    return one.select(rounded(found, 4).alias("yield"), rounded(good, 4).alias("quality"), ((found >= least_yield) & (good >= least_quality)).alias("accepted"))


def measured(df: DataFrame, name: str):
    """(df, observation): row count and others of a stage come with the run that uses it, without another job."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen
