"""Queries whose result a stream computes: run over all files there are, into a table, and read back."""

from __future__ import annotations

from ..intermediate import new_folder
from ..streaming import pipeline as st
from . import query
from .base import COL, F, as_of, event_articles, stamp, table


def _folder(spark) -> str:
    """A shared folder for checkpoints and results."""
    return new_folder(spark, "stream")


def _events(spark, d):
    """The event table as a stream of its files."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.format("parquet").schema(schema).load(f"{d}/events.parquet*")
    return rows.withColumn("event_ts", COL("ts").cast("timestamp")).withColumn("article_id", COL("event_id").cast("string"))


def _result(spark, df, mode="append"):
    folder = _folder(spark)
    if mode == "append":
        st.start(df, f"{folder}/checkpoint", f"{folder}/out").awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{folder}/out")
    # complete results replace each other; the batch function writes the last one
    st.start(df, f"{folder}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out"), mode=mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("sm03_dedup_stream", "SELECT count(DISTINCT event_id) AS n FROM events")
def sm03_dedup_stream(spark, d):
    return _result(spark, st.deduplicated(_events(spark, d)).select("article_id")).agg(F.count("*").alias("n"))


@query("sm11_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def sm11_tumbling(spark, d):
    out = _result(spark, st.tumbling(_events(spark, d), "event_type"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "count")


@query("sm12_sliding", "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS count FROM (SELECT event_type, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 5 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s FROM events) GROUP BY 1, 2")
def sm12_sliding(spark, d):
    out = _result(spark, st.sliding(_events(spark, d), "event_type", "6 hours", "1 hour"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "count")


@query(
    "sm13_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS count FROM s GROUP BY user_id, k",
)
def sm13_sessions(spark, d):
    out = _result(spark, st.sessions(_events(spark, d), "user_id"), "complete")
    return out.select("user_id", stamp("start", "start"), "count")


@query("sm14_streaming_spikes")
def sm14_streaming_spikes(spark, d):
    a = event_articles(spark, d)
    hours = a.groupBy(F.date_trunc("hour", "event_ts").cast("timestamp").alias("start"), "category").agg(F.count("*").alias("n"))
    folder = _folder(spark)
    hours.coalesce(1).sortWithinPartitions("start").write.parquet(f"{folder}/hours")
    counts = spark.readStream.schema(hours.schema).parquet(f"{folder}/hours")
    return _result(spark, st.spikes(counts, "category", "start", "n"))


@query("sm04_quality_split")
def sm04_quality_split(spark, d):
    from ..articles import normalize_articles

    docs = table(spark, d, "documents").select(F.to_json(F.struct(F.when(COL("doc_id") % 5 > 0, F.concat(F.lit("https://x.example.com/a/"), "doc_id")).alias("link"), F.substring("text", 1, 60).alias("title"), COL("text").alias("content"), F.struct(COL("source").alias("name")).alias("source"), F.lit("2024-01-05T10:00:00Z").alias("published_date"))).alias("json"))
    folder = _folder(spark)
    docs.write.parquet(f"{folder}/in")
    good, bad = st.decoded(spark.readStream.schema("json string").parquet(f"{folder}/in"))
    st.start(good, f"{folder}/c1", st.to_tables(f"{folder}/passed", f"{folder}/quarantine")).awaitTermination()
    malformed = normalize_articles(docs).filter("link is null").count()
    counts = [("passed", spark.read.parquet(f"{folder}/passed").count()), ("quarantined", spark.read.parquet(f"{folder}/quarantine").count()), ("malformed", malformed)]
    return spark.createDataFrame(counts, "route string, n long")


@query("sm08_resume")
def sm08_resume(spark, d):
    """Two runs with one checkpoint: the second finds nothing new."""
    folder = _folder(spark)
    rows = _events(spark, d).select("article_id")
    st.start(rows, f"{folder}/c", f"{folder}/out").awaitTermination()
    first = spark.read.parquet(f"{folder}/out").count()
    st.start(rows, f"{folder}/c", f"{folder}/out").awaitTermination()
    return spark.createDataFrame([(first, spark.read.parquet(f"{folder}/out").count())], "first_run long, second_run long")


@query("sm05_state_machine")
def sm05_state_machine(spark, d):
    from ..operators.filters import next_state

    status, tries = next_state(F.lit("PROCESSING"), COL("value") < 60, COL("event_id") % 4)
    return table(spark, d, "events").groupBy(status.alias("status"), tries.alias("tries")).agg(F.count("*").alias("n"))


@query("ts_as_of", "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS as_of FROM events")
def ts_as_of(spark, d):
    return spark.createDataFrame([(as_of(spark, d),)], "t timestamp_ntz").select(stamp("t", "as_of"))
