"""Streaming: articles from queue or files, de-duplicated, scored, split and counted, each with its checkpoint.

Delivery is at least once from the source and exactly once in the tables: every micro-batch is written under its
number, so one that runs again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..articles import normalize_articles
from ..operators.quality import quality

COL = F.col
#: Later than this after the newest article, one is too late for windows: the tolerance of the quality gate.
LATE = "48 hours"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1000, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def decoded(raw: DataFrame, dimension: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, malformed) of a stream with a column ``json``; one without a link is malformed too."""
    rows = normalize_articles(raw, dimension)
    bad = COL("_corrupt_record").isNotNull() | F.coalesce(F.trim("link") == "", F.lit(True))
    return rows.filter(~bad).drop("_corrupt_record"), rows.filter(bad)


def watermarked(articles: DataFrame, ts: str = "event_ts", late: str = LATE) -> DataFrame:
    return articles.withColumn(ts, COL(ts).cast("timestamp")).withWatermark(ts, late)


def deduplicated(articles: DataFrame, key: str = "article_id", ts: str = "event_ts", late: str = LATE) -> DataFrame:
    """Each key once within the watermark; what may come later than that is caught by the table (``insert_new``)."""
    return watermarked(articles, ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(articles: DataFrame, dimension: str, width: str = "1 hour", ts: str = "event_ts", late: str = LATE) -> DataFrame:
    w = F.window(ts, width)
    return watermarked(articles, ts, late).groupBy(w, dimension).agg(F.count("*").alias("count")).select(COL("window.start").alias("start"), dimension, "count")


def sliding(articles: DataFrame, dimension: str, width: str = "24 hours", slide: str = "1 hour", ts: str = "event_ts", late: str = LATE) -> DataFrame:
    w = F.window(ts, width, slide)
    return watermarked(articles, ts, late).groupBy(w, dimension).agg(F.count("*").alias("count")).select(COL("window.start").alias("start"), dimension, "count")


def sessions(articles: DataFrame, key: str, gap: str = "30 minutes", ts: str = "event_ts", late: str = LATE) -> DataFrame:
    """Bursts of a key: runs of articles with no gap as long as ``gap``."""
    w = F.session_window(ts, gap)
    return watermarked(articles, ts, late).groupBy(w, key).agg(F.count("*").alias("count")).select(COL("session_window.start").alias("start"), COL("session_window.end").alias("end"), key, "count")


_SPIKE = "key string, start timestamp, n long, mean double, threshold double, is_spike boolean"


def spikes(counts: DataFrame, key: str, start: str, n: str, least: float = 3.0) -> DataFrame:
    """Per key, each count against the mean and deviation of those before it; state is three numbers a key.

    ``counts`` comes in order of time for each key, as windows in append mode do.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, total, squares = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(start)
        out = []
        for at, x in zip(rows[start], rows[n]):
            mean = total / seen if seen else 0.0
            sd = max(0.0, squares / seen - mean * mean) ** 0.5 if seen else 0.0
            threshold = max(round(mean + 2 * sd, 1), least)
            out.append((k[0], at, int(x), mean, threshold, bool(seen >= 4 and x >= threshold)))
            seen, total, squares = seen + 1, total + float(x), squares + float(x) ** 2
        state.update((seen, total, squares))
        yield pd.DataFrame(out, columns=["key", "start", "n", "mean", "threshold", "is_spike"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return counts.groupBy(key).applyInPandasWithState(step, _SPIKE, "seen long, total double, squares double", "append", GroupStateTimeout.NoTimeout)


def to_tables(passed: str, quarantine: str, as_of_col: str = "fetched_ts", dimension: int = 384) -> Callable[[DataFrame, int], None]:
    """A batch function that scores articles and splits them into two tables, under the batch's number."""
    names = {"article_id": "article_id", "link": "link", "source": "source_name", "title": "title", "published": "event_ts", "content": "content", "clean_content": "clean_content", "embedding": "embedding"}

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("source_name", COL("source.name"))
        scored = quality(rows, F.coalesce(COL(as_of_col), COL("event_ts")), names, dimension).drop("source_name").persist()
        scored.filter("quality_status = 'PASSED'").write.mode("overwrite").parquet(f"{passed}/batch={number}")
        scored.filter("quality_status = 'QUARANTINED'").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        scored.unpersist()

    return write


def start(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | str, once: bool = True, every: str = "60 seconds", mode: str = "append") -> StreamingQuery:
    """Runs a stream into a batch function or a Parquet folder: over what there is, or every so often."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.foreachBatch(sink).start() if callable(sink) else writer.format("parquet").start(sink)
