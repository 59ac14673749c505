"""What the queries and their SQL share."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..articles import document_articles, event_articles, table

COL = F.col

ART = """art AS (SELECT CAST(event_id AS VARCHAR) AS article_id, ts AS event_ts, 'pub' || CAST(user_id % 4 AS VARCHAR) AS source, event_type AS category,
 CASE WHEN value < 20 THEN 'Negative' WHEN value < 60 THEN 'Neutral' ELSE 'Positive' END AS sentiment,
 'topic' || json_extract_string(props, '$.k') AS keyword, 'user' || CAST(user_id AS VARCHAR) AS entity, event_type AS entity_type, value FROM events),
lim AS (SELECT max(ts) AS as_of FROM events)"""
DOC = """doc AS (SELECT CAST(doc_id AS VARCHAR) AS article_id, doc_id, 'https://' || source || '.example.com/news/' || CAST(doc_id AS VARCHAR) AS link,
 trim(split_part(text, chr(10), 1)) AS title, text AS content, lang, source, n_chars FROM documents)"""


def as_of(spark: SparkSession, folder: str) -> datetime:
    """The time of the newest event: one aggregate over one column."""
    return table(spark, folder, "events").agg(F.max("ts")).first()[0]


def stamp(c: str | Column, name: str | None = None) -> Column:
    out = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out.alias(name) if name else out


def stamp_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def round_sql(x: str, places: int) -> str:
    """The arithmetic of ``exprs.rounded``."""
    scale = float(10**places)
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale})"


def pct_sql(part: str, whole: str, places: int = 1) -> str:
    return round_sql(f"(CAST({part} AS DOUBLE) / CAST(greatest({whole}, 1) AS DOUBLE) * 100.0)", places)


def trend_sql(cur: str, prev: str) -> tuple[str, str]:
    raw = f"(CAST({cur} - {prev} AS DOUBLE) / CAST(greatest({prev}, 1) AS DOUBLE) * 100.0)"
    growth = f"CASE WHEN {prev} < 3 THEN 0.0 ELSE {round_sql(raw, 1)} END"
    return f"CASE WHEN {prev} < 3 THEN 'INSUFFICIENT BASELINE' WHEN {raw} >= 10 THEN 'RISING' WHEN {raw} <= -10 THEN 'DECLINING' ELSE 'STABLE' END", growth


def window_sql(hours: int) -> str:
    return f"event_ts BETWEEN (SELECT as_of - INTERVAL {hours} HOUR FROM lim) AND (SELECT as_of FROM lim)"


BUCKET_SQL = {"1h": "strftime(event_ts, '%Y-%m-%d %H:00')", "1d": "strftime(event_ts, '%Y-%m-%d')", "1w": "strftime(event_ts, '%G-W%V')", "1m": "strftime(event_ts, '%Y-%m')"}

__all__ = ["ART", "BUCKET_SQL", "COL", "DOC", "Column", "DataFrame", "F", "SparkSession", "as_of", "document_articles", "event_articles", "pct_sql", "round_sql", "stamp", "stamp_sql", "table", "trend_sql", "window_sql"]
