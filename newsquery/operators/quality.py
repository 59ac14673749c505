"""The quality gate: a score of 0 to 100 from penalties, messages, and the split into passed and quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..functions.rules import valid_url

COL = F.col
# The thresholds of the gate.
MIN_TITLE, MIN_CONTENT, MIN_CLEAN, LEAST_SCORE, FUTURE_SECONDS = 8, 150, 100, 50.0, 172800
# The stages after which an article must have content.
WITH_CONTENT = ("extracted", "enriched", "completed")


def quality(df: DataFrame, as_of: Column, columns: dict[str, str], dimension: int = 384) -> DataFrame:
    """``df`` with quality_score, quality_status, warnings and errors. One projection, no shuffle.

    ``columns`` names the columns that hold article_id, link, source, title, published (timestamp), published_text,
    content, clean_content, stage and embedding; those that are missing count as null. Quarantined is what has an
    error or a score below 50. Future dates are judged against ``as_of``, never the clock.
    """
    of = lambda n: COL(columns[n]) if n in columns else F.lit(None).cast("string")
    blank = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""
    title, content, clean = F.trim(F.coalesce(of("title"), F.lit(""))), F.trim(F.coalesce(of("content"), F.lit(""))), F.trim(F.coalesce(of("clean_content"), F.lit("")))
    ts = of("published").cast("timestamp")
    bad_date = ts.isNull()
    future = F.coalesce(F.unix_timestamp(ts) - F.unix_timestamp(as_of.cast("timestamp")) > FUTURE_SECONDS, F.lit(False))
    staged = F.coalesce(of("stage").isin(*WITH_CONTENT), F.lit(False))
    bad_vector = (of("embedding").isNotNull() & (F.size(COL(columns["embedding"])) != dimension)) if "embedding" in columns else F.lit(False)
    # The penalties and messages of the gate.
    errors = [
        (blank(of("article_id")), 40, "Missing or null article_id"),
        (~valid_url(F.coalesce(of("link"), F.lit(""))), 30, "Invalid or missing article URL"),
        (blank(of("source")), 20, "Missing source publisher name"),
        (title == "", 40, "Empty article title"),
        (staged & (content == "") & (clean == ""), 35, "Post-extraction content is completely empty"),
        (bad_vector, 30, "Invalid embedding vector dimension"),
    ]
    warnings = [
        ((title != "") & (F.length(title) < MIN_TITLE), 15, "Short title"),
        (bad_date, 10, "Missing or unparseable date"),
        (future, 20, "Future published date"),
        (staged & ~((content == "") & (clean == "")) & (F.length(clean) < MIN_CLEAN) & (F.length(content) < MIN_CONTENT), 15, "Content below minimum length"),
    ]
    lost = sum((F.when(cond, F.lit(float(points))).otherwise(0.0) for cond, points, _ in errors + warnings), F.lit(0.0))
    told = lambda rules: F.array_compact(F.array(*(F.when(cond, message) for cond, _, message in rules)))
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - lost))
    out = df.withColumns({"quality_score": rounded(score, 2), "errors": told(errors), "warnings": told(warnings)})
    failed = (F.size("errors") > 0) | (COL("quality_score") < LEAST_SCORE)
    return out.withColumn("quality_status", F.when(failed, "QUARANTINED").otherwise("PASSED"))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, quarantined)."""
    return df.filter("quality_status = 'PASSED'"), df.filter("quality_status = 'QUARANTINED'")
