"""Predicates as columns: equality and containment of user text, status queues, relaxation, decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import literal, search_pattern

COL = F.col
# The upstream flag of each stage of the work queues.
UPSTREAM = {"cleaned": "extracted", "keywords": "cleaned", "sentiment": "keywords", "category": "sentiment", "ner": "category", "summary": "ner", "embedding": "ner", "event": "ner"}
#: Tries of a retryable failure, and seconds after which a claim is stale.
RETRIES, LEASE = 3, 300


def same_text(column: Column, value: str) -> Column:
    """Equal without regard to case; the value is text, never a pattern."""
    return F.lower(column) == value.strip().lower()


def case_variants(column: Column, value: str) -> Column:
    """One of the value's usual spellings; unlike a pattern it reaches the scan."""
    v = value.strip()
    return column.isin(*dict.fromkeys((v, v.lower(), v.title(), v.upper())))


def any_element(array: Column, query: str) -> Column:
    return F.exists(array, lambda k: F.lower(k).rlike(literal(query.lower())))


def mentions(query: str, *columns: Column) -> Column:
    """The query occurs in one of the columns."""
    pattern = "(?i)" + search_pattern(query)
    return reduce(lambda a, b: a | b, (F.coalesce(c.rlike(pattern), F.lit(False)) for c in columns))


def not_empty(column: Column) -> Column:
    return column.isNotNull() & (F.trim(column) != "")


def long_enough(text: Column, chars: int, words: int) -> Column:
    return (F.length(F.trim(text)) >= chars) & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= words)


def by_id(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, (COL(c) == key for c in columns))).limit(1)


def eligible(done: Column, upstream: Column, processing: Column | None = None, failed: Column | None = None) -> Column:
    """What a stage may work on: its upstream is done, itself neither done nor under way nor failed; null flags are false."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return flag(upstream) & ~flag(done) & (~flag(processing) if processing is not None else F.lit(True)) & (~flag(failed) if failed is not None else F.lit(True))


def claimable(status: Column, retryable: Column, tries: Column, claimed: Column, as_of: Column) -> Column:
    """Pending, or failed and worth another try, or claimed so long ago that its worker must be gone."""
    stale = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(claimed.cast("timestamp")) > LEASE
    return (status == "PENDING") | ((status == "FAILED") & F.coalesce(retryable, F.lit(False)) & (F.coalesce(tries, F.lit(0)) < RETRIES)) | ((status == "PROCESSING") & stale)


def next_state(status: Column, ok: Column, tries: Column) -> tuple[Column, Column]:
    """(status, tries) after an attempt."""
    after = F.coalesce(tries, F.lit(0)) + F.when(ok, 0).otherwise(1)
    return F.when(ok, "COMPLETED").when(after < RETRIES, "FAILED").otherwise("DEAD"), after


def next_step(link: Column, content: Column, done: Column) -> Column:
    return F.when(~not_empty(F.coalesce(link, F.lit(""))), "SKIP").when(~not_empty(F.coalesce(content, F.lit(""))), "EXTRACT_CONTENT").when(F.coalesce(done, F.lit(False)), "SKIP").otherwise("RUN_NLP")


def relaxed(df: DataFrame, *levels: Column) -> DataFrame:
    """The rows of the strictest level that has any, with its number in ``relaxation``.

    The levels' flags are found in one pass: each row gets the first level it meets, one aggregate tells the first
    that any row meets, and rows that meet that level stay.
    """
    first = reduce(lambda w, i: w.when(levels[i], i), range(1, len(levels)), F.when(levels[0], 0))
    marked = df.withColumn("__first", first)
    found = marked.agg(F.min("__first").alias("relaxation"))
    meets = reduce(lambda w, i: w.when(COL("relaxation") == i, levels[i]), range(1, len(levels)), F.when(COL("relaxation") == 0, levels[0]))
    return marked.crossJoin(F.broadcast(found)).filter(meets).drop("__first")


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)
