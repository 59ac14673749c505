"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """Half up on the binary value, by the same arithmetic on every engine."""
    scale = float(10**places)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def safe_div(a: Column, b: Column) -> Column:
    """a over b, b counting as 1 where it is less."""
    return a.cast("double") / F.greatest(b, F.lit(1)).cast("double")


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    return rounded(safe_div(part, whole) * 100.0, places)


def ellipsize(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def safe_text(text: Column, default: str = "") -> Column:
    return F.trim(F.coalesce(text.cast("string"), F.lit(default)))


def clean_label(text: Column, default: str) -> Column:
    """Trimmed, first letter upper case, the rest lower; the default for nothing."""
    t = F.trim(text)
    return F.when(t.isNull() | (t == ""), F.lit(default)).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t)))))


def first_text(*columns: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns))


def trend(current: Column, previous: Column) -> tuple[Column, Column]:
    """(direction, growth in percent): a baseline of under 3 says nothing; 10 percent either way is a trend."""
    growth = F.when(previous < 3, F.lit(0.0)).otherwise(rounded((current - previous).cast("double") / F.greatest(previous, F.lit(1)).cast("double") * 100.0, 1))
    raw = (current - previous).cast("double") / F.greatest(previous, F.lit(1)).cast("double") * 100.0
    direction = F.when(previous < 3, "INSUFFICIENT BASELINE").when(raw >= 10, "RISING").when(raw <= -10, "DECLINING").otherwise("STABLE")
    return direction, growth


def contains_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether any of the words occurs in the text, inside words too. One pass over a literal alternation."""
    return text.rlike("|".join(literal(w) for w in words))


def literal(text: str) -> str:
    """A pattern for exactly this text, in a form that Java and RE2 read alike."""
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in text)


def search_pattern(query: str) -> str:
    """A user's query as a pattern: short ones as whole words only."""
    q = query.strip()
    return f"\\b{literal(q)}\\b" if len(q) <= 5 else literal(q)
