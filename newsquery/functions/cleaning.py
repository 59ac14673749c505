"""Cleaning of article text, from characters over lines to the whole text. JVM-side but for NFKC and HTML entities."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exprs import literal

# Lines that are the page's and not the article's.
BOILERPLATE = (
    "Advertisement", "Advertisements", "Sponsored", "Sponsored Content", "Read More", "Read Next", "Continue Reading", "More Stories", "Latest News", "Breaking News", "Trending", "View All",
    "Related Stories", "Related News", "Recommended Stories", "Recommended Articles", "Must Read", "Editor's Pick", "Explained", "Opinion", "Photo Gallery", "Videos", "Live Blog", "Live Updates",
    "Live Events", "Subscribe", "Subscribe Now", "Newsletter", "Login", "Log in", "Sign In", "Register", "Follow Us", "Join our WhatsApp", "WhatsApp Channel", "Telegram Channel", "Download App",
)
# The same for single publishers; callers add theirs.
_ECONOMIC_TIMES = (
    "Reliable and Trusted News Source", "Add Now!", "Economic Times WhatsApp Channel", "You can now subscribe", "Synopsis", "ET Prime", "ETPrime", "Prime Member", "Prime Membership", "Prime credentials",
    "Premium Story", "Member benefits", "Enjoy member benefits", "Already a member", "Current logged-in account", "Logged-in account", "Unlock this story", "Unlock premium content", "Continue Reading", "Read Full Story",
)
SOURCE_BOILERPLATE: dict[str, tuple[str, ...]] = {"Economic Times": _ECONOMIC_TIMES, "ET": _ECONOMIC_TIMES}
# Passages removed wherever they stand, up to the end of the line.
PASSAGES = (
    r"https?://\S+", r"www\.\S+", r"You can now subscribe[^\n]*", r"Join our WhatsApp.*", r"Follow us on.*", r"Follow our.*", r"Subscribe to our.*", r"Download our app.*", r"Click here.*",
    r"Share this article.*", r"Sign up for.*newsletter.*", r"ETPrime.*", r"Prime credentials.*", r"Member benefits.*", r"Enjoy member benefits.*", r"Current logged-in account.*", r"Logged-in account.*",
    r"Already a member.*", r"Unlock.*", r"Read Full Story.*", r"Continue Reading.*", r"©.*", r"All rights reserved.*",
)
# Headings without content of their own.
HEADINGS = ("Synopsis", "Summary", "Highlights", "Key Highlights", "Advertisement", "Related Stories", "Related News", "Read More", "Breaking News", "Latest News", "Must Read")
# Lines of under three characters that stay.
SHORT_LINES = ("AI", "UK", "US", "EU", "UN", "PM", "Xi")
# Typographic characters and what replaces them; zero-width ones go.
TYPOGRAPHIC = {"“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-", "−": "-", " ": " "}
ZERO_WIDTH = "​‌‍﻿"


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def unescape_html(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(T.StringType())
def _decoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else html.unescape(unicodedata.normalize("NFKC", t)))


def decode(text: Column) -> Column:
    """NFKC and then HTML entities, in one Arrow pass that gets only texts with a character or an entity to change."""
    # all of Latin-1 but for a few signs, and the Latin letters without decompositions, are their own NFKC forms
    needs = text.rlike("&|[^\\x00-\\x7F¡-§©«¬®°±¶·»¿-ıĹ-ľŁ-ňŊ-žƀ-ƿ]")
    return F.coalesce(_decoded(F.when(needs, text)), text)


def plain_typography(text: Column) -> Column:
    return F.translate(text, "".join(TYPOGRAPHIC) + ZERO_WIDTH, "".join(TYPOGRAPHIC.values()))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def remove_passages(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)(" + "|".join(PASSAGES) + ")", "")


def lines(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def line_key(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"\s+", " "))


def _phrase_pattern(phrases: tuple[str, ...]) -> str:
    """A line that is one of the phrases, begins with one and a space, or ends with a space and one."""
    any_of = "|".join(literal(p.lower()) for p in phrases)
    return f"^({any_of})( .*)?$|^.* ({any_of})$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def remove_boilerplate(text_lines: Column, source: str = "") -> Column:
    phrases = (*BOILERPLATE, *SOURCE_BOILERPLATE.get(source, ()))
    any_of = "|".join(literal(p.lower()) for p in phrases)
    longest = max(map(len, phrases))
    # the same as ``_phrase_pattern``, but of a line only its begin and its end are looked at
    drop = lambda key: key.rlike(f"^(?:{any_of})(?: |$)") | F.right(key, F.lit(longest + 1)).rlike(f" (?:{any_of})$")
    return F.filter(text_lines, lambda x: ~bound(line_key(x), drop))


def distinct_lines(text_lines: Column) -> Column:
    """Of lines that differ in case and spacing only, the first: lines in the order of (key, place) stay behind another key."""
    placed = F.array_sort(F.transform(text_lines, lambda x, i: F.struct(line_key(x).alias("key"), i.alias("at"), x.alias("line"))))
    firsts = bound(placed, lambda own: F.filter(own, lambda x, i: (i == 0) | (F.get(own, i - 1)["key"] != x["key"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line")))), lambda x: x["line"])


def remove_headings(text_lines: Column) -> Column:
    return F.filter(text_lines, lambda x: ~line_key(x).isin(*(h.lower() for h in HEADINGS)))


def remove_short_lines(text_lines: Column) -> Column:
    return F.filter(text_lines, lambda x: x.isin(*SHORT_LINES) | (F.length(x) >= 3))


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://\S+|www\.\S+", "")


def remove_empty_brackets(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), (r"\(\s*\)", r"\[\s*\]", r"\{\s*\}"), text)


def collapse_punctuation(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), ((r"\.{2,}", "."), (r"!{2,}", "!"), (r"\?{2,}", "?")), text)


def normalize_spaces(text: Column) -> Column:
    """Single spaces inside lines, no empty lines."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != ""), "\n")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_tags(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return collapse_whitespace(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " "))


def valid_content(text: Column, chars: int = 30, words: int = 5) -> Column:
    return (F.length(text) >= chars) & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= words)


def clean(text: Column, source: str = "") -> Column:
    """All steps on the JVM in their order; empty if what remains is too short."""
    t = plain_typography(F.coalesce(text, F.lit("")))
    kept = remove_boilerplate(lines(remove_passages(strip_control(t))), source)
    t = F.array_join(remove_short_lines(remove_headings(distinct_lines(kept))), "\n")
    t = F.trim(normalize_spaces(collapse_punctuation(remove_empty_brackets(remove_urls(t)))))
    return bound(t, lambda x: F.when(valid_content(x), x).otherwise(F.lit("")))


def clean_articles(df: DataFrame, text: str, out: str = "clean_content", source: str = "") -> DataFrame:
    """``df`` with the cleaned text: NFKC and HTML entities in an Arrow pass, then all other steps."""
    decoded = df.withColumn("__decoded", decode(F.coalesce(text, F.lit(""))))
    return decoded.withColumn(out, clean(F.col("__decoded"), source)).drop("__decoded")
