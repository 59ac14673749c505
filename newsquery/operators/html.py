"""What an article page holds: title, author, paragraphs, by patterns on the JVM; selectors by a stdlib parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import collapse_whitespace
from ..functions.exprs import first_text
from ..functions.rules import paywalled


def meta(html: Column, key: str, value: str) -> Column:
    """The content of a meta element, its attributes in either order."""
    one = F.regexp_extract(html, f"(?is)<meta[^>]*{key}=[\"']{value}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    two = F.regexp_extract(html, f"(?is)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*{key}=[\"']{value}[\"']", 1)
    return first_text(one, two)


def title(html: Column) -> Column:
    """og:title, twitter:title, else the title element."""
    return F.trim(first_text(meta(html, "property", "og:title"), meta(html, "name", "twitter:title"), F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)))


def author(html: Column) -> Column:
    return F.trim(meta(html, "name", "author"))


def paragraphs(html: Column) -> Column:
    """The texts of p elements inside article elements, or of all where there are none, joined by lines."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    inside = F.regexp_extract(bare, r"(?is)<article[^>]*>(.*)</article>", 1)
    scope = F.when(inside != "", inside).otherwise(bare)
    texts = F.transform(F.regexp_extract_all(scope, F.lit(r"(?is)<p[^>]*>([^<]*(?:<(?!/?p\b)[^>]*>[^<]*)*)"), F.lit(1)), lambda p: collapse_whitespace(F.regexp_replace(p, r"<[^>]*>", " ")))
    return F.array_join(F.filter(texts, lambda p: p != ""), "\n")


def content(stored: Column, page_title: Column, description: Column, extracted: Column) -> Column:
    """Stored content of 300 characters with a title, else the extracted one, else title and description if ten characters."""
    fallback = F.concat_ws(". ", page_title, description)
    return F.when((F.length(stored) >= 300) & (F.trim(page_title) != ""), stored).otherwise(first_text(extracted, F.when(F.length(fallback) >= 10, fallback)))


def first_valid(*candidates: Column) -> Column:
    """The first candidate that is no login page and long enough."""
    return F.coalesce(*(F.when(~paywalled(c), c) for c in candidates))


class _Selected(HTMLParser):
    """Texts of the elements that one of the selectors names: `tag`, `tag.class`, `.class`, `#id`."""

    def __init__(self, selectors: list[str]):
        super().__init__(convert_charrefs=True)
        self.rules = [(s.split("#")[0].split(".")[0], s.split(".")[1] if "." in s else None, s.split("#")[1] if "#" in s else None) for s in selectors]
        self.open: list[tuple[str, list[int], list[str]]] = []
        self.found: list[list[str]] = [[] for _ in selectors]

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self._end("p")  # a paragraph ends where the next begins
        own = dict(attrs)
        fits = [k for k, (name, cls, ident) in enumerate(self.rules) if (not name or name == tag) and (cls is None or cls in (own.get("class") or "").split()) and (ident is None or own.get("id") == ident)]
        if tag not in _VOID:
            self.open.append((tag, fits, []))

    def _end(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while True:
                last, fits, text = self.open.pop()
                for k in fits:
                    self.found[k].append(" ".join("".join(text).split()))
                if last == tag:
                    break

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        if not any(t in ("script", "style") for t, _, _ in self.open):
            for _, fits, text in self.open:
                if fits:
                    text.append(data)

    def close(self):
        super().close()
        while self.open:
            self._end(self.open[-1][0])


# Elements without an end.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def select_texts(pages: DataFrame, html: str, selectors: dict[str, list[str]]) -> DataFrame:
    """``pages`` with an array column for each name: the texts of its first selector that finds any."""
    names = list(selectors)
    flat = [(n, s) for n in names for s in selectors[n]]

    @F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in names]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch:
                parser = _Selected([s for _, s in flat])
                parser.feed(page or "")
                parser.close()
                row = {n: [] for n in names}
                for (n, _), texts in zip(flat, parser.found):
                    row[n] = row[n] or [t for t in texts if t]
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    return pages.withColumn("__s", run(F.col(html))).select("*", *(F.col(f"__s.{n}").alias(n) for n in names)).drop("__s")
