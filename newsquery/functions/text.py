"""Text functions: titles, keywords, entities, occurrences, chunks, spelling."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exprs import literal

# Words that say nothing about a story.
GENERIC_WORDS = ("india", "general", "politics", "business", "world", "technology", "sports", "science", "health", "economy", "today", "news", "report", "latest", "general topic", "meta")
# Parts of addresses that are sections, not headlines.
SECTIONS = ("news", "articleshow", "article", "story", "opinion", "business", "economy", "national")
# Instructions that retrieved text may try to smuggle in.
INJECTIONS = (r"ignore\s+previous\s+instructions", r"disregard\s+all\s+prior", r"you\s+are\s+now", r"system\s*prompt:", r"override\s+safety")
# The vocabulary that questions are corrected to.
VOCABULARY = (
    "politics political business technology tech sports sport entertainment crime criminal health science finance education world india environment economic times hindu express hindustan "
    "market inflation elections cricket olympics government police court accused investigation narendra modi rbi reliance tata today yesterday month week developing timeline compare spikes "
    "sentiment feeling mood around covering event"
).split()
# What a search for a word also looks for.
SYNONYMS = {
    "war": ["war", "wars", "conflict", "military", "battle", "defense", "army", "airstrike", "combat", "missile"],
    "economy": ["economy", "economic", "gdp", "inflation", "market", "finance", "recession", "trade"],
    "rbi": ["rbi", "reserve bank", "monetary policy", "repo rate", "central bank", "inflation"],
    "elections": ["elections", "election", "polls", "voting", "ballot", "campaign", "voters", "candidate"],
    "crime": ["crime", "police", "arrest", "investigation", "court", "fir", "accused", "suspect"],
    "sports": ["sports", "cricket", "football", "tennis", "ipl", "hockey", "olympics", "tournament"],
    "tech": ["technology", "tech", "ai", "semiconductor", "digital", "cyber", "software", "startup"],
}


def article_id(link: Column) -> Column:
    return F.sha2(link, 256)


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def title_words(title: Column) -> Column:
    """Words of over three letters that say something, punctuation dropped inside words too."""
    plain = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*GENERIC_WORDS))


def bigrams(tokens: Column) -> Column:
    """Neighbouring words; a single word stands for itself."""
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tokens) >= 2, pairs).otherwise(tokens)


def normalize_keyword(text: Column) -> Column:
    """Without possessives, hyphens as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "['’]s", ""), "-", " "), r"\s+", " "))


def normalize_entity(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r"[^\p{L}\p{N}_\s&./-]", ""))


def valid_entity(text: Column) -> Column:
    return (F.length(text) >= 2) & ~text.rlike("^[0-9]+$") & ~F.lower(text).isin(*GENERIC_WORDS)


def valid_phrase(text: Column, stop: tuple[str, ...] = GENERIC_WORDS) -> Column:
    return (F.length(text) >= 2) & (F.size(F.split(F.trim(text), r"\s+")) <= 6) & ~F.lower(text).isin(*stop)


def occurrences(text: Column, term: str) -> Column:
    return F.regexp_count(F.lower(text), F.lit(literal(term.lower())))


def highlight(text: Column, term: str) -> Column:
    return F.regexp_replace(text, f"(?i)\\b({literal(term)})\\b", "**$1**")


def redact_injections(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)(" + "|".join(INJECTIONS) + ")", "[FILTERED INJECTION CONTENT]")


def headline_from_url(url: Column, publisher: str = "Publisher") -> Column:
    """The last part of the path that reads like a headline, in title case; a stock phrase if none does."""
    path = F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/+$", "")
    parts = F.reverse(F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.isin("http:", "https:", "www.") & ~F.lower(p).isin(*SECTIONS) & ~p.rlike(r"^[\w-]+(\.[\w-]+)+$")))
    slugs = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"articleshow.*|\.cms|\.html|\.ece|[0-9]+$", ""), "[-_]", " ")))
    best = F.element_at(F.concat(F.filter(slugs, lambda s: F.length(s) > 8), F.array(F.lit(None).cast("string"))), 1)
    return F.when(F.trim(url) == "", F.lit(f"{publisher} Coverage Update")).otherwise(F.coalesce(F.substring(F.initcap(best), 1, 90), F.lit(f"{publisher} Policy & Economic Update")))


def expand_query(query: str) -> list[str]:
    return SYNONYMS.get(query.strip().lower(), [query.strip()])


def correct_spelling(question: str) -> tuple[str, bool]:
    """The question with near misses of the vocabulary corrected, and whether there were any. Runs once per question."""
    out, changed = [], False
    for token in question.split():
        plain = token.lower().strip(".,!?\"'()")
        near = difflib.get_close_matches(plain, VOCABULARY, n=1, cutoff=0.7) if len(plain) > 3 and not plain.isdigit() else []
        if near and near[0] != plain:
            token, changed = near[0].capitalize() if token.istitle() else near[0], True
        out.append(token)
    return " ".join(out), changed


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_words(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Runs of whole words of up to so many characters (second column); a longer word is a chunk of its own."""
    for text, limit in texts:
        out = []
        for t, most in zip(text, limit):
            chunks: list[str] = []
            for w in (t or "").split():
                if chunks and len(chunks[-1]) + 1 + len(w) <= most:
                    chunks[-1] += " " + w
                else:
                    chunks.append(w)
            out.append(chunks)
        yield pd.Series(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_paragraphs(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Runs of whole paragraphs of up to so many characters; a longer paragraph is cut at words."""
    for text, limit in texts:
        out = []
        for t, most in zip(text, limit):
            chunks: list[str] = []
            for p in (x.strip() for x in (t or "").split("\n")):
                pieces = [p]
                if len(p) > most:
                    pieces = [""]
                    for w in p.split():
                        if pieces[-1] and len(pieces[-1]) + 1 + len(w) > most:
                            pieces.append(w)
                        else:
                            pieces[-1] = f"{pieces[-1]} {w}".strip()
                for piece in filter(None, pieces):
                    if chunks and len(chunks[-1]) + 1 + len(piece) <= most:
                        chunks[-1] += "\n" + piece
                    else:
                        chunks.append(piece)
            out.append(chunks)
        yield pd.Series(out)
