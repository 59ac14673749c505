"""Questions: what is asked for, the evidence, and an answer that quotes it or says that there is none."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import range_in_words
from ..functions.exprs import contains_any
from ..functions.text import correct_spelling, redact_injections

COL = F.col
# The terms of each intent, in the order in which intents are tried.
INTENTS = (
    ("TOP_10_NEWS", ("top 10", "top ten", "top 10 news", "top stories")),
    ("DEVELOPING_STORIES", ("developing", "pending", "ongoing", "developing stories")),
    ("STORY_TIMELINE", ("timeline", "what happened next", "story evolution", "after this", "follow-up")),
    ("CROSS_SOURCE_QUERY", ("cross-source", "multiple sources", "different sources", "covered by multiple", "covering this event", "newspapers covering")),
    ("NEWSPAPER_COMPARISON", ("compare", "versus", "vs", "difference", "four newspapers", "all newspapers", "economic times and the hindu")),
    ("TREND_ANALYSIS", ("trending", "trend", "emerging", "popular", "increasing", "biggest news trends")),
    ("SPIKE_ANALYSIS", ("spike", "unusual", "surge", "anomaly")),
    ("SENTIMENT_ANALYSIS", ("sentiment", "feeling", "mood", "positive news", "negative news")),
    ("ENTITY_DEEPDIVE", ("entity", "person", "people", "mentioned most", "company", "place", "organization", "leader")),
    ("SUMMARY", ("summarize", "summary", "brief", "overview")),
)
# The words that ask for recent articles; tried after dates.
RECENT = ("recent", "latest", "show me", "news about")
# The names of sources and categories in questions.
SOURCES = {"economic times": "Economic Times", "the hindu": "The Hindu", "hindu": "The Hindu", "indian express": "Indian Express", "express": "Indian Express", "hindustan times": "Hindustan Times"}
CATEGORIES = {
    "business": "Business", "technology": "Technology", "tech": "Technology", "politics": "Politics", "political": "Politics", "sports": "Sports", "sport": "Sports", "health": "Health",
    "entertainment": "Entertainment", "world": "World", "crime": "Crime", "criminal": "Crime", "environment": "Environment", "india": "India", "science": "Science", "finance": "Finance", "education": "Education",
}
# Words of a question that evidence need not hold.
IGNORED = "what where when which who whom whose why how about according indian express hindu times happened year news show tell give latest recent stories today yesterday week month compare summary article".split()
#: Intents whose answers must be grounded word by word.
GROUNDED = ("ARTICLE_SEARCH", "GENERAL_NEWS_QUERY", "SUMMARY", "DATE_RANGE_QUERY")
# Fixed value: the statement that there is no evidence.
NO_EVIDENCE = "Insufficient evidence was found in the indexed news data to answer this question."


@dataclass(frozen=True)
class Question:
    text: str
    corrected: str
    intent: str
    source: str | None = None
    category: str | None = None
    sentiment: str | None = None
    window: str = "24h"
    days: tuple[date, date] | None = None
    tools: tuple[str, ...] = field(default=())


def understand(text: str, as_of: datetime) -> Question:
    """The intent and filters of one question. SPIKE_ANALYSIS is a trend analysis with its own tools."""
    corrected, _ = correct_spelling(text)
    q = corrected.lower().strip()
    pick = lambda names: next((v for k, v in names.items() if k in q), None)
    days = range_in_words(q, as_of)
    intent = next((name for name, terms in INTENTS if any(t in q for t in terms)), None)
    intent = intent or ("DATE_RANGE_QUERY" if days else "ARTICLE_SEARCH" if any(t in q for t in RECENT) else "GENERAL_NEWS_QUERY")
    window = "1h" if "1 hour" in q or "last hour" in q else "6h" if "6 hour" in q else "7d" if "7 day" in q or "week" in q else "30d" if "30 day" in q or "month" in q else "24h"
    sentiment = next((s.capitalize() for s in ("positive", "negative", "neutral") if s in q), None)
    return Question(text, corrected, "TREND_ANALYSIS" if intent == "SPIKE_ANALYSIS" else intent, pick(SOURCES), pick(CATEGORIES), sentiment, window, days, TOOLS.get(intent, ("search",)))


# The operators that serve each intent.
TOOLS = {
    "TOP_10_NEWS": ("top_stories", "search"),
    "DEVELOPING_STORIES": ("developing", "search"),
    "STORY_TIMELINE": ("timeline", "search"),
    "CROSS_SOURCE_QUERY": ("cross_source_topics", "search"),
    "NEWSPAPER_COMPARISON": ("compare_sources", "cross_source_topics", "search"),
    "TREND_ANALYSIS": ("emerging_keywords", "emerging_entities", "volume"),
    "SPIKE_ANALYSIS": ("spikes", "volume"),
    "SENTIMENT_ANALYSIS": ("sentiment_trends", "search"),
    "ENTITY_DEEPDIVE": ("emerging_entities", "term_profile", "search"),
    "DATE_RANGE_QUERY": ("date_explorer", "search"),
}


def intent_of(text: Column) -> Column:
    """The intent of many questions at once, by terms alone (no dates, no spelling)."""
    low = F.lower(F.trim(text))
    w = reduce(lambda w, it: w.when(contains_any(low, it[1]), "TREND_ANALYSIS" if it[0] == "SPIKE_ANALYSIS" else it[0]), INTENTS[1:], F.when(contains_any(low, INTENTS[0][1]), INTENTS[0][0]))
    return w.when(contains_any(low, RECENT), "ARTICLE_SEARCH").otherwise("GENERAL_NEWS_QUERY")


def citations(hits: DataFrame, key: str, order: list[Column], most: int = 8) -> DataFrame:
    """The first hit of each article, in order and numbered, ``most`` of them, each with a snippet of evidence."""
    once = hits.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rn = 1").drop("__rn").orderBy(*order).limit(most)
    snippet = F.when(F.length("summary") > 50, COL("summary")).otherwise(F.substring("content", 1, 500))
    return once.withColumn("number", F.row_number().over(Window.orderBy(*order))).withColumn("snippet", snippet)


def context(cited: DataFrame) -> DataFrame:
    """One row: the evidence as text, instructions inside it made harmless."""
    line = F.format_string("--- ARTICLE [%d] ---\nTitle: %s\nSource: %s\nContent: %s\n", "number", F.coalesce("title", F.lit("Untitled Article")), F.coalesce("source", F.lit("Unknown")), F.coalesce("snippet", F.lit("")))
    lists = cited.agg(F.sort_array(F.collect_list(F.struct("number", line.alias("line")))).alias("l"))  # a bounded number of citations
    return lists.select(redact_injections(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("context"))


def question_words(question: str) -> list[str]:
    stripped = (w.strip("?,!.\"')(").lower() for w in question.split())
    return [w for w in stripped if len(w) > 3 and w not in IGNORED]


def grounded(cited: DataFrame, question: Question) -> DataFrame:
    """One row, ``grounded``: whether there is evidence, and a word of the question occurs in it."""
    words = question_words(question.corrected)
    text = F.lower(F.concat_ws(" ", "title", "summary", "source", "category"))
    hit = contains_any(text, words) if words and question.intent in GROUNDED else F.lit(True)
    return cited.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("grounded"))


def answer(cited: DataFrame, question: Question) -> DataFrame:
    """One row (answer, status): the first five citations as lines, or the statement that there is no evidence."""
    line = F.concat(COL("number").cast("string"), F.lit(". **["), F.coalesce("source", F.lit("Unknown")), F.lit("]** "), F.coalesce("title", F.lit("Untitled")), F.lit(" - Category: "), F.coalesce("category", F.lit("General")), F.lit(" | Sentiment: "), F.coalesce("sentiment", F.lit("Neutral")))
    lines = cited.filter("number <= 5").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    both = lines.crossJoin(grounded(cited, question))
    return both.select(F.when(COL("grounded"), COL("lines")).otherwise(F.lit(NO_EVIDENCE)).alias("answer"), F.when(COL("grounded"), "SUCCESS").otherwise("INSUFFICIENT_EVIDENCE").alias("status"))


def ask(articles: DataFrame, text: str, as_of: datetime, limit: int = 8) -> DataFrame:
    """One row (intent, answer, status): the question understood, filtered, searched for and answered."""
    from ..operators.filters import same_text
    from ..operators.search import bm25

    q = understand(text, as_of)
    rows = articles
    for name, value in (("source", q.source), ("category", q.category), ("sentiment", q.sentiment)):
        if value:
            rows = rows.filter(same_text(COL(name), value))
    if q.days:
        rows = rows.filter(COL("event_ts").cast("date").between(*(F.lit(d) for d in q.days)))
    fields = {"title": COL("title"), "clean_content": COL("content"), "summary": COL("summary")}
    hits = rows.join(bm25(rows, "article_id", fields, " ".join(question_words(q.corrected)) or q.corrected, limit), "article_id")
    return answer(citations(hits, "article_id", [F.desc("score"), COL("article_id")], limit), q).select(F.lit(q.intent).alias("intent"), "answer", "status")
