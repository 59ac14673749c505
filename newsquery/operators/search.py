"""Search: an inverted index as a table, BM25 over several fields, exact vector search, their fusion, and rankings."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import bound
from ..functions.dates import age_hours
from ..functions.exprs import rounded, search_pattern
from ..functions.text import words

COL = F.col
#: The usual constants of BM25.
K1, B = 1.2, 0.75
# How much a field's score counts.
BOOSTS = {"title": 3.0, "clean_content": 1.0, "summary": 2.0, "keywords": 2.0}


def postings(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(field, term, key, tf, length): the inverted index, to be written partitioned by field and clustered by term.

    A row's terms are exploded with the length of their field and counted; the count is partial before it shuffles.
    """
    def terms(name: str, column: Column) -> Column:
        each = lambda own: F.transform(own, lambda w: F.struct(F.lit(name).alias("field"), w.alias("term"), F.size(own).alias("length")))
        return bound(words(F.coalesce(column, F.lit(""))), each)

    rows = df.select(key, F.explode(F.concat(*(terms(n, c) for n, c in fields.items()))).alias("t"))
    return rows.groupBy(key, "t.field", "t.term").agg(F.count("*").alias("tf"), F.first("t.length").alias("length"))


def field_statistics(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, n, mean_length): one row a field."""
    sizes = {n: F.size(words(F.coalesce(c, F.lit("")))) for n, c in fields.items()}
    one = df.agg(F.count("*").alias("n"), *(F.avg(s).alias(n) for n, s in sizes.items()))
    return one.select("n", F.explode(F.create_map(*(x for n in fields for x in (F.lit(n), COL(n))))).alias("field", "mean_length"))


def bm25(df: DataFrame, key: str, fields: dict[str, Column], query: str, limit: int | None = 10, boosts: dict[str, float] | None = None) -> DataFrame:
    """(key, score): per row the best field's boosted BM25, to 4 places, ties by key.

    Without an index table the scan itself is pruned: only the query's terms are counted, by regular array functions,
    so what is shuffled is a partial count of documents for each term and the top rows.
    """
    terms = sorted({w for w in "".join(c.lower() if c.isalnum() else " " for c in query).split()})
    boosts = boosts or BOOSTS
    if not terms:
        return df.select(COL(key), F.lit(0.0).alias("score")).limit(0)
    cols = [COL(key)]
    for f, c in fields.items():
        w = words(F.coalesce(c, F.lit("")))
        cols.append(F.size(w).alias(f"len_{f}"))
        cols += [(F.size(w) - F.size(F.array_remove(w, t))).alias(f"tf_{f}_{i}") for i, t in enumerate(terms)]
    rows = df.select(*cols)
    stats = [F.count("*").alias("n")] + [F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields] + [F.count_if(COL(f"tf_{f}_{i}") > 0).alias(f"df_{f}_{i}") for f in fields for i in range(len(terms))]
    one = rows.agg(*stats)  # one row
    hit = reduce(lambda a, b: a | b, (COL(f"tf_{f}_{i}") > 0 for f in fields for i in range(len(terms))))
    joined = rows.filter(hit).crossJoin(F.broadcast(one))

    def score(f: str) -> Column:
        total = F.lit(0.0)
        for i in range(len(terms)):
            tf, dfreq = COL(f"tf_{f}_{i}").cast("double"), COL(f"df_{f}_{i}")
            idf = F.log(1.0 + (COL("n") - dfreq + 0.5) / (dfreq + 0.5))
            norm = tf + K1 * (1.0 - B + B * COL(f"len_{f}") / F.greatest(COL(f"avg_{f}"), F.lit(1e-9)))
            total = total + F.when(tf > 0, idf * tf * (K1 + 1.0) / norm).otherwise(0.0)
        return total * boosts.get(f, 1.0)

    best = [score(f) for f in fields]
    out = joined.select(key, rounded(best[0] if len(best) == 1 else F.greatest(*best), 4).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def search_index(index: DataFrame, statistics: DataFrame, key: str, query: str, limit: int = 10, boosts: dict[str, float] | None = None) -> DataFrame:
    """(key, score) from a written index: only the query's terms are read, and their postings scored."""
    terms = sorted({w for w in "".join(c.lower() if c.isalnum() else " " for c in query).split()})
    boost = F.create_map(*(x for f, b in (boosts or BOOSTS).items() for x in (F.lit(f), F.lit(b))))
    hits = index.filter(COL("term").isin(*terms)).join(F.broadcast(statistics), "field")
    dfreq = hits.groupBy("field", "term").agg(F.count("*").alias("df"))  # a row for each term and field of the query
    hits = hits.join(F.broadcast(dfreq), ["field", "term"])
    idf = F.log(1.0 + (COL("n") - COL("df") + 0.5) / (COL("df") + 0.5))
    part = idf * COL("tf") * (K1 + 1.0) / (COL("tf") + K1 * (1.0 - B + B * COL("length") / COL("mean_length"))) * F.coalesce(boost[COL("field")], F.lit(1.0))
    per_field = hits.groupBy(key, "field").agg(F.sum(part).alias("s"))
    return per_field.groupBy(key).agg(rounded(F.max("s"), 4).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def near_pairs(df: DataFrame, vector: Column, queries: DataFrame, query_id: str, query_vector: Column, least: float, block: int = 4096) -> DataFrame:
    """The rows of ``df`` beside each query whose cosine is over ``least``: all queries against all rows, in blocks.

    Queries are dealt by a hash of their id into blocks of about ``block``, and one block at a time is sent to the
    tasks, so what a task holds doesn't grow with the number of queries.
    """
    blocks = max(1, -(-queries.count() // block))
    own = [queries.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) for b in range(blocks)]
    return reduce(DataFrame.unionByName, [df.crossJoin(F.broadcast(q)).filter(cosine(vector, query_vector) > least) for q in own])


def knn(df: DataFrame, key: str, vector: str, query: list[float], k: int = 10, dimension: int | None = None) -> DataFrame:
    """(key, score): the k rows of largest cosine, exactly; ValueError for a query of the wrong length.

    The query is a literal: one scan, and each task sends its k best.
    """
    if dimension is not None and len(query) != dimension:
        raise ValueError(f"the query has {len(query)} numbers, not {dimension}")
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.filter(F.size(vector) == len(query)).select(key, rounded(cosine(COL(vector), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid(text: DataFrame, vectors: DataFrame, key: str, limit: int = 10, rrf: int | None = None) -> DataFrame:
    """(key, score): the sum of both scores, or with ``rrf`` of reciprocal ranks. Both sides are top lists."""
    t, v = text.withColumnRenamed("score", "t"), vectors.withColumnRenamed("score", "v")
    if rrf is not None:
        rank = lambda df, c: df.withColumn(c, 1.0 / (rrf + F.row_number().over(Window.orderBy(F.desc(c), key))))
        t, v = rank(t, "t"), rank(v, "v")
    total = F.coalesce("t", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))
    return t.join(v, key, "full_outer").select(key, rounded(total, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def priority_search(df: DataFrame, key: str, query: str, title: Column, content: Column, recent: Column, limit: int = 15) -> DataFrame:
    """Title hits before content hits, newest first; one pass, so nothing has to be united and made distinct."""
    pattern = "(?i)" + search_pattern(query)
    level = F.when(title.rlike(pattern), 1).when(content.rlike(pattern), 2)
    return df.withColumn("priority", level).filter("priority is not null").orderBy("priority", recent, key).limit(limit)


def weighted_search(df: DataFrame, key: str, terms: list[str], fields: dict[str, tuple[Column, float]], limit: int = 15) -> DataFrame:
    """(key, score): for each term the weights of the fields it occurs in."""
    score = F.lit(0.0)
    for t in terms:
        for column, weight in fields.values():
            score = score + F.when(F.coalesce(column, F.lit("")).rlike("(?i)" + search_pattern(t)), weight).otherwise(0.0)
    return df.select(key, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), key).limit(limit)


def top_stories(articles: DataFrame, as_of: datetime, limit: int = 10) -> DataFrame:
    """(rank, article_id, score): 0.4 recency, 0.4 coverage of the keyword by sources, 0.2 length of the summary."""
    covered = articles.filter(F.length("keyword") > 3).groupBy("keyword", "source").agg(F.lit(1).alias("one")).groupBy("keyword").agg(F.count("*").alias("sources"))
    rows = articles.join(covered, "keyword", "left")
    recency = F.greatest(100.0 - age_hours(COL("event_ts"), F.lit(as_of)) * 2.0, F.lit(10.0))
    cross = F.least(F.coalesce("sources", F.lit(0)) * 15.0, F.lit(100.0))
    length = F.when(F.length("summary") > 50, 30.0).otherwise(10.0)
    best = rows.select("article_id", rounded(recency * 0.4 + cross * 0.4 + length * 0.2, 2).alias("score")).orderBy(F.desc("score"), "article_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "article_id")))


def top_news(articles: DataFrame, quality: Column, content: Column, limit: int = 10, category: str | None = None, source: str | None = None) -> DataFrame:
    """(article_id, score): 0.4 quality and up to 30 points for 500 characters; both filters apply."""
    from .filters import same_text

    for name, value in (("category", category), ("source", source)):
        if value:
            articles = articles.filter(same_text(COL(name), value))
    score = F.coalesce(quality, F.lit(70.0)) * 0.4 + F.least(F.length(F.coalesce(content, F.lit(""))) / 500.0, F.lit(1.0)) * 30.0
    return articles.select("article_id", rounded(score, 2).alias("score")).orderBy(F.desc("score"), "article_id").limit(limit)
