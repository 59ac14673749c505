"""Developing stories: articles whose titles share a telling word pair, close in time, are one story."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, title_words
from ..intermediate import delete, written

COL = F.col


def story_links(articles: DataFrame, gap_hours: int = 72) -> DataFrame:
    """(a, b): each article with the first of its run among those that share a word pair.

    A run goes on while the next article is no more than ``gap_hours`` away. One of n articles gives n - 1 links and
    not n squared, and chains of links stay short. Articles of one word pair are put into slots as wide as the gap:
    those of a slot are one run, so only slots are ordered, of which time bounds the number, and a word pair of a
    third of all titles is no task of its own. Articles without a time or a title have no links.
    """
    pairs = articles.select("article_id", "event_ts", F.explode(F.array_distinct(bigrams(title_words(COL("title"))))).alias("bigram"))
    seconds = F.unix_timestamp(COL("event_ts").cast("timestamp"))
    pairs = pairs.withColumn("slot", F.floor(seconds / (gap_hours * 3600))).filter("slot is not null and bigram <> ''")
    slots = pairs.groupBy("bigram", "slot").agg(F.min(F.struct("event_ts", "article_id")).alias("head"), F.min(seconds).alias("begin"), F.max(seconds).alias("end"))
    w = Window.partitionBy("bigram").orderBy("slot")
    cut = F.when(COL("begin") - F.lag("end").over(w) > gap_hours * 3600, 1).otherwise(0)
    runs = slots.withColumn("cut", cut).withColumn("run", F.sum("cut").over(w))
    hub = F.first("head.article_id").over(Window.partitionBy("bigram", "run").orderBy("slot"))
    hubs = runs.select("bigram", "slot", hub.alias("b"))
    return pairs.join(hubs, ["bigram", "slot"]).select(COL("article_id").alias("a"), "b").filter("a <> b").distinct()


def stories(articles: DataFrame, links: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """(article_id, story): the smallest article id that links lead to.

    Labels spread over links and then jump to the label's own label, so rounds grow with the logarithm of a chain's
    length; RuntimeError after ``most_rounds`` instead of an unfinished answer. Only articles that have a link take
    part in the rounds; what is left of the others is their own story. Each round's files go when the next one's are there.
    """
    spark = articles.sparkSession
    links = story_links(articles) if links is None else links
    paths: list[str] = []
    both = written(links.unionByName(links.select(COL("b").alias("a"), COL("a").alias("b"))), "links", paths)
    labels: list[str] = []
    label = written(both.groupBy(COL("a").alias("article_id")).agg(F.min("b").alias("near")).select("article_id", F.least("article_id", "near").alias("story")), "stories", labels)
    for _ in range(most_rounds):
        near = both.join(label, COL("b") == COL("article_id")).groupBy(COL("a").alias("article_id")).agg(F.min("story").alias("near"))
        low = label.join(near, "article_id").select("article_id", F.least("story", "near").alias("story"), COL("story").alias("old"))
        # two jumps a round
        one = label.select(COL("article_id").alias("story"), COL("story").alias("root"))
        far = low.join(one, "story", "left").select("article_id", F.least("story", "root").alias("story"), "old")
        before, labels = labels, []
        after = written(far.join(one, "story", "left").select("article_id", F.least("story", "root").alias("story"), "old"), "stories", labels)
        delete(spark, before)
        moved = after.filter("story <> old").limit(1).count()
        label = after.drop("old")
        if not moved:
            delete(spark, paths)
            return articles.select("article_id").join(label, "article_id", "left").select("article_id", F.coalesce("story", "article_id").alias("story"))
    raise RuntimeError(f"stories are not united after {most_rounds} rounds")


def developing(articles: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """(story, title, updates, sources, first_report, last_update, status, confidence) of stories of two articles and more."""
    rows = articles.join(stories(articles) if membership is None else membership, "article_id")
    one = rows.groupBy("story").agg(
        F.count("*").alias("updates"), F.count_distinct("source").alias("n_sources"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.min("event_ts").alias("first_report"), F.max("event_ts").alias("last_update"), F.max_by("title", F.struct(F.length("title"), "title")).alias("title")
    )
    return one.filter("updates >= 2").select("*", status(COL("n_sources"), COL("updates")).alias("status"), F.least(F.lit(95), 60 + 8 * COL("n_sources") + 2 * COL("updates")).cast("int").alias("confidence"))


def status(sources, updates):
    return F.when((sources >= 3) & (updates >= 5), "BREAKING").when((sources >= 2) & (updates >= 3), "DEVELOPING").when(updates >= 2, "ACTIVE").otherwise("QUIET")


def timeline(articles: DataFrame, last: bool = True) -> DataFrame:
    """Articles in time with the stage of each: first, second, next, and last."""
    w = Window.partitionBy("story").orderBy("event_ts", "article_id")
    n = F.count("*").over(Window.partitionBy("story"))
    step = F.row_number().over(w)
    return articles.withColumn("step", step).withColumn("stage", F.when(COL("step") == 1, "Initial Report").when(COL("step") == n, "Latest Update").when(COL("step") == 2, "Follow-up").otherwise("Development"))
