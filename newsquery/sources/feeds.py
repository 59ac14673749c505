"""Sources: feeds and sitemaps as XML, JSON dumps, queues; and the lists of addresses that crawls start from.

Fetching over a network is left to whoever puts the files there; everything from the file on is Spark.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..articles import normalize_articles
from ..functions.dates import parse_timestamp
from ..functions.rules import article_link, valid_url
from ..functions.text import article_id

COL = F.col
# The elements of a feed's entry that are read, and a sitemap's possible dates.
ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "description", "pubDate", "author", "category")])
SITEMAP_DATES = ("lastmod", "news:publication_date", "publication_date", "image:publication_date", "video:publication_date", "pubDate")


def rss(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Articles of RSS files, one for each link; the publisher as given, else the file's name."""
    rows = spark.read.format("xml").schema(ENTRY).option("rowTag", "item").load(path)
    name = F.lit(source) if source else F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)?$", 1)
    link = F.trim("link")
    out = rows.filter(link != "").select(article_id(link).alias("article_id"), link.alias("link"), F.trim("title").alias("title"), F.trim("description").alias("description"), name.alias("source"), parse_timestamp(COL("pubDate")).alias("event_ts"))
    return out.dropDuplicates(["link"])


def sitemap(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(article_id, link, event_ts, source) of sitemap files: the first date given, links of articles only."""
    schema = T.StructType([T.StructField("loc", T.StringType()), *(T.StructField(d, T.StringType()) for d in SITEMAP_DATES if ":" not in d), T.StructField("news:news", T.StructType([T.StructField("news:publication_date", T.StringType()), T.StructField("news:title", T.StringType())]))])
    rows = spark.read.format("xml").schema(schema).option("rowTag", "url").load(path)
    when = F.coalesce(parse_timestamp(COL("`news:news`.`news:publication_date`")), *(parse_timestamp(COL(d)) for d in SITEMAP_DATES if ":" not in d))
    return rows.select(F.trim("loc").alias("link"), when.alias("event_ts"), F.trim(COL("`news:news`.`news:title`")).alias("title")).filter(valid_url(COL("link")) & article_link(COL("link"))).select(article_id(COL("link")).alias("article_id"), "link", "title", "event_ts", F.lit(source).alias("source"))


def sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """(loc) of the sitemaps that an index names."""
    schema = T.StructType([T.StructField("loc", T.StringType()), T.StructField("lastmod", T.StringType())])
    return spark.read.format("xml").schema(schema).option("rowTag", "sitemap").load(path).select(F.trim("loc").alias("loc"), parse_timestamp(COL("lastmod")).alias("lastmod"))


def monthly_sitemaps(spark: SparkSession, pattern: str, start: date, end: date) -> DataFrame:
    """(month, url) of a publisher that has a sitemap a month; ``pattern`` holds yyyy and MM."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start), "month"), F.lit(end), F.expr("interval 1 month"))).alias("month"))
    return months.select("month", F.replace(F.replace(F.lit(pattern), F.lit("yyyy"), F.date_format("month", "yyyy")), F.lit("MM"), F.date_format("month", "MM")).alias("url"))


def collect(frames: list[DataFrame]) -> DataFrame:
    """Several collectors' articles, each link once."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.dropDuplicates(["link"])


def json_articles(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Canonical articles of JSON files: a document a line, or with ``multiline`` an array a file."""
    if multiline:
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("json"))
    else:
        raw = spark.read.text(path).select(COL("value").alias("json"))
    return normalize_articles(raw)


def pending(articles: DataFrame, done: str, key: str, limit: int) -> DataFrame:
    """The next batch of work: not done (null is not done), in the order of the key."""
    return articles.filter(~F.coalesce(done, F.lit(False))).orderBy(key).limit(limit)


def kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = True, per_trigger: int = 10000, **options: str) -> DataFrame:
    """(key, json, ts) of a topic. Needs the Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    if streaming:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select(COL("key").cast("string"), COL("value").cast("string").alias("json"), COL("timestamp").alias("ts"))
