"""The canonical article table: its schema, the normaliser of raw documents, and views of other tables as articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.dates import parse_timestamp

_LABELLED = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
ARTICLE = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("article_id", "link", "title", "description", "content", "clean_content", "lang")),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("source", T.StructType([T.StructField(n, T.StringType()) for n in ("name", "country", "language", "type")])),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("event_ts_field", T.StringType()),
        *(T.StructField(n, T.TimestampType()) for n in ("published_ts", "created_ts", "updated_ts", "fetched_ts")),
        T.StructField("category", _LABELLED),
        T.StructField("sentiment", _LABELLED),
        T.StructField("summary", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())]))),
        T.StructField("entities", T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(raw: Column, *paths: str) -> Column:
    """The first of the paths in a JSON value that is a non-empty string; ``$`` is the value itself if it is a string."""
    picks = []
    for path in paths:
        value = F.trim(F.try_variant_get(raw, path, "string"))
        if path == "$":
            value = F.when(~F.schema_of_variant(raw).rlike("^(OBJECT|ARRAY)"), value)
        picks.append(F.when(value != "", value))
    return F.coalesce(*picks)


def normalize_articles(raw: DataFrame, dimension: int | None = None) -> DataFrame:
    """Canonical articles from JSON documents in a string column ``json``.

    Polymorphic fields are read in all their shapes: source, category, sentiment and summary as text or object;
    keywords and entities as texts or objects; an embedding as an array or in an object, null if its length is not
    ``dimension``; dates in any known format. Malformed JSON gives an article of nulls with the text in
    ``_corrupt_record``, so that it can be routed away. The time of the event is the first date that parses of
    published, created, updated and fetched.
    """
    v = F.try_parse_json("json")
    d = raw.withColumn("__v", v)
    get = lambda path, kind="string": F.try_variant_get(F.col("__v"), path, kind)
    of = lambda name, *paths: text_of(F.try_variant_get(F.col("__v"), f"$.{name}", "variant"), *paths)
    stamp = lambda *names: F.coalesce(*(parse_timestamp(get(f"$.{n}")) for n in names))
    elements = lambda name: F.coalesce(get(f"$.{name}", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    score = lambda x, path: F.try_variant_get(x, path, "double")
    vector = F.coalesce(get("$.embedding", "array<float>"), get("$.embedding.vector", "array<float>"), get("$.embedding.embedding", "array<float>"))
    if dimension is not None:
        vector = F.when(F.size(vector) == dimension, vector)
    out = d.select(
        F.coalesce(get("$.article_id"), F.when(get("$.link").isNotNull(), F.sha2(get("$.link"), 256))).alias("article_id"),
        F.coalesce(get("$.link"), get("$.url")).alias("link"),
        *(get(f"$.{n}").alias(n) for n in ("title", "description", "content", "clean_content")),
        F.coalesce(get("$.language"), get("$.lang")).alias("lang"),
        F.coalesce(get("$.authors", "array<string>"), F.when(get("$.authors").isNotNull(), F.array(get("$.authors")))).alias("authors"),
        F.struct(F.coalesce(of("source", "$.name", "$"), F.lit("Unknown Source")).alias("name"), *(get(f"$.source.{n}").alias(n) for n in ("country", "language", "type"))).alias("source"),
        stamp("published_date", "published_datetime", "published").alias("published_ts"),
        *(stamp(f"{n}_at").alias(f"{n}_ts") for n in ("created", "updated", "fetched")),
        F.struct(F.coalesce(of("category", "$.label", "$.category", "$"), F.lit("General")).alias("label"), get("$.category.score", "double").alias("score")).alias("category"),
        F.struct(F.coalesce(of("sentiment", "$.label", "$"), F.lit("Neutral")).alias("label"), get("$.sentiment.score", "double").alias("score")).alias("sentiment"),
        F.coalesce(of("summary", "$.text", "$"), F.lit("")).alias("summary"),
        F.filter(F.transform(elements("keywords"), lambda x: F.struct(text_of(x, "$.keyword", "$.term", "$.text", "$").alias("text"), score(x, "$.score").alias("score"))), lambda k: k["text"].isNotNull()).alias("keywords"),
        F.filter(
            F.transform(elements("entities"), lambda x: F.struct(text_of(x, "$.entity", "$.text", "$").alias("entity"), text_of(x, "$.label", "$.type").alias("label"), score(x, "$.confidence").alias("confidence"))), lambda e: e["entity"].isNotNull()
        ).alias("entities"),
        vector.alias("embedding"),
        F.when(F.col("__v").isNull(), F.col("json")).alias("_corrupt_record"),
    )
    stamps = ("published_ts", "created_ts", "updated_ts", "fetched_ts")
    field = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c.removesuffix("_ts"))) for c in stamps))
    out = out.withColumn("event_ts", F.coalesce(*stamps)).withColumn("event_ts_field", field)
    return out.select(*(f.name for f in ARTICLE), "_corrupt_record")


# --- other tables as flat article streams --------------------------------------------------------


def event_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Events as articles: publisher by user, category by type, sentiment by bands of value, one keyword each."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").cast("string").alias("article_id"),
        F.col("ts").alias("event_ts"),
        F.concat(F.lit("pub"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.col("event_type").alias("category"),
        F.when(F.col("value") < 20, "Negative").when(F.col("value") < 60, "Neutral").otherwise("Positive").alias("sentiment"),
        F.concat(F.lit("topic"), F.get_json_object("props", "$.k")).alias("keyword"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("entity"),
        F.col("event_type").alias("entity_type"),
        "value",
    )


def document_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles: the first line is the title, the whole text the content."""
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("article_id"),
        "doc_id",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/news/"), F.col("doc_id").cast("string")).alias("link"),
        F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        F.col("text").alias("content"),
        "lang",
        "source",
        "n_chars",
    )
