"""Queries of ingestion: sources read from files that the tables are written to first, sinks, and what stands between."""

from __future__ import annotations

from datetime import date

from ..articles import normalize_articles, text_of
from ..functions import cleaning, dates, rules
from ..functions.exprs import literal, search_pattern
from ..intermediate import new_folder
from ..operators import aggregates, dedup, enrich, filters, html, joins, search
from ..plans import reports
from ..sources import feeds, sinks
from ..streaming import pipeline as st
from . import query
from .base import ART, COL, DOC, F, document_articles, event_articles, stamp, table, window_sql
from .corpus import _bm25_sql, re_sql
from .pages import SKIP
from .streams import _events, _folder, _result

W = "WITH " + ART
D = "WITH " + DOC
VALID = r"regexp_matches(url, '^https?://[^/?#]+/+[^?#]*[^/?#]')"


def _xml(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _write_xml(rows, root: str, folder: str) -> None:
    """Writes one text column as documents with a root element, one a partition."""

    def wrap(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [f"<{root}>"]})
        for batch in batches:
            yield batch.set_axis(["value"], axis=1)
        yield pd.DataFrame({"value": [f"</{root}>"]})

    rows.toDF("value").mapInPandas(wrap, "value string").write.text(folder)


# --- sources ----------------------------------------------------------------------------------


@query("sc01_rss_poll", "SELECT DISTINCT url AS link, sha256(url) AS article_id FROM pages")
def sc01_rss_poll(spark, d):
    folder = _folder(spark)
    item = F.concat(F.lit("<item><title>Page</title><link>"), _xml(COL("url")), F.lit("</link><pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate></item>"))
    _write_xml(table(spark, d, "pages").select(item), "rss", folder)
    return feeds.rss(spark, folder, "Example").select("link", "article_id")


@query("sc02_rss_dump", "SELECT count(DISTINCT url) AS n FROM pages")
def sc02_rss_dump(spark, d):
    folder = _folder(spark)
    table(spark, d, "pages").select(COL("url").alias("link")).dropDuplicates(["link"]).write.json(folder)
    return feeds.json_articles(spark, folder).agg(F.count_distinct("link").alias("n"))


def _sitemap(spark, d):
    folder = _folder(spark)
    entry = F.concat(F.lit("<url><loc>"), _xml(COL("url")), F.lit("</loc><lastmod>2024-01-05</lastmod></url>"))
    _write_xml(table(spark, d, "pages").select(entry), "urlset", folder)
    return feeds.sitemap(spark, folder, "Example")


@query("sc03_sitemap", f"SELECT url AS link, count(*) AS n, '2024-01-05' AS day FROM pages WHERE {VALID} AND NOT regexp_matches(lower(url), '{SKIP}') GROUP BY 1")
def sc03_sitemap(spark, d):
    return _sitemap(spark, d).groupBy("link", F.date_format("event_ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("sc05_publisher_collectors", f"SELECT count(DISTINCT url) AS n FROM pages WHERE {VALID} AND NOT regexp_matches(lower(url), '{SKIP}')")
def sc05_publisher_collectors(spark, d):
    found = _sitemap(spark, d)
    return feeds.collect([found.filter("link like 'https:%'"), found.filter("link like 'http:%'"), found]).agg(F.count("*").alias("n"))


@query("sc06_sitemap_index", "SELECT 'https://x.example.com/s' || CAST(i AS VARCHAR) || '.xml' AS loc FROM range(5) t(i)")
def sc06_sitemap_index(spark, d):
    folder = _folder(spark)
    _write_xml(spark.range(5).select(F.concat(F.lit("<sitemap><loc>https://x.example.com/s"), COL("id").cast("string"), F.lit(".xml</loc></sitemap>"))), "sitemapindex", folder)
    return feeds.sitemap_index(spark, folder).select("loc")


def _queue(spark, d):
    rows = document_articles(spark, d).select("article_id", "link", "title", "content", "lang", "source")
    return sinks.queue_rows(rows)


@query("sc07_queue_decode", f"{D} SELECT article_id, link, source FROM doc")
def sc07_queue_decode(spark, d):
    return normalize_articles(_queue(spark, d).select(COL("value").alias("json"))).select("article_id", "link", COL("source.name").alias("source"))


@query("sc08_bootstrap_batches", f"{D} SELECT count(*) AS decoded, 1 AS malformed FROM doc")
def sc08_bootstrap_batches(spark, d):
    raw = _queue(spark, d).select(COL("value").alias("json")).unionByName(spark.createDataFrame([("{",)], "json string"))
    return normalize_articles(raw).agg(F.count_if(COL("_corrupt_record").isNull()).alias("decoded"), F.count_if(COL("_corrupt_record").isNotNull()).cast("int").alias("malformed"))


@query("sc11_migration_scan", f"{D} SELECT lang, count(*) AS pending FROM doc WHERE doc_id % 3 <> 0 GROUP BY 1")
def sc11_migration_scan(spark, d):
    todo = document_articles(spark, d).filter(~F.coalesce(COL("doc_id") % 3 == 0, F.lit(False)))
    return todo.groupBy("lang").agg(F.count("*").alias("pending"))


@query("sc12_json_array", "SELECT item_id, length(text) AS n FROM benchmark")
def sc12_json_array(spark, d):
    folder = new_folder(spark, "json")
    objects = table(spark, d, "benchmark").select(F.to_json(F.struct(COL("item_id").cast("string").alias("article_id"), COL("text").alias("content"))).alias("value"))
    # files with an array of objects each, as fixtures are: one for every partition, written as it is read
    objects.mapInArrow(_as_arrays, "value string").write.text(folder)
    return feeds.json_articles(spark, folder, multiline=True).select(COL("article_id").cast("long").alias("item_id"), F.length("content").cast("long").alias("n"))


def _as_arrays(batches):
    """The objects of a partition between brackets and with commas; a partition without any is an empty array."""
    import pyarrow as pa

    begin = "["
    for batch in batches:
        rows = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([(begin if i == 0 else ",") + row for i, row in enumerate(rows)], pa.string())], ["value"])
        begin = "," if rows else begin
    yield pa.RecordBatch.from_arrays([pa.array([("[" if begin == "[" else "") + "]"])], ["value"])


@query("sc13_downloaded_pages", "SELECT count(*) AS pages, count(*) FILTER (html IS NOT NULL AND trim(html) <> '') AS with_html FROM pages")
def sc13_downloaded_pages(spark, d):
    return table(spark, d, "pages").agg(F.count("*").alias("pages"), F.count_if(filters.not_empty(COL("html"))).alias("with_html"))


def _index(spark, d):
    folder = _folder(spark)
    a = document_articles(spark, d)
    sinks.write_index(a, folder, "article_id", {"title": COL("title")})
    sinks.write_index(a, folder, "article_id", {"title": COL("title")})  # again, as a repeated job would
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/statistics")


@query("sc14_index_search", _bm25_sql({"title": ("title", 3.0)}, ["edble", "theand"], 10))
def sc14_index_search(spark, d):
    return search.search_index(*_index(spark, d), "article_id", "theand edble", 10)


# --- sinks ------------------------------------------------------------------------------------


@query("sk01_queue_rows", f"{D} SELECT article_id AS key, link FROM doc")
def sk01_queue_rows(spark, d):
    return _queue(spark, d).select("key", F.get_json_object("value", "$.link").alias("link"))


@query("sk04_bulk_upsert", "SELECT url, max(page_id) AS page_id FROM pages GROUP BY 1")
def sk04_bulk_upsert(spark, d):
    last = table(spark, d, "pages").groupBy("url").agg(F.max("page_id").alias("page_id"))
    first = table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id")).filter("page_id % 2 = 0")
    return joins.merge(first, last, "url", {"page_id": COL("s.page_id")})


@query("sk07_index_article", f"{D} SELECT term, count(*) AS df FROM (SELECT DISTINCT article_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS term FROM doc) GROUP BY 1")
def sk07_index_article(spark, d):
    return _index(spark, d)[0].groupBy("term").agg(F.count("*").alias("df"))


@query("sk08_bulk_index_idempotent", f"{D} SELECT count(DISTINCT article_id) AS indexed, CAST(sum(len(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))) AS BIGINT) AS terms FROM doc WHERE len(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) > 0")
def sk08_bulk_index_idempotent(spark, d):
    return _index(spark, d)[0].agg(F.count_distinct("article_id").alias("indexed"), F.sum("tf").alias("terms"))


@query("sk11_checkpoint", "SELECT count(*) AS first_run, count(*) AS second_run FROM events")
def sk11_checkpoint(spark, d):
    from .streams import sm08_resume

    return sm08_resume(spark, d)


@query("sk12_fallback_status", f"{D} SELECT CASE WHEN doc_id % 2 = 0 THEN 'COMPLETED' ELSE 'PENDING' END AS status, count(*) AS n FROM doc GROUP BY 1")
def sk12_fallback_status(spark, d):
    published = COL("doc_id") % 2 == 0  # what the queue did not take is stored as pending
    return document_articles(spark, d).groupBy(F.when(published, "COMPLETED").otherwise("PENDING").alias("status")).agg(F.count("*").alias("n"))


# --- predicates, joins, order, sets -----------------------------------------------------------


@query("pj05_polymorphic_fields", f"{D} SELECT article_id, source FROM doc")
def pj05_polymorphic_fields(spark, d):
    a = document_articles(spark, d)
    shaped = F.when(COL("doc_id") % 2 == 0, F.to_json(F.struct(COL("source").alias("name")))).otherwise(F.concat(F.lit('"'), "source", F.lit('"')))
    return a.select("article_id", text_of(F.parse_json(shaped), "$.name", "$").alias("source"))


@query("fl10_date_or_range", f"{W} SELECT count(*) AS n FROM art WHERE CAST(event_ts AS DATE) >= DATE '2024-01-10' OR event_ts < TIMESTAMP '2024-01-03'")
def fl10_date_or_range(spark, d):
    day = COL("event_ts").cast("date")
    return event_articles(spark, d).filter((day >= F.lit(date(2024, 1, 10))) | (day < F.lit(date(2024, 1, 3)))).agg(F.count("*").alias("n"))


@query("fl19_date_filter", f"{W} SELECT CAST(event_ts AS DATE) AS day, count(*) AS n FROM art WHERE CAST(event_ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY 1")
def fl19_date_filter(spark, d):
    return reports._days(event_articles(spark, d), date(2024, 1, 5), date(2024, 1, 9)).groupBy(COL("event_ts").cast("date").alias("day")).agg(F.count("*").alias("n"))


@query("fl29_queues", f"{W} SELECT queue, count(*) AS n FROM (SELECT unnest(['cleaned', 'keywords', 'sentiment']) AS queue, category, source FROM art) WHERE (queue = 'cleaned' AND source = 'pub0' AND category <> 'view') OR (queue = 'keywords' AND category = 'view' AND source <> 'pub1') OR (queue = 'sentiment' AND source = 'pub1') GROUP BY 1")
def fl29_queues(spark, d):
    s, c = COL("source"), COL("category")
    ready = {"cleaned": filters.eligible(c == "view", s == "pub0"), "keywords": filters.eligible(s == "pub1", c == "view"), "sentiment": filters.eligible(F.lit(None).cast("boolean"), s == "pub1")}
    one = event_articles(spark, d).agg(*(F.count_if(cond).alias(q) for q, cond in ready.items()))
    return one.unpivot([], list(ready), "queue", "n").filter("n > 0")


@query("jn02_skip_stored_links", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def jn02_skip_stored_links(spark, d):
    p = table(spark, d, "pages")
    return joins.new_only(p.select("url").distinct(), p.filter("page_id % 2 = 0"), "url")


@query("jn06_resume", "SELECT page_id FROM pages WHERE page_id >= 20")
def jn06_resume(spark, d):
    p = table(spark, d, "pages").select("page_id")
    return joins.new_only(p, p.filter("page_id < 20"), "page_id")


@query("ts02_recommended_buckets", "SELECT * FROM (VALUES ('1h', '1h'), ('24h', '1h'), ('7d', '1d'), ('3m', '1w'), ('year', '1m'), ('x', '1d')) t(window_name, bucket)")
def ts02_recommended_buckets(spark, d):
    return spark.createDataFrame([(w, dates.recommended_bucket(w)) for w in ("1h", "24h", "7d", "3m", "year", "x")], "window_name string, bucket string")


@query("ts04_event_time", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'published' WHEN event_id % 3 = 1 THEN 'created' ELSE 'fetched' END AS field, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS event_ts FROM events")
def ts04_event_time(spark, d):
    m, t = COL("event_id") % 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = table(spark, d, "events").select(F.to_json(F.struct(COL("event_id").cast("string").alias("article_id"), F.when(m == 0, t).alias("published_date"), F.when(m == 1, t).alias("created_at"), t.alias("fetched_at"))).alias("json"))
    return normalize_articles(raw).select(COL("article_id").cast("long").alias("event_id"), COL("event_ts_field").alias("field"), F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("event_ts"))


@query("ts18_volume_by_hour", f"{W} SELECT CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS count FROM range(24) r(h) LEFT JOIN (SELECT hour(event_ts) AS hh, count(*) AS n FROM art WHERE {window_sql(48)} GROUP BY 1) ON hh = h")
def ts18_volume_by_hour(spark, d):
    from ..operators import temporal
    from .base import as_of

    return temporal.hour_of_day(temporal.in_window(event_articles(spark, d), as_of(spark, d), "48h"))


@query("wn08_day_heads", f"{W}, r AS (SELECT strftime(event_ts, '%Y-%m-%d') AS day, keyword, row_number() OVER (PARTITION BY CAST(event_ts AS DATE) ORDER BY event_ts, article_id) AS rn, count(*) OVER (PARTITION BY CAST(event_ts AS DATE)) AS n FROM art) SELECT day, n, keyword AS first_keyword FROM r WHERE rn = 1")
def wn08_day_heads(spark, d):
    return event_articles(spark, d).groupBy(F.date_format("event_ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min_by("keyword", F.struct("event_ts", "article_id")).alias("first_keyword"))


@query("sl05_most_common", f"{W} SELECT entity AS value, count(*) AS count FROM art GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def sl05_most_common(spark, d):
    return aggregates.top_values(event_articles(spark, d), COL("entity"), 50)


@query("so05_phrase_union", f"SELECT count(*) AS n FROM (SELECT unnest([{', '.join(repr(p) for p in cleaning.HEADINGS)}]) UNION SELECT unnest([{', '.join(chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) for p in cleaning.BOILERPLATE)}]))")
def so05_phrase_union(spark, d):
    both = F.array_union(F.array(*(F.lit(p) for p in cleaning.HEADINGS)), F.array(*(F.lit(p) for p in cleaning.BOILERPLATE)))
    return spark.range(1).select(F.size(both).cast("long").alias("n"))


@query("dq05_insert_dedup", f"{D} SELECT count(*) AS n FROM (SELECT title FROM doc WHERE doc_id % 2 = 1 AND title NOT IN (SELECT title FROM doc WHERE doc_id % 2 = 0) GROUP BY 1)")
def dq05_insert_dedup(spark, d):
    a = document_articles(spark, d).select("doc_id", "title")
    return joins.new_only(a.filter("doc_id % 2 = 1").dropDuplicates(["title"]), a.filter("doc_id % 2 = 0"), "title").agg(F.count("*").alias("n"))


@query("dq06_most_confident", f"{W} SELECT keyword AS item, max(value) AS confidence, count(DISTINCT lower(entity)) AS entities FROM art GROUP BY 1")
def dq06_most_confident(spark, d):
    rows = dedup.entities(event_articles(spark, d).withColumnRenamed("value", "confidence"), "keyword", "entity", "entity_type", "confidence")
    return rows.groupBy(COL("keyword").alias("item")).agg(F.max("confidence").alias("confidence"), F.count_distinct(F.lower("entity")).alias("entities"))


@query("rp12_time_machine", f"{W} SELECT 'source' AS dimension, source AS value, count(*) AS count FROM art WHERE event_ts >= '2024-01-15' AND event_ts < '2024-01-16' GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM art WHERE event_ts >= '2024-01-15' AND event_ts < '2024-01-16' GROUP BY 2 UNION ALL SELECT 'sentiment', sentiment, count(*) FROM art WHERE event_ts >= '2024-01-15' AND event_ts < '2024-01-16' GROUP BY 2")
def rp12_time_machine(spark, d):
    return reports.time_machine(event_articles(spark, d), date(2024, 1, 15), date(2024, 1, 15))


# --- scalar functions -------------------------------------------------------------------------


@query("dt03_published_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def dt03_published_dates(spark, d):
    text = F.when(COL("event_id") % 2 == 0, F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", F.date_format(dates.parse_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("dt05_to_utc", "SELECT event_id, strftime(ts - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def dt05_to_utc(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))
    return table(spark, d, "events").select("event_id", F.date_format(dates.parse_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("st01_unicode")
def st01_unicode(spark, d):
    a = document_articles(spark, d).withColumn("n", cleaning.nfkc(F.concat(F.lit("ﬁ “x” "), "title")))
    return a.select("article_id", cleaning.plain_typography(COL("n")).alias("title"))


@query("st02_entities", f"{D} SELECT article_id, '<&> ' || title AS title FROM doc")
def st02_entities(spark, d):
    return document_articles(spark, d).select("article_id", cleaning.unescape_html(F.concat(F.lit("&lt;&amp;&gt; "), "title")).alias("title"))


@query("st18_literal_patterns", "SELECT * FROM (VALUES ('a+b', true), ('a.b', true), ('(x', true), ('aab', true)) t(query, found)")
def st18_literal_patterns(spark, d):
    rows = [(q, f"1 {q} 2", literal(q)) for q in ("a+b", "a.b", "(x", "aab")]
    return spark.createDataFrame(rows, "query string, t string, p string").select("query", F.rlike("t", COL("p")).alias("found"))


@query("st19_word_patterns", f"{D} SELECT count(*) FILTER (regexp_matches(title, '\\bof\\b')) AS word, count(*) FILTER (regexp_matches(title, 'thereand')) AS part FROM doc")
def st19_word_patterns(spark, d):
    return document_articles(spark, d).agg(F.count_if(COL("title").rlike(search_pattern("of"))).alias("word"), F.count_if(COL("title").rlike(search_pattern("thereand"))).alias("part"))


# --- enrichment and extraction ----------------------------------------------------------------


@query("en02_staged_summary")
def en02_staged_summary(spark, d):
    return document_articles(spark, d).select("article_id", enrich.keep_or_run(F.when(COL("doc_id") % 2 == 0, COL("title")), enrich.summarise(COL("content"))).alias("summary"))


@query("en03_sentiment", f"{D} SELECT CASE WHEN regexp_matches(lower(content), '{re_sql(rules.POSITIVE_WORDS)}') THEN 'Positive' WHEN regexp_matches(lower(content), '{re_sql(rules.NEGATIVE_WORDS)}') THEN 'Negative' ELSE 'Neutral' END AS sentiment, count(*) AS n FROM doc GROUP BY 1")
def en03_sentiment(spark, d):
    return document_articles(spark, d).groupBy(enrich.sentiment(COL("content")).alias("sentiment")).agg(F.count("*").alias("n"))


@query("en07_top_labels", f"{D} SELECT article_id, CASE WHEN n_chars % 3 = 0 THEN 'a,b' ELSE 'b,a' END AS labels FROM doc")
def en07_top_labels(spark, d):
    scores = F.when(COL("n_chars") % 3 == 0, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.1))).otherwise(F.array(F.lit(0.4), F.lit(0.6), F.lit(0.2)))
    top = enrich.top_labels(F.array(F.lit("a"), F.lit("b"), F.lit("c")), scores, 2)
    return document_articles(spark, d).select("article_id", F.array_join(F.transform(top, lambda x: x["label"]), ",").alias("labels"))


@query("en10_staged_keywords")
def en10_staged_keywords(spark, d):
    return document_articles(spark, d).select("article_id", F.posexplode(enrich.extract_keywords(COL("content"))).alias("rank", "keyword"))


@query("en15_event_types", f"{D} SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(content), '{re_sql(w)}') THEN '{c}'" for c, w in rules.CATEGORY_WORDS.items()) + " ELSE 'General' END AS event_type, count(*) AS n FROM doc GROUP BY 1")
def en15_event_types(spark, d):
    return document_articles(spark, d).groupBy(enrich.category(COL("content")).alias("event_type")).agg(F.count("*").alias("n"))


class _Length:
    """A stand-in for a model: it counts characters."""

    schema = "long"

    def load(self):
        return len

    def apply(self, model, texts):
        return texts.map(lambda t: model(t or ""))


@query("en18_batches", f"{D} SELECT article_id, length(content) AS n FROM doc")
def en18_batches(spark, d):
    return enrich.enrich(document_articles(spark, d), "content", "n", _Length()).select("article_id", "n")


@query("en19_distinct_texts", f"{D} SELECT article_id, length(title) AS n FROM doc")
def en19_distinct_texts(spark, d):
    return enrich.enrich(document_articles(spark, d), "title", "n", _Length(), distinct=True).select("article_id", "n")


@query("hx06_selected_fields")
def hx06_selected_fields(spark, d):
    found = html.select_texts(table(spark, d, "pages"), "html", {"paragraphs": ["article", "p"], "headline": ["h1", "title"]})
    return found.select("page_id", F.size("paragraphs").alias("n"), F.get("headline", F.lit(0)).alias("headline"))


#: Selectors of publishers by the host that they are for; a deployment adds its own.
PUBLISHERS = {"example.com": {"headline": ["h1"], "body": ["article"]}, "example.net": {"headline": ["title"], "body": ["article", "p"]}}


@query("hx07_publisher_strategies")
def hx07_publisher_strategies(spark, d):
    p = table(spark, d, "pages").withColumn("host", F.regexp_extract("url", r"([a-z]+\.[a-z]+)(?:/|$)", 1))
    parts = [html.select_texts(p.filter(COL("host") == h), "html", s).select("page_id", "host", F.get("headline", F.lit(0)).alias("headline")) for h, s in PUBLISHERS.items()]
    return parts[0].unionByName(parts[1])


@query("hx08_reader")
def hx08_reader(spark, d):
    h = COL("html")
    return table(spark, d, "pages").select("page_id", html.title(h).alias("title"), html.author(h).alias("author"), html.paragraphs(h).alias("text"))


# --- streaming --------------------------------------------------------------------------------


@query("sm01_continuous_source", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def sm01_continuous_source(spark, d):
    return _result(spark, _events(spark, d).select("article_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("sm02_delivery", "SELECT count(*) AS n FROM events")
def sm02_delivery(spark, d):
    """A batch that is written twice under its number is there once."""
    folder = _folder(spark)

    def twice(batch, number):
        for _ in range(2):
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    st.start(_events(spark, d).select("article_id"), f"{folder}/c", twice).awaitTermination()
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("n"))


@query("sm06_backpressure", "SELECT count(*) AS n, 4 AS batches FROM events")
def sm06_backpressure(spark, d):
    folder = _folder(spark)
    table(spark, d, "events").repartition(4).write.parquet(f"{folder}/in")
    rows = st.file_stream(spark, f"{folder}/in", table(spark, d, "events").schema, per_trigger=1)
    st.start(rows, f"{folder}/c", lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).awaitTermination()
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("n"), F.count_distinct("batch").cast("int").alias("batches"))


@query("sm07_rate", "SELECT count(*) AS n FROM events")
def sm07_rate(spark, d):
    folder = _folder(spark)
    running = st.start(_events(spark, d).select("article_id"), f"{folder}/c", f"{folder}/out", once=False, every="1 second")
    running.processAllAvailable()
    running.stop()
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("n"))


@query("sm09_once", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def sm09_once(spark, d):
    out = _result(spark, _events(spark, d).select("event_ts"))
    return out.groupBy(COL("event_ts").cast("date").alias("day")).agg(F.count("*").alias("n"))


@query("sm10_watermark", f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS count FROM events GROUP BY 1")
def sm10_watermark(spark, d):
    out = _result(spark, st.tumbling(_events(spark, d).withColumn("all", F.lit(1)), "all", "1 day"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "count")


@query("dt_stamp_round_trip", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t FROM events")
def dt_stamp_round_trip(spark, d):
    return table(spark, d, "events").select("event_id", stamp("ts", "t"))


