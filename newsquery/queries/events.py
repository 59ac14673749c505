"""Queries over the event stream as articles: temporal analytics, aggregations, windows, reports."""

from __future__ import annotations

from datetime import date

from ..functions import dates
from ..functions.exprs import percent, rounded, trend
from ..operators import aggregates, filters, joins, search, temporal
from ..plans import reports
from . import query
from .base import ART, BUCKET_SQL, COL, F, as_of, event_articles, pct_sql, round_sql, stamp, stamp_sql, table, trend_sql, window_sql

W = "WITH " + ART


# --- temporal ---------------------------------------------------------------------------------


@query("ts01_windows", "SELECT * FROM (VALUES ('12m', 8760, '1m'), ('1h', 1, '1h'), ('24h', 24, '1h'), ('30d', 720, '1d'), ('3m', 2160, '1w'), ('48h', 48, '1h'), ('6h', 6, '1h'), ('7d', 168, '1d'), ('other', 8760, '1d')) AS t(window_name, hours, bucket)")
def ts01_windows(spark, d):
    return spark.createDataFrame([(w, dates.window_hours(w), dates.recommended_bucket(w)) for w in ("1h", "6h", "24h", "48h", "7d", "30d", "3m", "12m", "other")], "window_name string, hours int, bucket string")


for _b in ("1h", "1d", "1w", "1m"):

    @query(f"ts03_bucket_keys_{_b}", f"{W} SELECT {BUCKET_SQL[_b]} AS bucket, count(*) AS n FROM art GROUP BY 1")
    def _bucket(spark, d, b=_b):
        return event_articles(spark, d).groupBy(dates.bucket_key(COL("event_ts"), b).alias("bucket")).agg(F.count("*").alias("n"))


@query("ts05_date_quality", f"{W} SELECT count(*) AS total, count(*) FILTER (f = 'published') AS published_count, count(*) FILTER (f = 'created') AS created_count, count(*) FILTER (f = 'updated') AS updated_count, count(*) FILTER (f = 'fetched') AS fetched_count, count(*) FILTER (f IS NULL) AS missing_count, {pct_sql('count(f)', 'count(*)')} AS valid_pct, CASE WHEN {pct_sql('count(f)', 'count(*)')} >= 90 THEN 'EXCELLENT' WHEN {pct_sql('count(f)', 'count(*)')} >= 70 THEN 'ACCEPTABLE' ELSE 'DEGRADED' END AS verdict FROM (SELECT CASE category WHEN 'click' THEN 'published' WHEN 'error' THEN 'created' WHEN 'view' THEN 'updated' WHEN 'signup' THEN 'fetched' END AS f FROM art)")
def ts05_date_quality(spark, d):
    field = F.when(COL("category") == "click", "published").when(COL("category") == "error", "created").when(COL("category") == "view", "updated").when(COL("category") == "signup", "fetched")
    return temporal.date_quality(event_articles(spark, d).withColumn("event_ts_field", field).withColumn("event_ts", F.when(COL("event_ts_field").isNotNull(), COL("event_ts"))))


@query("ts06_trend", "SELECT a, b, " + trend_sql("a", "b")[0] + " AS direction, " + trend_sql("a", "b")[1] + " AS growth FROM (VALUES (20, 10), (5, 20), (10, 10), (15, 1), (11, 10), (0, 0)) AS t(a, b)")
def ts06_trend(spark, d):
    direction, growth = trend(COL("a"), COL("b"))
    return spark.createDataFrame([(20, 10), (5, 20), (10, 10), (15, 1), (11, 10), (0, 0)], "a int, b int").select("a", "b", direction.alias("direction"), growth.alias("growth"))


def _volume_sql(hours: int, bucket: str) -> str:
    d, g = trend_sql("c", "p")
    return f"""{W}, b AS (SELECT {BUCKET_SQL[bucket]} AS k, count(*) AS n FROM art WHERE {window_sql(hours)} GROUP BY 1),
 p AS (SELECT count(*) AS p FROM art, lim WHERE event_ts >= as_of - INTERVAL {2 * hours} HOUR AND event_ts < as_of - INTERVAL {hours} HOUR),
 s AS (SELECT CAST(sum(n) AS BIGINT) AS c, avg(n) AS a, max(n) AS hi, min(n) AS lo, arg_max(n, k) AS last FROM b)
SELECT c AS total_count, p AS previous_period_count, {round_sql('a', 1)} AS average_per_bucket, hi AS peak_bucket_count, lo AS lowest_bucket_count, last AS current_bucket_count, {d} AS trend_direction, {g} AS growth_pct, c - p AS abs_change FROM s, p"""


@query("ts07_volume_buckets", f"{W} SELECT {BUCKET_SQL['1h']} AS timestamp, count(*) AS count FROM art WHERE {window_sql(24)} GROUP BY 1")
def ts07_volume_buckets(spark, d):
    return temporal.volume_buckets(event_articles(spark, d), as_of(spark, d), "24h")


@query("ts07_volume_summary", _volume_sql(24, "1h"))
def ts07_volume_summary(spark, d):
    return temporal.volume_summary(event_articles(spark, d), as_of(spark, d), "24h")


@query("ts07_volume_summary_7d", _volume_sql(168, "1d"))
def ts07_volume_summary_7d(spark, d):
    return temporal.volume_summary(event_articles(spark, d), as_of(spark, d), "7d")


def _trends_sql(column: str) -> str:
    return f"""{W}, w AS (SELECT {BUCKET_SQL['1d']} AS k, {column} AS v, count(*) AS n FROM art WHERE {window_sql(168)} GROUP BY 1, 2)
SELECT a.k AS timestamp, b.v AS value, coalesce(w.n, 0) AS count FROM (SELECT DISTINCT k FROM w) a CROSS JOIN (SELECT DISTINCT v FROM w) b LEFT JOIN w ON w.k = a.k AND w.v = b.v"""


for _id, _dim in (("ts08_source_trends", "source"), ("ts09_category_trends", "category"), ("ts10_sentiment_trends", "sentiment")):

    @query(_id, _trends_sql(_dim))
    def _trends(spark, d, dim=_dim):
        return temporal.dimension_trends(event_articles(spark, d), dim, as_of(spark, d), "7d")


@query("ts08_source_shares", f"{W} SELECT source AS value, count(*) AS count, {pct_sql('count(*)', 'sum(count(*)) OVER ()')} AS share_pct FROM art WHERE {window_sql(168)} GROUP BY 1")
def ts08_source_shares(spark, d):
    return temporal.shares(event_articles(spark, d), "source", as_of(spark, d), "7d")


@query("ts10_sentiment_pivot", f"{W} SELECT {BUCKET_SQL['1d']} AS timestamp, count(*) FILTER (sentiment = 'Positive') AS positive, count(*) FILTER (sentiment = 'Neutral') AS neutral, count(*) FILTER (sentiment = 'Negative') AS negative FROM art WHERE {window_sql(720)} GROUP BY 1")
def ts10_sentiment_pivot(spark, d):
    return temporal.pivoted_trends(event_articles(spark, d), "sentiment", list(reports.SENTIMENTS), as_of(spark, d), "30d")


@query(
    "ts11_overall_spike",
    f"""{W}, b AS (SELECT {BUCKET_SQL['1h']} AS k, count(*) AS n FROM art WHERE {window_sql(24)} GROUP BY 1), m AS (SELECT *, max(k) OVER () AS last FROM b),
 s AS (SELECT count(*) AS buckets, max(n) FILTER (k = last) AS cur, avg(n) FILTER (k < last) AS mu, stddev_pop(n) FILTER (k < last) AS sd FROM m), t AS (SELECT *, greatest({round_sql('(mu + 2 * sd)', 1)}, 5.0) AS thr FROM s)
SELECT buckets, cur AS current_value, {round_sql('mu', 1)} AS baseline_mean, {round_sql('sd', 2)} AS baseline_std, thr AS threshold, buckets >= 5 AND cur >= thr AS is_spike FROM t""",
)
def ts11_overall_spike(spark, d):
    return temporal.overall_spike(event_articles(spark, d), as_of(spark, d), "24h")


def _spikes_sql(column: str) -> str:
    return f"""{W}, w AS (SELECT {BUCKET_SQL['1h']} AS k, {column} AS v, count(*) AS n FROM art WHERE {window_sql(24)} GROUP BY 1, 2),
 g AS (SELECT a.k, b.v, coalesce(w.n, 0) AS n, max(a.k) OVER () AS last FROM (SELECT DISTINCT k FROM w) a CROSS JOIN (SELECT DISTINCT v FROM w) b LEFT JOIN w ON w.k = a.k AND w.v = b.v),
 s AS (SELECT v, CAST(sum(CASE WHEN k = last THEN n ELSE 0 END) AS BIGINT) AS cur, avg(n) AS mu, stddev_pop(n) AS sd FROM g GROUP BY 1), t AS (SELECT *, greatest({round_sql('(mu + 2 * sd)', 1)}, 3.0) AS thr FROM s)
SELECT v AS value, cur AS current_value, {round_sql('mu', 1)} AS baseline_mean, thr AS threshold, {round_sql('((cur - mu) / greatest(mu, 1.0) * 100.0)', 1)} AS growth_pct, cur >= thr AND cur >= 3 AS is_spike FROM t"""


for _id, _dim in (("ts12_source_spikes", "source"), ("ts13_category_spikes", "category")):

    @query(_id, _spikes_sql(_dim))
    def _spikes(spark, d, dim=_dim):
        return temporal.dimension_spikes(event_articles(spark, d), dim, as_of(spark, d), "24h")


def _emerging_sql(term: str, length: int, kind: str | None) -> str:
    extra = f", arg_max({kind}, (event_ts, {kind})) AS {kind}" if kind else ""
    growth = round_sql("((recent_count - baseline_count) / CAST(greatest(baseline_count, 1) AS DOUBLE) * 100.0)", 1)
    return f"""{W}, b AS (SELECT *, event_ts >= (SELECT as_of - INTERVAL 168 HOUR FROM lim) AS cur FROM art, lim WHERE event_ts BETWEEN as_of - INTERVAL 336 HOUR AND as_of AND length({term}) > {length}),
 c AS (SELECT {term} AS term, CAST(sum(CASE WHEN cur THEN 1 ELSE 0 END) AS BIGINT) AS recent_count, CAST(sum(CASE WHEN cur THEN 0 ELSE 1 END) AS BIGINT) AS baseline_count{extra} FROM b GROUP BY 1),
 t AS (SELECT * FROM c WHERE recent_count > 0 ORDER BY recent_count DESC, term LIMIT 50)
SELECT *, {growth} AS growth_pct, CASE WHEN recent_count + baseline_count >= 4 THEN 'HIGH' ELSE 'LOW CONFIDENCE' END AS confidence FROM t ORDER BY growth_pct DESC, recent_count DESC, term LIMIT 15"""


@query("ts14_emerging_keywords", _emerging_sql("keyword", 3, None))
def ts14_emerging_keywords(spark, d):
    return temporal.emerging(event_articles(spark, d), "keyword", as_of(spark, d), "7d", 3)


@query("ts15_emerging_entities", _emerging_sql("entity", 2, "entity_type"))
def ts15_emerging_entities(spark, d):
    return temporal.emerging(event_articles(spark, d), "entity", as_of(spark, d), "7d", 2, kind="entity_type")


@query(
    "ts16_cross_source_topics",
    f"""{W}, r AS (SELECT * FROM art WHERE {window_sql(168)} AND length(keyword) > 3),
 t AS (SELECT keyword, count(DISTINCT source) AS source_count, count(*) AS article_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM r GROUP BY 1 HAVING count(DISTINCT source) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10),
 s AS (SELECT keyword, string_agg(article_id, ',' ORDER BY rn) AS samples FROM (SELECT keyword, article_id, row_number() OVER (PARTITION BY keyword ORDER BY event_ts DESC, article_id DESC) AS rn FROM r) WHERE rn <= 2 GROUP BY 1)
SELECT t.*, s.samples FROM t JOIN s USING (keyword)""",
)
def ts16_cross_source_topics(spark, d):
    return temporal.cross_source_topics(event_articles(spark, d), as_of(spark, d), "7d")


@query(
    "ts17_explain_trend",
    f"""{W}, r AS (SELECT *, event_ts >= (SELECT as_of - INTERVAL 24 HOUR FROM lim) AS cur FROM art, lim WHERE event_ts BETWEEN as_of - INTERVAL 48 HOUR AND as_of AND contains(lower(source), 'pub1')),
 u AS (SELECT CASE WHEN cur THEN 'current' ELSE 'previous' END AS dimension, '' AS value, count(*) AS count FROM r GROUP BY 1 UNION ALL SELECT 'source', source, count(*) FROM r WHERE cur GROUP BY 2
 UNION ALL SELECT 'category', category, count(*) FROM r WHERE cur GROUP BY 2 UNION ALL SELECT 'keyword', keyword, count(*) FROM r WHERE cur GROUP BY 2),
 k AS (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY count DESC, value) AS INTEGER) AS rank FROM u) SELECT * FROM k WHERE rank <= 5""",
)
def ts17_explain_trend(spark, d):
    return temporal.explain_trend(event_articles(spark, d), as_of(spark, d), "24h", source="PUB1")


@query("wn04_rolling_baseline", f"{W}, b AS (SELECT {BUCKET_SQL['1d']} AS k, count(*) AS n FROM art GROUP BY 1) SELECT k AS timestamp, n AS count, {round_sql('avg(n) OVER e', 2)} AS mean_before, {round_sql('stddev_pop(n) OVER e', 2)} AS std_before FROM b WINDOW e AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def wn04_rolling_baseline(spark, d):
    return temporal.rolling_baseline(event_articles(spark, d))


# --- aggregations -----------------------------------------------------------------------------


@query("ag01_group_counts", f"{W} SELECT 'source' AS dimension, source AS value, count(*) AS count FROM art GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM art GROUP BY 2 UNION ALL SELECT 'sentiment', sentiment, count(*) FROM art GROUP BY 2")
def ag01_group_counts(spark, d):
    return aggregates.counts_by(event_articles(spark, d), "source", "category", "sentiment")


for _id, _c in (("ag02_top_keywords", "keyword"), ("ag03_top_entities", "entity")):

    @query(_id, f"{W} SELECT {_c} AS value, count(*) AS count FROM art GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
    def _top(spark, d, c=_c):
        return aggregates.top_values(event_articles(spark, d), COL(c))


@query("ag04_dashboard", f"{W} SELECT count(*) AS total, count(*) FILTER (event_ts >= date_trunc('day', as_of)) AS today, count(*) FILTER (sentiment = 'Positive') AS positive, count(*) FILTER (sentiment = 'Neutral') AS neutral, count(*) FILTER (sentiment = 'Negative') AS negative, count(DISTINCT source) AS sources FROM art, lim")
def ag04_dashboard(spark, d):
    return reports.dashboard(event_articles(spark, d), as_of(spark, d))


@query("ag05_corpus_statistics", f"{W} SELECT count(*) AS total, count(DISTINCT source) AS sources, count(DISTINCT category) AS categories, count(DISTINCT keyword) AS keywords FROM art")
def ag05_corpus_statistics(spark, d):
    return event_articles(spark, d).agg(F.count("*").alias("total"), *(F.count_distinct(c).alias(n) for c, n in (("source", "sources"), ("category", "categories"), ("keyword", "keywords"))))


@query("ag06_hour_of_day", f"{W} SELECT CAST(h AS INTEGER) AS hour, coalesce(n, 0) AS count FROM range(24) r(h) LEFT JOIN (SELECT hour(event_ts) AS hh, count(*) AS n FROM art GROUP BY 1) ON hh = h")
def ag06_hour_of_day(spark, d):
    return temporal.hour_of_day(event_articles(spark, d))


@query("ag08_stage_counts", f"{W} SELECT stage, (SELECT count(*) FROM art WHERE category = stage) AS count FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('none')) v(stage)")
def ag08_stage_counts(spark, d):
    return aggregates.status_counts(event_articles(spark, d), "category", ["click", "error", "purchase", "signup", "view", "none"])


@query("ag09_freshness", f"{W} SELECT p.source, {stamp_sql('max(a.event_ts)')} AS latest, CASE WHEN max(a.event_ts) IS NULL THEN 'NO RECENT DATA' ELSE 'FRESH' END AS status FROM (VALUES ('pub0'), ('pub1'), ('pub2'), ('pub3'), ('pub9')) p(source) LEFT JOIN art a ON a.source = p.source GROUP BY 1")
def ag09_freshness(spark, d):
    names = spark.createDataFrame([(f"pub{i}",) for i in (0, 1, 2, 3, 9)], "source string")
    return aggregates.freshness(event_articles(spark, d), names, "source", "event_ts").select("source", stamp("latest", "latest"), "status")


@query("ag10_distinct_counts", f"{W} SELECT category, count(DISTINCT source) AS n_sources, count(DISTINCT entity) AS n_entities FROM art GROUP BY 1")
def ag10_distinct_counts(spark, d):
    return event_articles(spark, d).groupBy("category").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("entity").alias("n_entities"))


@query("ag11_sources_of_topics", f"{W} SELECT keyword, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM art GROUP BY 1")
def ag11_sources_of_topics(spark, d):
    return event_articles(spark, d).groupBy("keyword").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("ag12_first_last_seen", f"{W} SELECT keyword, {stamp_sql('min(event_ts)')} AS first_seen, {stamp_sql('max(event_ts)')} AS last_seen, count(*) AS count FROM art GROUP BY 1")
def ag12_first_last_seen(spark, d):
    return aggregates.first_last(event_articles(spark, d), "keyword", "event_ts").select("keyword", stamp("first_seen", "first_seen"), stamp("last_seen", "last_seen"), "count")


for _id, _n in (("ag13_mode", 1), ("ag14_top_n", 3)):

    @query(_id, f"{W}, c AS (SELECT source, keyword, count(*) AS count FROM art GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY count DESC, keyword) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= {_n}")
    def _modes(spark, d, n=_n):
        return aggregates.top_per_group(event_articles(spark, d), "source", "keyword", n)


@query("ag15_sentiment_split", f"{W} SELECT " + ", ".join(f"{pct_sql(f'''count(*) FILTER (sentiment = '{s}')''', 'count(*)')} AS {s.lower()}_pct" for s in reports.SENTIMENTS) + " FROM art")
def ag15_sentiment_split(spark, d):
    return aggregates.label_split(event_articles(spark, d), "sentiment", list(reports.SENTIMENTS))


@query("ag16_duplicates", f"{W} SELECT keyword, entity, count(*) AS count FROM art GROUP BY 1, 2 HAVING count(*) > 1")
def ag16_duplicates(spark, d):
    return aggregates.duplicates(event_articles(spark, d), "keyword", "entity")


@query("ag18_mean_scores", f"{W}, m AS (SELECT entity, category, {round_sql('avg(value)', 4)} AS score FROM art GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, category) AS rn FROM m) SELECT entity, category, score FROM r WHERE rn = 1")
def ag18_mean_scores(spark, d):
    return aggregates.mean_scores(event_articles(spark, d), "entity", "category", "value")


@query("ag19_progress", f"{W}, c AS (SELECT count(*) AS t, count(*) FILTER (sentiment = 'Positive') AS k FROM art) SELECT t AS total, k AS completed, t - k AS remaining, {pct_sql('k', 't', 2)} AS pct FROM c")
def ag19_progress(spark, d):
    return aggregates.progress(event_articles(spark, d), COL("sentiment") == "Positive")


@query("ag20_source_counts", f"{W} SELECT source, category, count(*) AS count FROM art GROUP BY 1, 2")
def ag20_source_counts(spark, d):
    return event_articles(spark, d).groupBy("source", "category").agg(F.count("*").alias("count"))


@query("ag21_entity_labels", f"{W} SELECT entity_type, count(*) AS mentions, count(DISTINCT entity) AS entities FROM art GROUP BY 1")
def ag21_entity_labels(spark, d):
    return event_articles(spark, d).groupBy("entity_type").agg(F.count("*").alias("mentions"), F.count_distinct("entity").alias("entities"))


@query("ag22_runtime_statistics", f"SELECT event_type, count(*) AS requests, count(*) FILTER (value < 60) AS succeeded, {round_sql('avg(value)', 2)} AS mean_value, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def ag22_runtime_statistics(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(COL("value") < 60).alias("succeeded"), rounded(F.avg("value"), 2).alias("mean_value"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(
    "ag23_acceptance",
    f"{W}, o AS (SELECT count(*) AS f, count(*) FILTER (sentiment <> 'Negative') AS s, count(*) FILTER (sentiment = 'Negative') AS q FROM art), r AS (SELECT CAST(s AS DOUBLE) / greatest(f, 1) AS y, CAST(s AS DOUBLE) / greatest(s + q, 1) AS g FROM o) SELECT {round_sql('y', 4)} AS yield, {round_sql('g', 4)} AS quality, y >= 0.5 AND g >= 0.6 AS accepted FROM r",
)
def ag23_acceptance(spark, d):
    rows = event_articles(spark, d).select(F.lit(1).alias("discovered"), (COL("sentiment") != "Negative").cast("int").alias("stored"), (COL("sentiment") == "Negative").cast("int").alias("quarantined"))
    return aggregates.acceptance(rows, "discovered", "stored", "quarantined")


# --- windows, order, sets ---------------------------------------------------------------------


@query("wn01_rank", f"{W}, b AS (SELECT article_id, value FROM art ORDER BY value DESC, article_id LIMIT 20) SELECT article_id, value, CAST(row_number() OVER (ORDER BY value DESC, article_id) AS INTEGER) AS rank FROM b")
def wn01_rank(spark, d):
    from pyspark.sql import Window

    best = event_articles(spark, d).select("article_id", "value").orderBy(F.desc("value"), "article_id").limit(20)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "article_id")))


@query("wn02_samples", f"{W}, r AS (SELECT source, article_id, CAST(row_number() OVER (PARTITION BY source ORDER BY event_ts DESC, article_id DESC) AS INTEGER) AS rank FROM art) SELECT * FROM r WHERE rank <= 3")
def wn02_samples(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("event_ts"), F.desc("article_id"))
    return event_articles(spark, d).select("source", "article_id", F.row_number().over(w).alias("rank")).filter("rank <= 3")


@query(
    "wn03_stages",
    f"{W}, r AS (SELECT keyword, article_id, row_number() OVER (PARTITION BY keyword ORDER BY event_ts, article_id) AS s, count(*) OVER (PARTITION BY keyword) AS n FROM art) SELECT article_id, CAST(s AS INTEGER) AS step, CASE WHEN s = 1 THEN 'Initial Report' WHEN s = n THEN 'Latest Update' WHEN s = 2 THEN 'Follow-up' ELSE 'Development' END AS stage FROM r",
)
def wn03_stages(spark, d):
    from ..plans.stories import timeline

    return timeline(event_articles(spark, d).withColumn("story", COL("keyword"))).select("article_id", "step", "stage")


@query("wn05_prior_period", f"{W}, b AS (SELECT {BUCKET_SQL['1d']} AS day, count(*) AS count FROM art GROUP BY 1) SELECT day, count, lag(count) OVER (ORDER BY day) AS before FROM b")
def wn05_prior_period(spark, d):
    from pyspark.sql import Window

    per = event_articles(spark, d).groupBy(dates.bucket_key(COL("event_ts"), "1d").alias("day")).agg(F.count("*").alias("count"))
    return per.withColumn("before", F.lag("count").over(Window.orderBy("day")))


@query("wn06_share_of_total", f"{W} SELECT category, count(*) AS count, {pct_sql('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM art GROUP BY 1")
def wn06_share_of_total(spark, d):
    from pyspark.sql import Window

    per = event_articles(spark, d).groupBy("category").agg(F.count("*").alias("count"))
    return per.withColumn("pct", percent(COL("count"), F.sum("count").over(Window.partitionBy())))


@query("wn07_earliest_report", f"{W} SELECT source, arg_min(article_id, (event_ts, article_id)) AS first_article FROM art GROUP BY 1")
def wn07_earliest_report(spark, d):
    return event_articles(spark, d).groupBy("source").agg(F.min_by("article_id", F.struct("event_ts", "article_id")).alias("first_article"))


@query("sl01_latest", f"{W} SELECT article_id, {stamp_sql('event_ts')} AS event_ts FROM art ORDER BY art.event_ts DESC, article_id LIMIT 100")
def sl01_latest(spark, d):
    return event_articles(spark, d).orderBy(F.desc("event_ts"), "article_id").limit(100).select("article_id", stamp("event_ts", "event_ts"))


@query("sl02_multi_key_sort", f"{W} SELECT keyword, count(DISTINCT source) AS s, count(*) AS n FROM art GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25")
def sl02_multi_key_sort(spark, d):
    return event_articles(spark, d).groupBy("keyword").agg(F.count_distinct("source").alias("s"), F.count("*").alias("n")).orderBy(F.desc("s"), F.desc("n"), "keyword").limit(25)


@query("sl03_page", f"{W} SELECT article_id, category FROM art WHERE lower(category) = 'view' ORDER BY event_ts DESC, article_id LIMIT 20 OFFSET 40")
def sl03_page(spark, d):
    rows = event_articles(spark, d).filter(filters.same_text(COL("category"), " View"))
    return filters.page(rows, [F.desc("event_ts"), COL("article_id")], 40, 20).select("article_id", "category")


@query("sl04_nulls_oldest", f"{W} SELECT article_id FROM (SELECT article_id, CASE WHEN category = 'error' THEN NULL ELSE event_ts END AS t FROM art) ORDER BY t ASC NULLS FIRST, article_id LIMIT 50")
def sl04_nulls_oldest(spark, d):
    rows = event_articles(spark, d).withColumn("t", F.when(COL("category") != "error", COL("event_ts")))
    return rows.orderBy(F.asc_nulls_first("t"), "article_id").limit(50).select("article_id")


@query("so01_union_by_priority", f"{W}, u AS (SELECT article_id, min(p) AS priority FROM (SELECT article_id, 1 AS p FROM art WHERE keyword = 'topic7' UNION ALL SELECT article_id, 2 FROM art WHERE source = 'pub2') GROUP BY 1) SELECT * FROM u")
def so01_union_by_priority(spark, d):
    a = event_articles(spark, d)
    level = F.when(COL("keyword") == "topic7", 1).when(COL("source") == "pub2", 2)
    return a.select("article_id", level.alias("priority")).filter("priority is not null")


@query("so02_intersect", f"{W} SELECT entity FROM art WHERE category = 'purchase' INTERSECT SELECT entity FROM art WHERE category = 'signup'")
def so02_intersect(spark, d):
    a = event_articles(spark, d)
    return a.filter("category = 'purchase'").select("entity").intersect(a.filter("category = 'signup'").select("entity"))


@query("so03_except", f"{W} SELECT DISTINCT keyword FROM art WHERE source = 'pub0' EXCEPT SELECT keyword FROM art WHERE source = 'pub1' AND value > 100")
def so03_except(spark, d):
    a = event_articles(spark, d)
    return joins.new_only(a.filter("source = 'pub0'").select("keyword").distinct(), a.filter("source = 'pub1' and value > 100"), "keyword")


@query("so04_union_sources", f"{W}, u AS (SELECT article_id, source FROM art WHERE source = 'pub0' UNION SELECT article_id, source FROM art WHERE source IN ('pub0', 'pub1')) SELECT source, count(*) AS n FROM u GROUP BY 1")
def so04_union_sources(spark, d):
    a = event_articles(spark, d).select("article_id", "source")
    return a.filter("source = 'pub0'").unionByName(a.filter("source in ('pub0', 'pub1')")).distinct().groupBy("source").agg(F.count("*").alias("n"))


# --- predicates -------------------------------------------------------------------------------


@query("fl01_same_text", f"{W} SELECT count(*) AS n FROM art WHERE lower(source) = 'pub1' AND lower(category) = 'view' AND lower(sentiment) = 'positive'")
def fl01_same_text(spark, d):
    cond = filters.same_text(COL("source"), "PUB1") & filters.same_text(COL("category"), "View") & filters.same_text(COL("sentiment"), "positive")
    return event_articles(spark, d).filter(cond).agg(F.count("*").alias("n"))


@query("fl02_exact", f"{W} SELECT source, count(*) AS n FROM art WHERE category = 'error' GROUP BY 1")
def fl02_exact(spark, d):
    return event_articles(spark, d).filter(COL("category") == "error").groupBy("source").agg(F.count("*").alias("n"))


@query("fl03_keyword_contains", f"{W} SELECT article_id, keyword FROM art WHERE contains(keyword, 'ic4')")
def fl03_keyword_contains(spark, d):
    a = event_articles(spark, d)
    return a.filter(filters.any_element(F.array("keyword"), "IC4")).select("article_id", "keyword")


@query("fl04_case_variants", f"{W} SELECT count(*) AS n FROM art WHERE sentiment IN ('neutral', 'Neutral', 'NEUTRAL')")
def fl04_case_variants(spark, d):
    return event_articles(spark, d).filter(filters.case_variants(COL("sentiment"), "neutral ")).agg(F.count("*").alias("n"))


@query("fl09_closed_range", f"{W} SELECT (SELECT count(*) FROM art WHERE {window_sql(24)}) AS cur, (SELECT count(*) FROM art, lim WHERE event_ts >= as_of - INTERVAL 48 HOUR AND event_ts < as_of - INTERVAL 24 HOUR) AS prev")
def fl09_closed_range(spark, d):
    return temporal.with_period(event_articles(spark, d), as_of(spark, d), "24h").agg(F.count_if(COL("cur") == 1).alias("cur"), F.count_if(COL("cur") == 0).alias("prev"))


@query("fl11_flashback", f"{W} SELECT 'source' AS dimension, source AS value, count(*) AS count FROM art WHERE event_ts >= '2024-01-10' AND event_ts < '2024-01-13' AND category = 'view' GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM art WHERE event_ts >= '2024-01-10' AND event_ts < '2024-01-13' AND category = 'view' GROUP BY 2 UNION ALL SELECT 'sentiment', sentiment, count(*) FROM art WHERE event_ts >= '2024-01-10' AND event_ts < '2024-01-13' AND category = 'view' GROUP BY 2")
def fl11_flashback(spark, d):
    return reports.time_machine(event_articles(spark, d), date(2024, 1, 10), date(2024, 1, 12), "View")


@query("fl12_status_counts", f"{W} SELECT count(*) FILTER (category = 'error') AS failed, count(*) FILTER (category <> 'error') AS fine FROM art")
def fl12_status_counts(spark, d):
    return event_articles(spark, d).agg(F.count_if(COL("category") == "error").alias("failed"), F.count_if(COL("category") != "error").alias("fine"))


@query("fl14_by_id", f"{W} SELECT article_id, category FROM art WHERE article_id = '42' LIMIT 1")
def fl14_by_id(spark, d):
    return filters.by_id(event_articles(spark, d), "42", "article_id").select("article_id", "category")


@query("fl25_eligible", f"{W} SELECT count(*) FILTER (source = 'pub0' AND NOT coalesce(category = 'view', false)) AS n FROM art")
def fl25_eligible(spark, d):
    return event_articles(spark, d).agg(F.count_if(filters.eligible(COL("category") == "view", COL("source") == "pub0")).alias("n"))


@query(
    "fl26_claimable",
    f"""{W}, q AS (SELECT CASE category WHEN 'click' THEN 'PENDING' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PROCESSING' ELSE 'COMPLETED' END AS s, value < 60 AS r, CAST(value AS INTEGER) % 5 AS t, event_ts, as_of FROM art, lim)
 SELECT s, count(*) FILTER (s = 'PENDING' OR (s = 'FAILED' AND r AND t < 3) OR (s = 'PROCESSING' AND epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', event_ts)) > 300)) AS n FROM q GROUP BY 1""",
)
def fl26_claimable(spark, d):
    s = F.when(COL("category") == "click", "PENDING").when(COL("category") == "error", "FAILED").when(COL("category") == "view", "PROCESSING").otherwise("COMPLETED")
    ok = filters.claimable(COL("s"), COL("value") < 60, F.rint("value").cast("int") % 5, COL("event_ts"), F.lit(as_of(spark, d)))
    return event_articles(spark, d).withColumn("s", s).groupBy("s").agg(F.count_if(ok).alias("n"))


@query(
    "fl27_relaxation",
    f"{W}, f AS (SELECT *, CASE WHEN source = 'pub1' AND category = 'view' AND keyword = 'none' THEN 0 WHEN source = 'pub1' AND category = 'view' THEN 1 WHEN source = 'pub1' THEN 2 ELSE 3 END AS l FROM art), m AS (SELECT min(l) AS lv FROM f) SELECT article_id, lv AS relaxation FROM f, m WHERE (lv = 0 AND l = 0) OR (lv = 1 AND source = 'pub1' AND category = 'view') OR (lv = 2 AND source = 'pub1') OR lv = 3",
)
def fl27_relaxation(spark, d):
    s, c = COL("source") == "pub1", COL("category") == "view"
    return filters.relaxed(event_articles(spark, d), s & c & (COL("keyword") == "none"), s & c, s, F.lit(True)).select("article_id", "relaxation")


# --- joins ------------------------------------------------------------------------------------


@query("jn01_skip_ingested", f"{W} SELECT article_id FROM art WHERE article_id NOT IN (SELECT article_id FROM art WHERE category = 'view')")
def jn01_skip_ingested(spark, d):
    a = event_articles(spark, d)
    return joins.new_only(a.select("article_id"), a.filter("category = 'view'"), "article_id")


@query("jn03_duplicate_by_either", f"{W} SELECT article_id, entity FROM art WHERE category = 'click' AND article_id NOT IN (SELECT article_id FROM art WHERE source = 'pub1') AND entity NOT IN (SELECT entity FROM art WHERE keyword = 'topic5')")
def jn03_duplicate_by_either(spark, d):
    a = event_articles(spark, d)
    new = a.filter("category = 'click'").select("article_id", "entity")
    return joins.new_only(joins.new_only(new, a.filter("source = 'pub1'"), "article_id"), a.filter("keyword = 'topic5'"), "entity")


@query("jn04_current_vs_baseline", f"{W} SELECT keyword, count(*) FILTER (event_ts >= as_of - INTERVAL 168 HOUR) AS cur, count(*) FILTER (event_ts < as_of - INTERVAL 168 HOUR) AS base FROM art, lim WHERE event_ts BETWEEN as_of - INTERVAL 336 HOUR AND as_of GROUP BY 1")
def jn04_current_vs_baseline(spark, d):
    return temporal.with_period(event_articles(spark, d), as_of(spark, d), "7d").groupBy("keyword").agg(F.count_if(COL("cur") == 1).alias("cur"), F.count_if(COL("cur") == 0).alias("base"))


@query("jn05_keyword_coverage", f"{W}, k AS (SELECT keyword, count(DISTINCT source) AS sources FROM art GROUP BY 1) SELECT article_id, sources FROM art JOIN k USING (keyword)")
def jn05_keyword_coverage(spark, d):
    a = event_articles(spark, d)
    k = a.groupBy("keyword").agg(F.count_distinct("source").alias("sources"))
    return a.join(k, "keyword").select("article_id", "sources")


@query("jn08_co_occurrence", f"{W}, s AS (SELECT DISTINCT keyword, category FROM art) SELECT a.category AS a, b.category AS b, count(*) AS count FROM s a JOIN s b ON a.keyword = b.keyword AND a.category < b.category GROUP BY 1, 2")
def jn08_co_occurrence(spark, d):
    return joins.co_occurring(event_articles(spark, d), "keyword", "category")


@query("jn_as_of", "WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') SELECT event_id, (SELECT arg_max(p.value, p.ts) FROM p WHERE p.user_id = v.user_id AND p.ts <= v.ts) AS asof_value FROM v")
def jn_as_of(spark, d):
    e = table(spark, d, "events")
    left, right = e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return joins.as_of_join(left, right, "user_id", "ts", "value").select("event_id", "asof_value")


@query("sk02_insert_if_absent", f"{W} SELECT count(*) AS n FROM (SELECT article_id FROM art WHERE source = 'pub0' UNION SELECT article_id FROM art WHERE category = 'view')")
def sk02_insert_if_absent(spark, d):
    a = event_articles(spark, d).select("article_id", "source", "category")
    state = a.filter("source = 'pub0'")
    return state.unionByName(joins.new_only(a.filter("category = 'view'"), state, "article_id")).agg(F.count("*").alias("n"))


@query("sk03_upsert", f"{W}, t AS (SELECT * FROM art WHERE value < 50), s AS (SELECT article_id, category, value + 1000 AS value FROM art WHERE value >= 40) SELECT coalesce(t.article_id, s.article_id) AS article_id, coalesce(t.category, s.category) AS category, CASE WHEN t.article_id IS NULL OR s.article_id IS NOT NULL THEN s.value ELSE t.value END AS value FROM t FULL JOIN s ON t.article_id = s.article_id")
def sk03_upsert(spark, d):
    a = event_articles(spark, d).select("article_id", "category", "value")
    return joins.merge(a.filter("value < 50"), a.filter("value >= 40").withColumn("value", COL("value") + 1000), "article_id", {"value": COL("s.value")})


@query("sk05_field_update", f"{W}, f AS (SELECT article_id, 'NEW' AS category FROM art WHERE source = 'pub3') SELECT a.article_id, coalesce(f.category, a.category) AS category FROM art a LEFT JOIN f USING (article_id)")
def sk05_field_update(spark, d):
    a = event_articles(spark, d).select("article_id", "category", "source")
    return joins.enriched(a.select("article_id", "category"), a.filter("source = 'pub3'").select("article_id", F.lit("NEW").alias("category")), "article_id")


@query("sk10_state", f"{W} SELECT article_id, keyword AS link, source, {stamp_sql('event_ts')} AS published_at FROM art")
def sk10_state(spark, d):
    from ..sources.sinks import state_rows

    return state_rows(event_articles(spark, d).withColumn("link", COL("keyword"))).withColumn("published_at", stamp("published_at"))


# --- rankings and reports ---------------------------------------------------------------------


@query(
    "se08_top_stories",
    f"""{W}, k AS (SELECT keyword, count(DISTINCT source) AS s FROM art WHERE length(keyword) > 3 GROUP BY 1),
 r AS (SELECT article_id, {round_sql("(greatest(100.0 - greatest((epoch_us(as_of) - epoch_us(event_ts)) / 1000000.0 / 3600.0, 0.1) * 2.0, 10.0) * 0.4 + least(coalesce(s, 0) * 15.0, 100.0) * 0.4 + CASE WHEN length(entity) > 50 THEN 30.0 ELSE 10.0 END * 0.2)", 2)} AS score FROM art LEFT JOIN k USING (keyword), lim ORDER BY score DESC, article_id LIMIT 10)
SELECT article_id, score, CAST(row_number() OVER (ORDER BY score DESC, article_id) AS INTEGER) AS rank FROM r""",
)
def se08_top_stories(spark, d):
    return search.top_stories(event_articles(spark, d).withColumn("summary", COL("entity")), as_of(spark, d))


@query("se16_live_feed", f"{W} SELECT article_id FROM art WHERE source IN ('pub2', 'Pub2', 'PUB2') AND regexp_matches(keyword, '(?i)topic1') ORDER BY event_ts DESC, article_id LIMIT 50")
def se16_live_feed(spark, d):
    rows = event_articles(spark, d).filter(filters.case_variants(COL("source"), "pub2") & filters.mentions("topic1x"[:6], COL("keyword")))
    return rows.orderBy(F.desc("event_ts"), "article_id").limit(50).select("article_id")


@query("se17_pages", f"{W} SELECT article_id FROM art WHERE keyword = 'topic3' ORDER BY event_ts DESC, article_id LIMIT 10 OFFSET 5")
def se17_pages(spark, d):
    return filters.page(event_articles(spark, d).filter("keyword = 'topic3'"), [F.desc("event_ts"), COL("article_id")], 5, 10).select("article_id")


_JAN = "event_ts >= '2024-01-05' AND event_ts < '2024-01-08'"


@query(
    "rp01_date_explorer",
    f"""{W}, r AS (SELECT * FROM art WHERE {_JAN}), u AS (SELECT 'source' AS dimension, source AS value, count(*) AS count FROM r GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'sentiment', sentiment, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'keyword', keyword, count(*) FROM r GROUP BY 2),
 k AS (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY count DESC, value) AS INTEGER) AS rank FROM u) SELECT * FROM k WHERE rank <= 5""",
)
def rp01_date_explorer(spark, d):
    return reports.date_explorer(event_articles(spark, d), date(2024, 1, 7), date(2024, 1, 5))


@query("rp02_monthly_heads", f"{W} SELECT strftime(event_ts, '%Y-%m-%d') AS day, count(*) AS count, arg_min(article_id, (event_ts, article_id)) AS first_article FROM art WHERE event_ts >= '2024-01-01' AND event_ts < '2024-02-01' GROUP BY 1")
def rp02_monthly_heads(spark, d):
    return reports.daily_heads(event_articles(spark, d), date(2024, 1, 1), date(2024, 1, 31))


@query(
    "rp06_story_timeline",
    f"{W}, r AS (SELECT article_id, {stamp_sql('event_ts')} AS event_ts, row_number() OVER (ORDER BY art.event_ts, article_id) AS s, count(*) OVER () AS n FROM art WHERE keyword = 'topic11') SELECT article_id, event_ts, CASE WHEN s = 1 THEN 'Initial Report' WHEN s = n THEN 'Latest Update' WHEN s = 2 THEN 'Follow-up' ELSE 'Development' END AS stage FROM r",
)
def rp06_story_timeline(spark, d):
    from ..plans.stories import timeline

    rows = event_articles(spark, d).filter(COL("keyword") == "topic11").withColumn("story", COL("keyword"))
    return timeline(rows).select("article_id", stamp("event_ts", "event_ts"), "stage")


@query("rp07_term_profile", f"{W} SELECT count(*) AS mentions, {stamp_sql('min(event_ts)')} AS first_seen, {stamp_sql('max(event_ts)')} AS last_seen, count(DISTINCT source) AS n_sources, " + ", ".join(f"{pct_sql(f'''count(*) FILTER (sentiment = '{s}')''', 'count(*)')} AS {s.lower()}_pct" for s in reports.SENTIMENTS) + " FROM art WHERE contains(keyword, 'topic42')")
def rp07_term_profile(spark, d):
    out = reports.term_profile(event_articles(spark, d), "Topic42", ["keyword"])
    return out.withColumns({"first_seen": stamp("first_seen"), "last_seen": stamp("last_seen")})


@query("rp07_related_terms", f"{W} SELECT entity AS related, count(*) AS count FROM art WHERE contains(keyword, 'topic42') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def rp07_related_terms(spark, d):
    return reports.related_terms(event_articles(spark, d), "topic42", ["keyword"], "entity")


@query("rp08_briefing", f"{W}, r AS (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY event_ts DESC, article_id DESC) AS INTEGER) AS rank, article_id FROM art WHERE {_JAN}) SELECT * FROM r WHERE rank <= 3")
def rp08_briefing(spark, d):
    return reports.briefing(event_articles(spark, d), date(2024, 1, 5), date(2024, 1, 7))


@query(
    "rp10_entity_investigation",
    f"{W}, e AS (SELECT DISTINCT keyword, entity FROM art), m AS (SELECT DISTINCT keyword FROM art WHERE entity = 'user7') SELECT entity AS related, count(*) AS count FROM e JOIN m USING (keyword) WHERE entity <> 'user7' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def rp10_entity_investigation(spark, d):
    a = event_articles(spark, d).select("keyword", "entity").distinct()
    mine = a.filter("entity = 'user7'").select("keyword")
    return a.filter("entity <> 'user7'").join(mine, "keyword").groupBy(COL("entity").alias("related")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "related").limit(10)


@query("rp11_cross_source", f"{W} SELECT source, count(*) AS count, arg_min(article_id, (event_ts, article_id)) AS first_article, {stamp_sql('min(event_ts)')} AS first_seen FROM art WHERE contains(keyword, 'topic42') GROUP BY 1")
def rp11_cross_source(spark, d):
    return reports.cross_source(event_articles(spark, d), "topic42", ["keyword"]).withColumn("first_seen", stamp("first_seen"))


@query("dt07_age_hours", f"{W} SELECT article_id, {round_sql('greatest((epoch_us(as_of) - epoch_us(event_ts)) / 1000000.0 / 3600.0, 0.1)', 2)} AS hours FROM art, lim")
def dt07_age_hours(spark, d):
    return event_articles(spark, d).select("article_id", rounded(dates.age_hours(COL("event_ts"), F.lit(as_of(spark, d))), 2).alias("hours"))


@query(
    "dt08_relative_time",
    f"{W}, s AS (SELECT article_id, event_ts, epoch(date_trunc('second', as_of)) - epoch(date_trunc('second', event_ts)) AS s FROM art, lim) SELECT article_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || 'h ago' WHEN s < 604800 THEN CAST(CAST(floor(s / 86400) AS BIGINT) AS VARCHAR) || 'd ago' ELSE strftime(event_ts, '%Y-%m-%d') END AS said FROM s",
)
def dt08_relative_time(spark, d):
    return event_articles(spark, d).select("article_id", dates.relative_time(COL("event_ts"), F.lit(as_of(spark, d))).alias("said"))


@query("dt09_month_bounds", f"{W} SELECT strftime(date_trunc('month', event_ts), '%Y-%m-%d') AS first_day, strftime(last_day(event_ts), '%Y-%m-%d') AS end_day, count(*) AS n FROM art GROUP BY 1, 2")
def dt09_month_bounds(spark, d):
    low, high = dates.month_bounds(COL("event_ts").cast("date"))
    return event_articles(spark, d).groupBy(low.cast("string").alias("first_day"), high.cast("string").alias("end_day")).agg(F.count("*").alias("n"))
