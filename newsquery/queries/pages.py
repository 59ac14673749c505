"""Queries over raw pages: links and their headlines, validity, titles, paragraphs, texts by selector."""

from __future__ import annotations

from datetime import date

from ..functions import dates, rules, text
from ..functions.cleaning import strip_tags
from ..functions.exprs import literal
from ..operators import html
from ..sources.feeds import monthly_sitemaps
from . import query
from .base import COL, F, table

SKIP = "(" + "|".join(literal(w) for w in rules.SKIP_LINKS) + ")"


@query("fl16_article_links", f"SELECT page_id, NOT regexp_matches(lower(url), '{SKIP}') AS is_article FROM pages")
def fl16_article_links(spark, d):
    return table(spark, d, "pages").select("page_id", rules.article_link(COL("url")).alias("is_article"))


@query("fl17_valid_sitemaps", f"SELECT page_id, NOT regexp_matches(lower(url), '{SKIP}') AND regexp_matches(url, '(2021|2022|2023|2024)') AS valid FROM (SELECT page_id, url || '/' || CAST(2019 + page_id % 8 AS VARCHAR) AS url FROM pages)")
def fl17_valid_sitemaps(spark, d):
    p = table(spark, d, "pages").withColumn("url", F.concat("url", F.lit("/"), (2019 + COL("page_id") % 8).cast("string")))
    return p.select("page_id", rules.valid_sitemap(COL("url"), 2024).alias("valid"))


_PAGE_DATE = "CASE page_id % 4 WHEN 0 THEN '2024-03-0' || CAST(page_id % 9 + 1 AS VARCHAR) WHEN 1 THEN 'soon' WHEN 2 THEN NULL ELSE '2023-12-31' END"


@query(
    "fl18_date_or_year",
    f"WITH p AS (SELECT page_id, {_PAGE_DATE} AS day, CASE WHEN page_id % 3 = 0 THEN 'https://x.example.com/' || CAST(2022 + page_id % 5 AS VARCHAR) || '/a' ELSE 'https://x.example.com/a' END AS u FROM pages) SELECT page_id, CASE WHEN try_cast(day AS DATE) IS NOT NULL THEN try_cast(day AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-03-05' WHEN page_id % 3 = 0 THEN 2022 + page_id % 5 = 2024 ELSE true END AS inside FROM p",
)
def fl18_date_or_year(spark, d):
    m = COL("page_id") % 4
    day = F.when(m == 0, F.concat(F.lit("2024-03-0"), (COL("page_id") % 9 + 1).cast("string"))).when(m == 1, "soon").when(m == 3, "2023-12-31")
    url = F.when(COL("page_id") % 3 == 0, F.concat(F.lit("https://x.example.com/"), (2022 + COL("page_id") % 5).cast("string"), F.lit("/a"))).otherwise("https://x.example.com/a")
    return table(spark, d, "pages").select("page_id", dates.in_range(day, url, date(2024, 1, 1), date(2024, 3, 5)).alias("inside"))


@query("fl21_valid_urls", r"SELECT page_id, regexp_matches(url, '^https?://[^/?#]+/+[^?#]*[^/?#]') AS valid FROM pages")
def fl21_valid_urls(spark, d):
    return table(spark, d, "pages").select("page_id", rules.valid_url(COL("url")).alias("valid"))


@query("fl22_valid_authors", "SELECT page_id, NOT regexp_matches(lower(a), '(login|sign in|show password|forgot password|google|facebook|apple|otp|register|subscribe)') AS valid FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Sign In' ELSE 'Ann Lee' END AS a FROM pages)")
def fl22_valid_authors(spark, d):
    a = F.array(F.when(COL("page_id") % 3 == 0, "Sign In").otherwise("Ann Lee"))
    return table(spark, d, "pages").select("page_id", rules.valid_authors(a).alias("valid"))


@query("hx03_titles", "SELECT page_id, trim(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), '')) AS title FROM pages")
def hx03_titles(spark, d):
    return table(spark, d, "pages").select("page_id", html.title(COL("html")).alias("title"))


@query("hx04_authors", "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<meta[^>]*name=[\"'']author[\"''][^>]*content=[\"'']([^\"'']*)[\"'']', 1)), '') AS author FROM pages")
def hx04_authors(spark, d):
    return table(spark, d, "pages").select("page_id", html.author(COL("html")).alias("author"))


@query("hx01_first_valid")
def hx01_first_valid(spark, d):
    h = COL("html")
    return table(spark, d, "pages").select("page_id", html.first_valid(html.paragraphs(h), strip_tags(h)).alias("content"))


@query("hx02_paragraphs")
def hx02_paragraphs(spark, d):
    return table(spark, d, "pages").select("page_id", html.paragraphs(COL("html")).alias("content"))


@query("hx05_selectors")
def hx05_selectors(spark, d):
    found = html.select_texts(table(spark, d, "pages"), "html", {"headline": ["h1", "h2"], "ads": ["div.ad"], "links": ["nav"]})
    return found.select("page_id", F.get("headline", F.lit(0)).alias("headline"), F.size("ads").alias("ads"), F.get("links", F.lit(0)).alias("links"))


@query("hx09_stored_or_extracted")
def hx09_stored_or_extracted(spark, d):
    p = table(spark, d, "pages").withColumn("t", html.title(COL("html")))
    return p.select("page_id", html.content(F.lit(None).cast("string"), COL("t"), COL("url"), html.paragraphs(COL("html"))).alias("content"))


@query("st15_tags", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def st15_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(strip_tags(COL("html"))).alias("digest"))


@query("pj10_headlines")
def pj10_headlines(spark, d):
    return table(spark, d, "pages").select("page_id", text.headline_from_url(COL("url"), "Example").alias("headline"))


@query("sc04_monthly_sitemaps", "SELECT CAST(m AS DATE) AS month, 'https://x.example.com/sitemap-' || strftime(m, '%Y-%m') || '.xml' AS url FROM generate_series(TIMESTAMP '2023-11-01', TIMESTAMP '2024-03-15', INTERVAL 1 MONTH) s(m)")
def sc04_monthly_sitemaps(spark, d):
    return monthly_sitemaps(spark, "https://x.example.com/sitemap-yyyy-MM.xml", date(2023, 11, 20), date(2024, 3, 15))


@query("dt01_parse_dates", "SELECT * FROM (VALUES (1, '2024-03-05 10:00:00'), (2, '2024-03-05 08:30:00'), (3, '2024-03-05 10:00:00'), (4, '2024-03-05 15:00:00'), (5, '2024-03-05 00:00:00'), (6, NULL), (7, NULL), (8, '2024-03-05 10:00:01')) t(id, ts)")
def dt01_parse_dates(spark, d):
    rows = [(1, "2024-03-05T10:00:00Z"), (2, "2024-03-05T10:00:00+01:30"), (3, "Tue, 5 Mar 2024 10:00:00 GMT"), (4, "Tue, 5 Mar 2024 10:00:00 -0500"), (5, "2024-03-05"), (6, "soon"), (7, ""), (8, " 2024-03-05 10:00:01 ")]
    return spark.createDataFrame(rows, "id int, t string").select("id", F.date_format(dates.parse_timestamp(COL("t")), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("dt02_date_warnings", "SELECT * FROM (VALUES (1, NULL), (2, 'Unparseable date: soon'), (3, 'Missing published date'), (4, 'Missing published date')) t(id, warning)")
def dt02_date_warnings(spark, d):
    rows = spark.createDataFrame([(1, "2024-03-05"), (2, "soon"), (3, " "), (4, None)], "id int, t string")
    return rows.select("id", dates.parse_warning(COL("t")).alias("warning"))


@query("dt04_iso8601", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def dt04_iso8601(spark, d):
    return table(spark, d, "events").select("event_id", dates.iso8601(COL("ts")).alias("iso"))


@query("dt06_ranges_in_words", "SELECT * FROM (VALUES ('august 1 to 7', '2026-08-01', '2026-08-07'), ('aug 28 until sep 3', '2026-08-28', '2026-09-03'), ('last week', '2026-08-02', '2026-08-09'), ('nothing', NULL, NULL), ('this month', '2026-08-01', '2026-08-09'), ('yesterday', '2026-08-08', '2026-08-08')) t(question, first_day, last_day)")
def dt06_ranges_in_words(spark, d):
    from datetime import datetime

    asked = ["yesterday", "this month", "last week", "august 1 to 7", "aug 28 until sep 3", "nothing"]
    rows = [(q, *(str(x) for x in r)) if (r := dates.range_in_words(q, datetime(2026, 8, 9))) else (q, None, None) for q in asked]
    return spark.createDataFrame(rows, "question string, first_day string, last_day string")


@query("st27_spelling", "SELECT * FROM (VALUES ('poltics news', 'politics news', true), ('Govrnment bill', 'Government bill', true), ('the cat', 'the cat', false)) t(question, corrected, changed)")
def st27_spelling(spark, d):
    rows = [(q, *text.correct_spelling(q)) for q in ("poltics news", "Govrnment bill", "the cat")]
    return spark.createDataFrame(rows, "question string, corrected string, changed boolean")


@query("st31_synonyms", "SELECT * FROM (VALUES ('tech', 'technology,tech,ai,semiconductor,digital,cyber,software,startup'), ('weather', 'weather')) t(query, terms)")
def st31_synonyms(spark, d):
    return spark.createDataFrame([(q, ",".join(text.expand_query(q))) for q in ("tech", "weather")], "query string, terms string")
