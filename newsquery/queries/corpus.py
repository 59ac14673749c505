"""Queries over documents as articles: projections, cleaning, rules, quality, search, questions, stories, enrichment."""

from __future__ import annotations

from datetime import datetime

from ..functions import cleaning, rules, text
from ..functions.exprs import clean_label, ellipsize, first_text, literal, percent, rounded, safe_text
from ..operators import aggregates, dedup, enrich, filters, quality, search
from ..plans import questions, reports, stories
from . import query
from .base import COL, DOC, F, document_articles, pct_sql, round_sql, table

W = "WITH " + DOC
TEXT = "coalesce(content, '')"


def re_sql(words) -> str:
    return "(" + "|".join(literal(w) for w in words) + ")"


# --- projections ------------------------------------------------------------------------------


@query("pj01_cards", f"{W} SELECT article_id, CASE WHEN title IS NULL OR title = '' THEN 'Untitled Article' ELSE title END AS title, source, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS summary FROM doc")
def pj01_cards(spark, d):
    a = document_articles(spark, d)
    return a.select("article_id", F.coalesce(first_text(COL("title")), F.lit("Untitled Article")).alias("title"), "source", ellipsize(COL("content"), 200).alias("summary"))


@query("pj02_full_article", f"{W} SELECT article_id, link, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(lang, 'en') AS lang, n_chars, 'General' AS category FROM doc")
def pj02_full_article(spark, d):
    return document_articles(spark, d).select("article_id", "link", F.coalesce(first_text(COL("title")), F.lit("Untitled")).alias("title"), F.coalesce("lang", F.lit("en")).alias("lang"), "n_chars", F.lit("General").alias("category"))


@query("pj03_news_projection", f"{W} SELECT article_id, title, source, lang, link FROM doc")
def pj03_news_projection(spark, d):
    return document_articles(spark, d).select("article_id", "title", "source", "lang", "link")


@query("pj04_string_ids", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents")
def pj04_string_ids(spark, d):
    return table(spark, d, "documents").select(COL("doc_id").cast("string").alias("id"))


@query("pj06_clean_labels", "SELECT lang, source, upper(substring(trim(lang), 1, 1)) || lower(substring(trim(lang), 2)) AS label, count(*) AS n FROM documents GROUP BY 1, 2")
def pj06_clean_labels(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("label", clean_label(COL("lang"), "General"))


@query("pj07_safe_text", f"{W} SELECT article_id, trim(coalesce(title, 'none')) AS title FROM doc")
def pj07_safe_text(spark, d):
    return document_articles(spark, d).select("article_id", safe_text(COL("title"), "none").alias("title"))


@query("pj08_ellipsize", f"{W} SELECT article_id, CASE WHEN length(title) > 40 THEN left(title, 40) || '...' ELSE title END AS t40, CASE WHEN length(content) > 150 THEN left(content, 150) || '...' ELSE content END AS t150 FROM doc")
def pj08_ellipsize(spark, d):
    return document_articles(spark, d).select("article_id", ellipsize(COL("title"), 40).alias("t40"), ellipsize(COL("content"), 150).alias("t150"))


@query("pj09_first_text", f"{W} SELECT article_id, coalesce(CASE WHEN n_chars % 2 = 0 AND trim(title) <> '' THEN title END, source) AS picked FROM doc")
def pj09_first_text(spark, d):
    return document_articles(spark, d).select("article_id", first_text(F.when(COL("n_chars") % 2 == 0, COL("title")), COL("source")).alias("picked"))


@query("pj11_embedding_text", f"{W} SELECT article_id, left(concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, 'Source: ' || source, 'Content: ' || content), 3000) AS text FROM doc")
def pj11_embedding_text(spark, d):
    a = document_articles(spark, d)
    parts = F.concat_ws("\n", F.when(COL("title") != "", F.concat(F.lit("Title: "), COL("title"))), F.concat(F.lit("Source: "), COL("source")), F.concat(F.lit("Content: "), COL("content")))
    return a.select("article_id", F.substring(parts, 1, 3000).alias("text"))


@query("pj12_defaults", f"{W} SELECT article_id, coalesce(lang, 'unknown') AS lang, 'PENDING' AS status, 0 AS tries, length(coalesce(content, '')) AS length FROM doc")
def pj12_defaults(spark, d):
    return document_articles(spark, d).select("article_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.lit("PENDING").alias("status"), F.lit(0).alias("tries"), F.length(F.coalesce("content", F.lit(""))).cast("long").alias("length"))


@query("pj13_stage_times", f"{W} SELECT article_id, {round_sql('(coalesce(n_chars / 1000.0, 0) + coalesce(CASE WHEN doc_id % 3 = 0 THEN 0.125 END, 0))', 3)} AS total_time FROM doc")
def pj13_stage_times(spark, d):
    return document_articles(spark, d).select("article_id", rounded(F.coalesce(COL("n_chars") / 1000.0, F.lit(0.0)) + F.coalesce(F.when(COL("doc_id") % 3 == 0, 0.125), F.lit(0.0)), 3).alias("total_time"))


# --- predicates -------------------------------------------------------------------------------


@query("fl05_mentions", f"{W} SELECT article_id FROM doc WHERE regexp_matches(title, '(?i)\\bthe\\b') OR regexp_matches(link, '(?i)\\bthe\\b')")
def fl05_mentions(spark, d):
    return document_articles(spark, d).filter(filters.mentions("the", COL("title"), COL("link"))).select("article_id")


@query("fl06_no_noise_titles", f"{W} SELECT article_id FROM doc WHERE NOT regexp_matches(lower(title), '^(the and|quote of the day|horoscope|proverb of the day|numerology)')")
def fl06_no_noise_titles(spark, d):
    a = document_articles(spark, d)
    return a.filter(rules.no_noise_title(COL("title")) & ~F.lower("title").startswith("the and")).select("article_id")


@query("fl07_noise_words", f"{W} SELECT article_id, regexp_matches(lower(title), '{re_sql(rules.NOISE_WORDS)}') OR regexp_matches(lower(content), '{re_sql(rules.NOISE_WORDS)}') AS noise FROM doc")
def fl07_noise_words(spark, d):
    return document_articles(spark, d).select("article_id", rules.is_noise(COL("title"), COL("content")).alias("noise"))


@query("fl08_topic_gate", f"{W} SELECT source, count(*) FILTER (regexp_matches(lower(content), '{re_sql(rules.TOPIC_GATES['tech'])}')) AS tech, count(*) FILTER (regexp_matches(lower(content), '(theand|edble)')) AS other FROM doc GROUP BY 1")
def fl08_topic_gate(spark, d):
    return document_articles(spark, d).groupBy("source").agg(F.count_if(rules.topic_gate("AI tech", COL("content"))).alias("tech"), F.count_if(rules.topic_gate("theand edble", COL("content"))).alias("other"))


@query("fl13_not_empty", f"{W} SELECT count(*) FILTER (title IS NOT NULL AND trim(title) <> '') AS with_title, count(*) FILTER (content IS NOT NULL AND trim(content) <> '') AS with_content FROM doc")
def fl13_not_empty(spark, d):
    return document_articles(spark, d).agg(F.count_if(filters.not_empty(COL("title"))).alias("with_title"), F.count_if(filters.not_empty(COL("content"))).alias("with_content"))


@query("fl15_long_enough", f"{W} SELECT article_id FROM doc WHERE length(trim(content)) >= 300 AND len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) >= 60")
def fl15_long_enough(spark, d):
    return document_articles(spark, d).filter(filters.long_enough(COL("content"), 300, 60)).select("article_id")


@query("fl20_paywalled", f"{W} SELECT article_id, length(content) < 300 OR (" + " + ".join(f"CAST(contains(lower(content), '{p}') AS INTEGER)" for p in rules.PAYWALL_TEXTS) + ") >= 3 AS paywalled FROM doc")
def fl20_paywalled(spark, d):
    return document_articles(spark, d).select("article_id", rules.paywalled(COL("content")).alias("paywalled"))


@query("fl23_valid_phrases", f"{W}, w AS (SELECT article_id, unnest(string_split(content, ' ')) AS w FROM doc) SELECT article_id, count(*) AS n FROM w WHERE length(w) >= 2 AND lower(w) NOT IN ({', '.join(repr(x) for x in text.GENERIC_WORDS)}) GROUP BY 1")
def fl23_valid_phrases(spark, d):
    words = document_articles(spark, d).select("article_id", F.explode(F.split("content", " ")).alias("w"))
    return words.filter(text.valid_phrase(COL("w"))).groupBy("article_id").agg(F.count("*").alias("n"))


@query("fl24_valid_entities", f"{W}, w AS (SELECT article_id, unnest(string_split(content, ' ')) AS w FROM doc) SELECT article_id, count(*) AS n FROM w WHERE length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$') AND lower(w) NOT IN ({', '.join(repr(x) for x in text.GENERIC_WORDS)}) GROUP BY 1")
def fl24_valid_entities(spark, d):
    words = document_articles(spark, d).select("article_id", F.explode(F.split("content", " ")).alias("w"))
    return words.filter(text.valid_entity(COL("w"))).groupBy("article_id").agg(F.count("*").alias("n"))


@query("fl28_next_step", f"{W} SELECT article_id, CASE WHEN coalesce(CASE WHEN doc_id % 5 > 0 THEN link END, '') = '' THEN 'SKIP' WHEN trim(coalesce(content, '')) = '' THEN 'EXTRACT_CONTENT' WHEN doc_id % 3 = 0 THEN 'SKIP' ELSE 'RUN_NLP' END AS step FROM doc")
def fl28_next_step(spark, d):
    return document_articles(spark, d).select("article_id", filters.next_step(F.when(COL("doc_id") % 5 > 0, COL("link")), COL("content"), COL("doc_id") % 3 == 0).alias("step"))


# --- text -------------------------------------------------------------------------------------

_LINES = r"list_filter(list_transform(string_split(replace(content, chr(13), ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query("st03_strip_control", f"{W} SELECT article_id, length(regexp_replace(content, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS length FROM doc")
def st03_strip_control(spark, d):
    return document_articles(spark, d).select("article_id", F.length(cleaning.strip_control(COL("content"))).cast("long").alias("length"))


@query("st04_passages", f"{W} SELECT article_id, md5(regexp_replace(content, '(?i)(" + "|".join(p.replace("'", "''") for p in cleaning.PASSAGES) + ")', '', 'g')) AS digest FROM doc")
def st04_passages(spark, d):
    return document_articles(spark, d).select("article_id", F.md5(cleaning.remove_passages(COL("content"))).alias("digest"))


_KEY = r"lower(regexp_replace(x, '\s+', ' ', 'g'))"


@query("st05_boilerplate_lines", f"{W} SELECT article_id, len(list_filter({_LINES}, lambda x: NOT regexp_matches({_KEY}, '" + cleaning._phrase_pattern(cleaning.BOILERPLATE).replace("'", "''") + "'))) AS lines FROM doc")
def st05_boilerplate_lines(spark, d):
    return document_articles(spark, d).select("article_id", F.size(cleaning.remove_boilerplate(cleaning.lines(COL("content")))).cast("long").alias("lines"))


@query("st06_distinct_lines", f"{W} SELECT article_id, len(list_distinct(list_transform({_LINES}, lambda x: {_KEY}))) AS lines FROM doc")
def st06_distinct_lines(spark, d):
    return document_articles(spark, d).select("article_id", F.size(cleaning.distinct_lines(cleaning.lines(COL("content")))).cast("long").alias("lines"))


@query("st07_headings", f"{W} SELECT article_id, len(list_filter({_LINES}, lambda x: {_KEY} NOT IN ({', '.join(repr(h.lower()) for h in cleaning.HEADINGS)}))) AS lines FROM doc")
def st07_headings(spark, d):
    return document_articles(spark, d).select("article_id", F.size(cleaning.remove_headings(cleaning.lines(COL("content")))).cast("long").alias("lines"))


@query("st08_short_lines", f"{W} SELECT article_id, len(list_filter({_LINES}, lambda x: x IN ({', '.join(repr(h) for h in cleaning.SHORT_LINES)}) OR length(x) >= 3)) AS lines FROM doc")
def st08_short_lines(spark, d):
    return document_articles(spark, d).select("article_id", F.size(cleaning.remove_short_lines(cleaning.lines(COL("content")))).cast("long").alias("lines"))


@query("st09_st11_punctuation", f"{W} SELECT article_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, 'https?://\\S+|www\\.\\S+', '', 'g'), '\\(\\s*\\)|\\[\\s*\\]|\\{{\\s*\\}}', '', 'g'), '\\.{{2,}}', '.', 'g'), '!{{2,}}', '!', 'g'), '\\?{{2,}}', '?', 'g')) AS digest FROM doc")
def st09_st11_punctuation(spark, d):
    return document_articles(spark, d).select("article_id", F.md5(cleaning.collapse_punctuation(cleaning.remove_empty_brackets(cleaning.remove_urls(COL("content"))))).alias("digest"))


@query("st12_spaces", f"{W} SELECT article_id, md5(array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS digest FROM doc")
def st12_spaces(spark, d):
    return document_articles(spark, d).select("article_id", F.md5(cleaning.normalize_spaces(COL("content"))).alias("digest"))


@query("st13_clean")
def st13_clean(spark, d):
    return cleaning.clean_articles(document_articles(spark, d), "content").select("article_id", "clean_content")


@query("st14_clean_native")
def st14_clean_native(spark, d):
    return document_articles(spark, d).select("article_id", cleaning.clean(COL("content")).alias("clean_content"))


@query("st16_whitespace", f"{W} SELECT article_id, md5(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS digest FROM doc")
def st16_whitespace(spark, d):
    return document_articles(spark, d).select("article_id", F.md5(cleaning.collapse_whitespace(COL("content"))).alias("digest"))


@query("st17_truncate", f"{W} SELECT article_id, left(content, 100) AS content FROM doc")
def st17_truncate(spark, d):
    return document_articles(spark, d).select("article_id", F.substring("content", 1, 100).alias("content"))


@query("st20_occurrences", f"{W} SELECT article_id, CAST(greatest(len(regexp_extract_all(lower(content), 'the')), 1) AS INTEGER) AS n FROM doc")
def st20_occurrences(spark, d):
    return document_articles(spark, d).select("article_id", F.greatest(text.occurrences(COL("content"), "The"), F.lit(1)).alias("n"))


@query("st21_highlight", f"{W} SELECT article_id, regexp_replace(title, '(?i)\\b(of)\\b', '**\\1**', 'g') AS title FROM doc")
def st21_highlight(spark, d):
    return document_articles(spark, d).select("article_id", text.highlight(COL("title"), "of").alias("title"))


_TITLE = "list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 3 AND w NOT IN (" + ", ".join(repr(x) for x in text.GENERIC_WORDS) + "))"


@query("st22_title_words", f"{W} SELECT article_id, array_to_string({_TITLE}, ' ') AS words FROM doc")
def st22_title_words(spark, d):
    return document_articles(spark, d).select("article_id", F.array_join(text.title_words(COL("title")), " ").alias("words"))


@query("st22_bigrams", f"{W}, t AS (SELECT article_id, {_TITLE} AS w FROM doc) SELECT article_id, CASE WHEN len(w) >= 2 THEN array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), ',') ELSE array_to_string(w, ',') END AS bigrams FROM t")
def st22_bigrams(spark, d):
    return document_articles(spark, d).select("article_id", F.array_join(text.bigrams(text.title_words(COL("title"))), ",").alias("bigrams"))


@query("st23_keywords", f"{W} SELECT article_id, trim(regexp_replace(regexp_replace(regexp_replace(title, '[''’]s', '', 'g'), '-', ' ', 'g'), '\\s+', ' ', 'g')) AS keyword FROM doc")
def st23_keywords(spark, d):
    return document_articles(spark, d).select("article_id", text.normalize_keyword(COL("title")).alias("keyword"))


@query("st24_entities", f"{W} SELECT article_id, trim(regexp_replace(regexp_replace(trim(title), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s&./-]', '', 'g')) AS entity FROM doc")
def st24_entities(spark, d):
    return document_articles(spark, d).select("article_id", text.normalize_entity(COL("title")).alias("entity"))


@query("st25_authors", "SELECT * FROM (VALUES (1, 'Ann,Bob'), (2, 'Unknown'), (3, 'Cy'), (4, 'Unknown')) AS t(id, authors)")
def st25_authors(spark, d):
    rows = spark.createDataFrame([(1, [" Ann ", "Bob", "Ann", "admin"]), (2, ["Staff Reporter", ""]), (3, ["Cy", None]), (4, None)], "id int, a array<string>")
    return rows.select("id", F.array_join(rules.normalize_authors(COL("a")), ",").alias("authors"))


@query("st26_ids", f"{W} SELECT doc_id, sha256(link) AS article_id FROM doc")
def st26_ids(spark, d):
    return document_articles(spark, d).select("doc_id", text.article_id(COL("link")).alias("article_id"))


@query("st28_redaction", f"{W} SELECT article_id, length(regexp_replace(content, '(?i)({'|'.join(text.INJECTIONS)})', '[FILTERED INJECTION CONTENT]', 'g')) AS length FROM doc")
def st28_redaction(spark, d):
    return document_articles(spark, d).select("article_id", F.length(text.redact_injections(COL("content"))).cast("long").alias("length"))


@query("st29_word_chunks")
def st29_word_chunks(spark, d):
    return document_articles(spark, d).select("article_id", F.posexplode(text.chunk_words(COL("content"), F.lit(450))).alias("chunk", "text"))


@query("st30_paragraph_chunks")
def st30_paragraph_chunks(spark, d):
    return document_articles(spark, d).select("article_id", F.posexplode(text.chunk_paragraphs(COL("content"), F.lit(900))).alias("chunk", "text"))


# --- rules and enrichment ---------------------------------------------------------------------


@query("en04_sentiment_rules", f"{W} SELECT article_id, CASE WHEN regexp_matches(lower(title), '{re_sql(rules.POSITIVE_WORDS)}') THEN 'Positive' WHEN regexp_matches(lower(title), '{re_sql(rules.NEGATIVE_WORDS)}') THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM doc")
def en04_sentiment_rules(spark, d):
    return document_articles(spark, d).select("article_id", rules.infer_sentiment(COL("title")).alias("sentiment"))


@query("en08_category_rules", f"{W} SELECT article_id, CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{re_sql(w)}') THEN '{c}'" for c, w in rules.CATEGORY_WORDS.items()) + " ELSE 'General' END AS category FROM doc")
def en08_category_rules(spark, d):
    return document_articles(spark, d).select("article_id", rules.infer_category(COL("title")).alias("category"))


@query("en05_chunk_mean", f"{W}, s AS (SELECT article_id, unnest(range(3)) AS chunk, n_chars FROM doc), m AS (SELECT article_id, 'label' || CAST((n_chars + chunk) % 2 AS VARCHAR) AS label, {round_sql('avg((n_chars + chunk) % 7 / 7.0)', 4)} AS score FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, label) AS rn FROM m) SELECT article_id, label, score FROM r WHERE rn = 1")
def en05_chunk_mean(spark, d):
    s = document_articles(spark, d).select("article_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk"))
    x = COL("n_chars") + COL("chunk")
    return aggregates.mean_scores(s.select("article_id", F.concat(F.lit("label"), (x % 2).cast("string")).alias("label"), ((x % 7) / 7.0).alias("score")), "article_id", "label", "score")


@query("en06_best_label", f"{W}, s AS (SELECT article_id, (n_chars % 10) / 10.0 AS a, (n_chars % 7) / 7.0 AS b FROM doc) SELECT article_id, CASE WHEN greatest(a, b) < 0.4 THEN 'Unknown' WHEN a >= b THEN 'Business' ELSE 'World' END AS label, {round_sql('greatest(a, b)', 4)} AS score FROM s")
def en06_best_label(spark, d):
    scores = F.create_map(F.lit("business"), (COL("n_chars") % 10) / 10.0, F.lit("world"), (COL("n_chars") % 7) / 7.0)
    best = enrich.best_label(scores, 0.4, mapping={"business": "Business", "world": "World"})
    return document_articles(spark, d).select("article_id", best.alias("b")).select("article_id", "b.label", "b.score")


@query("en11_keyword_merge", f"{W}, k AS (SELECT source AS item, unnest(string_split(title, ' ')) AS w, (n_chars % 100) / 100.0 AS score FROM doc), m AS (SELECT item, lower(w) AS text, max(score) AS score FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, text) AS rn FROM m) SELECT item, text, score FROM r WHERE rn <= 20")
def en11_keyword_merge(spark, d):
    rows = document_articles(spark, d).select(COL("source").alias("item"), F.explode(F.split("title", " ")).alias("text"), ((COL("n_chars") % 100) / 100.0).alias("score"))
    return dedup.keywords(rows, "item", "text", "score")


@query("en12_entity_dedup", f"{W}, k AS (SELECT source AS item, unnest(string_split(title, ' ')) AS entity, upper(lang) AS label, (n_chars % 100) / 100.0 AS confidence FROM doc), r AS (SELECT *, row_number() OVER (PARTITION BY item, lower(entity), lower(label) ORDER BY confidence DESC, entity DESC, label DESC) AS rn FROM k) SELECT item, entity, label, confidence FROM r WHERE rn = 1")
def en12_entity_dedup(spark, d):
    rows = document_articles(spark, d).select(COL("source").alias("item"), F.explode(F.split("title", " ")).alias("entity"), F.upper("lang").alias("label"), ((COL("n_chars") % 100) / 100.0).alias("confidence"))
    return dedup.entities(rows, "item", "entity", "label", "confidence")


@query("en01_summaries")
def en01_summaries(spark, d):
    return document_articles(spark, d).select("article_id", enrich.summarise(COL("content")).alias("summary"))


@query("en09_keywords")
def en09_keywords(spark, d):
    return document_articles(spark, d).select("article_id", enrich.extract_keywords(COL("content")).alias("keywords"))


@query("en13_named_entities")
def en13_named_entities(spark, d):
    return enrich.named_entities(document_articles(spark, d), "article_id", "content")


@query("en14_vectors")
def en14_vectors(spark, d):
    return document_articles(spark, d).select("article_id", enrich.hashed_vector(COL("content"), F.lit(64)).alias("embedding"))


@query("en17_stages")
def en17_stages(spark, d):
    return enrich.run_stages(document_articles(spark, d).select("article_id", "content"), "content").drop("content")


# --- quality and duplicates -------------------------------------------------------------------

_DQ = "(100.0 - CASE WHEN t = '' THEN 40.0 ELSE 0 END - CASE WHEN t <> '' AND length(t) < 8 THEN 15.0 ELSE 0 END - CASE WHEN s AND c = '' THEN 35.0 ELSE 0 END - CASE WHEN s AND c <> '' AND length(c) < 150 THEN 15.0 ELSE 0 END - CASE WHEN src IS NULL THEN 20.0 ELSE 0 END)"


@query("dq01_quality", f"{W}, q AS (SELECT article_id, coalesce(title, '') AS t, trim(coalesce(content, '')) AS c, doc_id % 2 = 0 AS s, CASE WHEN doc_id % 7 > 0 THEN source END AS src FROM doc) SELECT article_id, CAST({_DQ} AS DOUBLE) AS quality_score, CASE WHEN t = '' OR (s AND c = '') OR src IS NULL OR {_DQ} < 50 THEN 'QUARANTINED' ELSE 'PASSED' END AS quality_status FROM q")
def dq01_quality(spark, d):
    now = datetime(2024, 2, 1)
    a = document_articles(spark, d).withColumns({"published": F.lit(now), "stage": F.when(COL("doc_id") % 2 == 0, "extracted"), "src": F.when(COL("doc_id") % 7 > 0, COL("source"))})
    names = {"article_id": "article_id", "link": "link", "source": "src", "title": "title", "published": "published", "content": "content", "stage": "stage"}
    return quality.quality(a, F.lit(now), names).select("article_id", "quality_score", "quality_status")


@query("sk06_quarantine", f"{W}, q AS (SELECT coalesce(title, '') AS t, doc_id % 7 = 0 AS nosrc FROM doc) SELECT count(*) FILTER (t = '' OR nosrc) AS quarantined, count(*) FILTER (NOT (t = '' OR nosrc)) AS passed FROM q")
def sk06_quarantine(spark, d):
    now = datetime(2024, 2, 1)
    a = document_articles(spark, d).withColumns({"published": F.lit(now), "src": F.when(COL("doc_id") % 7 > 0, COL("source"))})
    scored = quality.quality(a, F.lit(now), {"article_id": "article_id", "link": "link", "source": "src", "title": "title", "published": "published"})
    return scored.agg(F.count_if(COL("quality_status") == "QUARANTINED").alias("quarantined"), F.count_if(COL("quality_status") == "PASSED").alias("passed"))


@query("dq02_keep_first", f"{W}, r AS (SELECT title, article_id, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS rn FROM doc) SELECT title, article_id FROM r WHERE rn = 1")
def dq02_keep_first(spark, d):
    return dedup.first_by(document_articles(spark, d).select("title", "article_id", "doc_id"), "title", [COL("doc_id")]).select("title", "article_id")


@query("dq03_keep_last", f"{W}, r AS (SELECT title, article_id, row_number() OVER (PARTITION BY title ORDER BY doc_id DESC) AS rn FROM doc) SELECT title, article_id FROM r WHERE rn = 1")
def dq03_keep_last(spark, d):
    return dedup.first_by(document_articles(spark, d).select("title", "article_id", "doc_id"), "title", [F.desc("doc_id")]).select("title", "article_id")


@query("dq04_title_level", f"{W} SELECT count(DISTINCT lower(trim(title))) AS titles, count(*) AS articles FROM doc")
def dq04_title_level(spark, d):
    return document_articles(spark, d).agg(F.count_distinct(F.lower(F.trim("title"))).alias("titles"), F.count("*").alias("articles"))


@query("dq07_exact_copies", "SELECT sha256(text) AS digest, count(*) AS count, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dq07_exact_copies(spark, d):
    return dedup.exact_copies(table(spark, d, "documents"), "doc_id", "text")


@query("ag07_coverage", f"{W}, c AS (SELECT count(*) AS t, count(*) FILTER (title <> '') AS a, count(*) FILTER (length(content) > 500) AS b, count(*) FILTER (lang = 'en') AS e FROM doc) SELECT 'title' AS field, a AS filled, {pct_sql('a', 't')} AS pct FROM c UNION ALL SELECT 'long', b, {pct_sql('b', 't')} FROM c UNION ALL SELECT 'english', e, {pct_sql('e', 't')} FROM c")
def ag07_coverage(spark, d):
    return aggregates.coverage(document_articles(spark, d), {"title": COL("title") != "", "long": F.length("content") > 500, "english": COL("lang") == "en"})


@query("ag17_missing_audit", f"{W} SELECT count(*) FILTER (title IS NULL OR trim(title) = '') AS title_missing, count(*) FILTER (content IS NULL OR trim(content) = '') AS content_missing, count(*) FILTER (lang IS NULL OR trim(lang) = '') AS lang_missing FROM doc")
def ag17_missing_audit(spark, d):
    return aggregates.missing_audit(document_articles(spark, d), ["title", "content", "lang"])


@query("sk09_index_documents", f"{W} SELECT article_id, title, content AS clean_content, source, lang FROM doc")
def sk09_index_documents(spark, d):
    return document_articles(spark, d).select("article_id", "title", COL("content").alias("clean_content"), "source", "lang")


@query("sc09_projection_scan", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def sc09_projection_scan(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("sc10_pending_batch", f"{W} SELECT article_id FROM doc WHERE NOT coalesce(CASE WHEN doc_id % 4 > 0 THEN doc_id % 2 = 0 END, false) ORDER BY article_id LIMIT 50")
def sc10_pending_batch(spark, d):
    from ..sources.feeds import pending

    a = document_articles(spark, d).withColumn("done", F.when(COL("doc_id") % 4 > 0, COL("doc_id") % 2 == 0))
    return pending(a, "done", "article_id", 50).select("article_id")


@query("jn10_index_gap", "SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def jn10_index_gap(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("missing"))


# --- search -----------------------------------------------------------------------------------


def _bm25_sql(fields: dict[str, tuple[str, float]], terms: list[str], limit: int) -> str:
    toks = ", ".join(f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS t_{f}" for f, (c, _) in fields.items())
    tf = ", ".join(f"len(t_{f}) AS len_{f}, " + ", ".join(f"len(list_filter(t_{f}, lambda w: w = '{t}')) AS tf_{f}_{i}" for i, t in enumerate(terms)) for f in fields)
    st = ", ".join(f"avg(len_{f}) AS avg_{f}, " + ", ".join(f"count(*) FILTER (tf_{f}_{i} > 0) AS df_{f}_{i}" for i in range(len(terms))) for f in fields)
    one = lambda f, i: f"CASE WHEN tf_{f}_{i} > 0 THEN ln(1.0 + (n - df_{f}_{i} + 0.5) / (df_{f}_{i} + 0.5)) * tf_{f}_{i} * 2.2 / (tf_{f}_{i} + 1.2 * (0.25 + 0.75 * len_{f} / greatest(avg_{f}, 1e-9))) ELSE 0.0 END"
    each = [f"({' + '.join(one(f, i) for i in range(len(terms)))}) * {b}" for f, (_, b) in fields.items()]
    best = each[0] if len(each) == 1 else f"greatest({', '.join(each)})"
    hit = " OR ".join(f"tf_{f}_{i} > 0" for f in fields for i in range(len(terms)))
    return f"{W}, tok AS (SELECT article_id, {toks} FROM doc), r AS (SELECT article_id, {tf} FROM tok), s AS (SELECT count(*) AS n, {st} FROM r) SELECT article_id, {round_sql('(' + best + ')', 4)} AS score FROM r, s WHERE {hit} ORDER BY score DESC, article_id LIMIT {limit}"


@query("se01_bm25", _bm25_sql({"title": ("title", 3.0), "clean_content": ("content", 1.0)}, ["edble", "theand"], 10))
def se01_bm25(spark, d):
    return search.bm25(document_articles(spark, d), "article_id", {"title": COL("title"), "clean_content": COL("content")}, "theand, EDBLE!", 10)


@query("se06_text_score", _bm25_sql({"clean_content": ("content", 1.0)}, ["eaer", "retion", "thnt"], 20))
def se06_text_score(spark, d):
    return search.bm25(document_articles(spark, d), "article_id", {"clean_content": COL("content")}, "thnt retion eaer", 20)


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_COS = f"({_DOT.format(a='e.embedding', b='q.v')} / sqrt({_DOT.format(a='e.embedding', b='e.embedding')} * {_DOT.format(a='q.v', b='q.v')}))"
_KNN = f"knn AS (SELECT CAST(vec_id AS VARCHAR) AS article_id, {round_sql(_COS, 6)} AS score FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, article_id LIMIT 10)"


def _query_vector(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


def _knn(spark, d):
    e = table(spark, d, "embeddings").withColumn("article_id", COL("vec_id").cast("string"))
    return search.knn(e, "article_id", "embedding", _query_vector(spark, d), 10)


@query("se02_knn", f"WITH {_KNN} SELECT * FROM knn")
def se02_knn(spark, d):
    return _knn(spark, d)


_T = _bm25_sql({"title": ("title", 3.0), "clean_content": ("content", 1.0)}, ["edble", "theand"], 10)


@query("se03_hybrid", f"WITH {_KNN}, tx AS ({_T}) SELECT coalesce(k.article_id, t.article_id) AS article_id, {round_sql('(coalesce(t.score, 0.0) + coalesce(k.score, 0.0))', 6)} AS score FROM tx t FULL JOIN knn k ON t.article_id = k.article_id ORDER BY score DESC, 1 LIMIT 10")
def se03_hybrid(spark, d):
    return search.hybrid(se01_bm25(spark, d), _knn(spark, d), "article_id", 10)


@query("se03_hybrid_rrf", f"WITH {_KNN}, tx AS ({_T}), t AS (SELECT article_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, article_id)) AS s FROM tx), k AS (SELECT article_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, article_id)) AS s FROM knn) SELECT coalesce(k.article_id, t.article_id) AS article_id, {round_sql('CAST(coalesce(t.s, 0.0) + coalesce(k.s, 0.0) AS DOUBLE)', 6)} AS score FROM t FULL JOIN k ON t.article_id = k.article_id ORDER BY score DESC, 1 LIMIT 10")
def se03_hybrid_rrf(spark, d):
    return search.hybrid(se01_bm25(spark, d), _knn(spark, d), "article_id", 10, rrf=60)


@query("se04_filtered_search", f"{_bm25_sql({'clean_content': ('content', 1.0)}, ['thnt'], 10).replace('FROM documents)', chr(32) + 'FROM documents WHERE lang = ' + repr('en') + ' AND source = ' + repr('src3') + ')')}")
def se04_filtered_search(spark, d):
    rows = document_articles(spark, d).filter(filters.same_text(COL("lang"), "EN") & filters.same_text(COL("source"), "src3"))
    return search.bm25(rows, "article_id", {"clean_content": COL("content")}, "thnt", 10)


@query("se05_priority_search", f"{W}, p AS (SELECT article_id, doc_id, CASE WHEN regexp_matches(title, '(?i)\\bthe\\b') THEN 1 WHEN regexp_matches(content, '(?i)\\bthe\\b') THEN 2 END AS priority FROM doc) SELECT article_id, priority FROM p WHERE priority IS NOT NULL ORDER BY priority, doc_id DESC, article_id LIMIT 15")
def se05_priority_search(spark, d):
    return search.priority_search(document_articles(spark, d), "article_id", "the", COL("title"), COL("content"), F.desc("doc_id")).select("article_id", "priority")


@query("se07_weighted_search", f"{W}, s AS (SELECT article_id, " + " + ".join(f"CASE WHEN regexp_matches(title, '(?i){p}') THEN 5.0 ELSE 0.0 END + CASE WHEN regexp_matches(content, '(?i){p}') THEN 1.0 ELSE 0.0 END" for p in ("\\bof\\b", "thereand")) + " AS s FROM doc) SELECT article_id, CAST(s AS DOUBLE) AS score FROM s WHERE s > 0 ORDER BY s DESC, article_id LIMIT 15")
def se07_weighted_search(spark, d):
    return search.weighted_search(document_articles(spark, d), "article_id", ["of", "thereand"], {"title": (COL("title"), 5.0), "content": (COL("content"), 1.0)})


@query("se09_top_news", f"{W} SELECT article_id, {round_sql('(70.0 * 0.4 + least(length(content) / 500.0, 1.0) * 30.0)', 2)} AS score FROM doc WHERE lower(source) = 'src2' AND lower(lang) = 'en' ORDER BY score DESC, article_id LIMIT 10")
def se09_top_news(spark, d):
    return search.top_news(document_articles(spark, d).withColumn("category", COL("lang")), F.lit(None).cast("double"), COL("content"), 10, category="EN", source="src2")


@query("jn11_postings", f"{W}, w AS (SELECT article_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS term FROM doc) SELECT article_id, term, count(*) AS tf FROM w GROUP BY 1, 2")
def jn11_postings(spark, d):
    return search.postings(document_articles(spark, d), "article_id", {"title": COL("title")}).select("article_id", "term", "tf")


@query("jn12_knn_pairs", f"SELECT q.vec_id AS query_id, count(*) AS near FROM (SELECT vec_id, embedding AS v, label FROM embeddings WHERE vec_id % 100 = 0) q JOIN embeddings e ON {_COS.replace('q.v', 'q.v')} > 0.2 GROUP BY 1")
def jn12_knn_pairs(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(COL("vec_id").alias("query_id"), COL("embedding").alias("v"))
    return search.near_pairs(e, COL("embedding"), q, "query_id", COL("v"), 0.2).groupBy("query_id").agg(F.count("*").alias("near"))


# --- questions --------------------------------------------------------------------------------


def _intent_sql(x: str) -> str:
    when = " ".join(f"WHEN regexp_matches({x}, '{re_sql(t)}') THEN '{'TREND_ANALYSIS' if n == 'SPIKE_ANALYSIS' else n}'" for n, t in questions.INTENTS)
    return f"CASE {when} WHEN regexp_matches({x}, '{re_sql(questions.RECENT)}') THEN 'ARTICLE_SEARCH' ELSE 'GENERAL_NEWS_QUERY' END"


@query("se10_intents", f"SELECT conv_id, turn, {_intent_sql('lower(trim(text))')} AS intent FROM conversations WHERE role = 'user'")
def se10_intents(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", questions.intent_of(COL("text")).alias("intent"))


@query("se11_dispatch")
def se11_dispatch(spark, d):
    asked = ["top 10 news today", "compare coverage", "what happened yesterday", "any unusual spike", "latest on trade", "august 1 to 7 events", "poltics mood"]
    found = [questions.understand(q, datetime(2026, 8, 9)) for q in asked]
    return spark.createDataFrame([(q.text, q.corrected, q.intent, q.category, q.window, str(q.days[0]) if q.days else None, ",".join(q.tools)) for q in found], "question string, corrected string, intent string, category string, window string, first_day string, tools string")


@query("se13_citations", f"WITH tx AS ({_T}), {DOC} SELECT CAST(row_number() OVER (ORDER BY tx.score DESC, tx.article_id) AS INTEGER) AS number, tx.article_id, left(content, 500) AS snippet FROM tx JOIN doc USING (article_id) ORDER BY tx.score DESC, tx.article_id LIMIT 8")
def se13_citations(spark, d):
    a = document_articles(spark, d).withColumn("summary", F.lit(""))
    hits = a.join(se01_bm25(spark, d), "article_id")
    return questions.citations(hits.unionByName(hits), "article_id", [F.desc("score"), COL("article_id")]).select("number", "article_id", "snippet")


def _asked(spark, d, text):
    a = document_articles(spark, d).withColumns({"summary": F.substring("content", 1, 120), "category": F.lit("General"), "sentiment": F.lit("Neutral"), "event_ts": F.lit(datetime(2024, 1, 1))})
    return questions.ask(a, text, datetime(2024, 2, 1))


@query("se12_answer")
def se12_answer(spark, d):
    return _asked(spark, d, "show theand edble")


@query("se14_no_evidence")
def se14_no_evidence(spark, d):
    return _asked(spark, d, "what is quantum xylophone politics")


@query("se15_extractive")
def se15_extractive(spark, d):
    return _asked(spark, d, "summary of retion thnt")


# --- stories and reports ----------------------------------------------------------------------


def _story_articles(spark, d):
    # the documents carry no time: one a minute, in the order of their ids
    return document_articles(spark, d).withColumn("event_ts", F.timestamp_seconds(F.lit(1704067200) + COL("doc_id") * 60))


@query("rp04_developing_stories")
def rp04_developing_stories(spark, d):
    return stories.developing(_story_articles(spark, d))


@query("rp05_event_profile")
def rp05_event_profile(spark, d):
    return stories.developing(_story_articles(spark, d)).orderBy(F.desc("confidence"), F.desc("updates"), "story").limit(1)


@query(
    "rp03_publisher_comparison",
    f"{W}, r AS (SELECT source, title, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id, article_id) AS rn FROM doc WHERE NOT regexp_matches(lower(title), '{re_sql(rules.NOISE_WORDS)}') AND regexp_matches(lower(title), '(the|and)')) SELECT source, count(*) AS count, string_agg(title, ' | ' ORDER BY rn) FILTER (rn <= 3) AS samples FROM r GROUP BY 1",
)
def rp03_publisher_comparison(spark, d):
    return reports.compare_sources(_story_articles(spark, d), "the and").drop("earliest")


@query(
    "rp09_topic_report",
    f"{W}, r AS (SELECT lower(trim(title)) AS t, arg_min(source, (doc_id, article_id)) AS source, arg_min(lang, (doc_id, article_id)) AS lang FROM doc WHERE (regexp_matches(title, '(?i)\\bof\\b') OR regexp_matches(content, '(?i)\\bof\\b')) GROUP BY 1) SELECT count(*) AS articles, count(DISTINCT source) AS n_sources, CAST(0 AS DOUBLE) AS positive_pct, {pct_sql('count(*)', 'count(*)')} AS neutral_pct, CAST(0 AS DOUBLE) AS negative_pct FROM r",
)
def rp09_topic_report(spark, d):
    return reports.topic_report(_story_articles(spark, d).withColumn("sentiment", F.lit("Neutral")), "of", "title", "content")


@query(
    "rp13_telemetry",
    f"{W} SELECT source, count(*) AS articles, {pct_sql('count(*) FILTER (length(content) > 1000)', 'count(*)')} AS long_pct, max(doc_id) AS newest FROM doc GROUP BY 1",
)
def rp13_telemetry(spark, d):
    return document_articles(spark, d).groupBy("source").agg(F.count("*").alias("articles"), percent(F.count_if(F.length("content") > 1000), F.count("*")).alias("long_pct"), F.max("doc_id").alias("newest"))
