import json
import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsquery.articles import ARTICLE, event_articles, normalize_articles
from newsquery.operators import aggregates, filters, html, joins, quality, search, temporal
from newsquery.plans import stories
from newsquery.sources import feeds, sinks
from newsquery.streaming import pipeline as st

SMALL = "/root/testdata/sf0.001"
NOW = datetime(2024, 2, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normaliser_reads_all_shapes(spark):
    docs = [
        {"link": "https://a/1", "source": "Pub", "category": "Sports", "sentiment": "Positive", "summary": "s", "keywords": ["a", "b"], "entities": ["X"], "embedding": [1, 2], "published_date": "2024-01-05T10:00:00Z"},
        {"article_id": "x", "link": "https://a/2", "source": {"name": "P2", "country": "IN"}, "category": {"label": "World", "score": 0.5}, "sentiment": {"label": "Negative"}, "summary": {"text": "t"}, "keywords": [{"keyword": "k", "score": 1.0}, {"term": "t"}], "entities": [{"text": "E", "type": "Org"}], "embedding": {"vector": [3, 4]}, "published_date": "", "created_at": "Fri, 5 Jan 2024 10:00:00 GMT"},
        {"link": "https://a/3", "category": {"category": "Crime"}, "source": {}, "keywords": None, "embedding": [1, 2, 3], "published_date": "garbage"},
    ]
    raw = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{broken",)], "json string")
    rows = {r["link"]: r for r in normalize_articles(raw, dimension=2).collect()}
    a, b, c, bad = rows["https://a/1"], rows["https://a/2"], rows["https://a/3"], rows[None]
    assert (a.source.name, a.category.label, a.sentiment.label, a.summary, [k.text for k in a.keywords], a.entities[0].entity, a.embedding) == ("Pub", "Sports", "Positive", "s", ["a", "b"], "X", [1.0, 2.0])
    assert len(a.article_id) == 64 and a.event_ts == datetime(2024, 1, 5, 10) and a.event_ts_field == "published"
    assert (b.article_id, b.source.name, b.source.country, b.category.label, b.category.score, b.sentiment.label, b.summary) == ("x", "P2", "IN", "World", 0.5, "Negative", "t")
    assert [k.text for k in b.keywords] == ["k", "t"] and (b.entities[0].entity, b.entities[0].label) == ("E", "Org") and b.embedding == [3.0, 4.0]
    assert b.event_ts == datetime(2024, 1, 5, 10) and b.event_ts_field == "created"
    assert (c.source.name, c.category.label, c.sentiment.label, c.keywords, c.embedding, c.event_ts) == ("Unknown Source", "Crime", "Neutral", [], None, None)
    assert bad["_corrupt_record"] == "{broken" and bad["link"] is None
    assert normalize_articles(raw).columns == [f.name for f in ARTICLE] + ["_corrupt_record"]


def test_quality_gate(spark):
    rows = [("1", "https://a.com/x/1", "Pub", "A title of some length", NOW, "x" * 200, "enriched"), ("", "nope", None, "", None, "", "enriched"), ("3", "https://a.com/x/3", "Pub", "short", NOW + timedelta(days=9), "c", "raw")]
    df = spark.createDataFrame(rows, "article_id string, link string, source string, title string, published timestamp, content string, stage string")
    got = {r["article_id"]: r for r in quality.quality(df, F.lit(NOW), {c: c for c in df.columns}).collect()}
    assert (got["1"]["quality_score"], got["1"]["quality_status"], got["1"]["errors"], got["1"]["warnings"]) == (100.0, "PASSED", [], [])
    assert got[""]["quality_score"] == 0.0 and got[""]["quality_status"] == "QUARANTINED" and len(got[""]["errors"]) == 5
    assert got["3"]["quality_score"] == 65.0 and got["3"]["quality_status"] == "PASSED" and len(got["3"]["warnings"]) == 2


def test_feeds_and_sinks(spark, tmp_path):
    (tmp_path / "pub.xml").write_text("<rss><channel>" + "".join(f"<item><title>T{i} &amp; more</title><link>https://a.com/n/{i % 3}</link><description>d</description><pubDate>Fri, 05 Jan 2024 10:0{i}:00 GMT</pubDate></item>" for i in range(5)) + "</channel></rss>")
    found = feeds.rss(spark, f"file://{tmp_path}/pub.xml")
    assert {(r["link"], r["source"]) for r in found.collect()} == {(f"https://a.com/n/{i}", "pub") for i in range(3)}
    (tmp_path / "map.xml").write_text("<urlset>" + "".join(f"<url><loc>https://a.com/{s}/1</loc><lastmod>2024-01-0{k + 1}</lastmod></url>" for k, s in enumerate(["news", "video", "city"])) + "</urlset>")
    urls = feeds.sitemap(spark, f"file://{tmp_path}/map.xml", "Pub").collect()
    assert {(r["link"], r["event_ts"].day) for r in urls} == {("https://a.com/news/1", 1), ("https://a.com/city/1", 3)}
    (tmp_path / "index.xml").write_text("<sitemapindex><sitemap><loc>https://a.com/s1.xml</loc></sitemap></sitemapindex>")
    assert [r["loc"] for r in feeds.sitemap_index(spark, f"file://{tmp_path}/index.xml").collect()] == ["https://a.com/s1.xml"]
    (tmp_path / "news.json").write_text(json.dumps([{"link": "https://a/1", "title": "x"}, {"link": "https://a/2"}]))
    assert feeds.json_articles(spark, f"file://{tmp_path}/news.json", multiline=True).count() == 2

    path = f"file://{tmp_path}/articles"
    assert sinks.insert_new(found, path).count() == 3
    assert sinks.insert_new(found, path).count() == 3  # a second cycle finds nothing new
    more = found.limit(1).withColumn("link", F.lit("https://a.com/n/9")).withColumn("article_id", F.lit("new"))
    assert sinks.insert_new(more, path).count() == 4
    out = sinks.upsert(more.withColumn("title", F.lit("changed")), path, "article_id", f"file://{tmp_path}/v2")
    assert out.filter("article_id = 'new'").first()["title"] == "changed" and out.count() == 4
    assert set(sinks.queue_rows(found).columns) == {"key", "value"}
    fields = {"title": F.col("title")}
    sinks.write_index(found, f"file://{tmp_path}/index", "article_id", fields)
    sinks.write_index(found, f"file://{tmp_path}/index", "article_id", fields)
    index, stats = spark.read.parquet(f"file://{tmp_path}/index/postings"), spark.read.parquet(f"file://{tmp_path}/index/statistics")
    by_index = search.search_index(index, stats, "article_id", "t1 more").collect()
    assert by_index == search.bm25(found, "article_id", fields, "t1 more").collect() and by_index[0]["score"] > by_index[1]["score"]


def test_merge_and_anti_joins(spark):
    t = spark.createDataFrame([(1, "a", "DONE"), (2, "b", "DONE")], "id int, v string, status string")
    s = spark.createDataFrame([(2, "B", "PENDING"), (3, "c", "PENDING")], "id int, v string, status string")
    # a replay must not reset what is done
    got = {r["id"]: (r["v"], r["status"]) for r in joins.merge(t, s, "id", {"v": F.col("s.v")}).collect()}
    assert got == {1: ("a", "DONE"), 2: ("B", "DONE"), 3: ("c", "PENDING")}
    assert [r["id"] for r in joins.new_only(s, t, "id").collect()] == [3]


def test_as_of_and_range_joins_against_brute_force(spark):
    rng = random.Random(2)
    left = [(i, rng.randrange(4), rng.randrange(100)) for i in range(60)]
    right = [(k, t, float(v)) for v, (k, t) in enumerate(sorted({(rng.randrange(4), rng.randrange(100)) for _ in range(50)}))]
    a, b = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v double")
    got = {r["id"]: r["asof_v"] for r in joins.as_of_join(a, b, "k", "t", "v").collect()}
    assert got == {i: max(((t2, v) for k2, t2, v in right if k2 == k and t2 <= t), default=(0, None))[1] for i, k, t in left}
    ranges = [(i, float(lo), float(lo + rng.randrange(30))) for i, lo in enumerate(rng.sample(range(90), 20))]
    r = spark.createDataFrame(ranges, "r int, lo double, hi double")
    joined = joins.range_join(a.withColumn("t", F.col("t").cast("double")), r, "t", "lo", "hi", 7.0).select("id", "r").collect()
    assert sorted((x["id"], x["r"]) for x in joined) == sorted((i, k) for i, _, t in left for k, lo, hi in ranges if lo <= t <= hi)


def test_plans(spark):
    a = event_articles(spark, SMALL)
    now = a.agg(F.max("event_ts")).first()[0]
    volume = plan(temporal.volume_buckets(a, now, "24h"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in volume and "ReadSchema: struct<ts:timestamp_ntz>" in volume
    assert plan(aggregates.counts_by(a, "source", "category", "sentiment")).count("Exchange") == 1
    frames = [temporal.volume_summary(a, now, "7d"), temporal.dimension_spikes(a, "source", now, "24h"), temporal.emerging(a, "keyword", now, "7d", 3), temporal.cross_source_topics(a, now, "7d"), joins.co_occurring(a, "keyword", "category")]
    assert not any("Python" in plan(f) or "Cartesian" in plan(f) for f in frames)
    top = plan(search.knn(spark.read.parquet(f"{SMALL}/embeddings.parquet"), "vec_id", "embedding", [0.1] * 64, 5, 64))
    assert "TakeOrderedAndProject" in top


def test_knn_and_bm25_against_plain_python(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(50)]
    df = spark.createDataFrame(vectors, "id int, v array<double>")
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    want = sorted(vectors, key=lambda r: -cos(r[1], vectors[3][1]))[:5]
    assert [r["id"] for r in search.knn(df, "id", "v", vectors[3][1], 5).collect()] == [i for i, _ in want] and want[0][0] == 3
    try:
        search.knn(df, "id", "v", [1.0], 5, dimension=8)
        raise AssertionError
    except ValueError:
        pass
    texts = {i: " ".join(rng.choice("red green blue grey".split()) for _ in range(rng.randrange(1, 12))) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "id int, t string")
    n, mean = len(texts), sum(len(t.split()) for t in texts.values()) / len(texts)

    def score(t):
        total = 0.0
        for term in ("blue", "red"):
            tf, df_ = t.split().count(term), sum(term in x.split() for x in texts.values())
            total += math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t.split()) / mean)) if tf else 0
        return math.floor(total * 1e4 + 0.5) / 1e4

    ranked = sorted(((-score(t), i) for i, t in texts.items() if score(t) > 0))[:10]
    assert [(r["id"], r["score"]) for r in search.bm25(docs, "id", {"t": F.col("t")}, "Red, blue?").collect()] == [(i, -s) for s, i in ranked]


def test_relaxation_and_claims(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x")], "id int, s string, c string")
    level = lambda *conds: sorted((r["id"], r["relaxation"]) for r in filters.relaxed(df, *conds).collect())
    s, c, none, every = F.col("s") == "a", F.col("c") == "x", F.col("s") == "zz", F.lit(True)
    assert level(s & c, s, every) == [(1, 0)]
    assert level(none, s, every) == [(1, 1), (2, 1)]
    assert level(none, none, every) == [(1, 2), (2, 2), (3, 2)]
    q = spark.createDataFrame([("PENDING", None, None, None), ("FAILED", True, 2, None), ("FAILED", True, 3, None), ("PROCESSING", None, 0, NOW - timedelta(seconds=301)), ("PROCESSING", None, 0, NOW), ("COMPLETED", None, 0, None)], "s string, r boolean, t int, c timestamp")
    ok = filters.claimable(F.col("s"), F.col("r"), F.col("t"), F.col("c"), F.lit(NOW))
    assert [bool(r["ok"]) for r in q.select(ok.alias("ok")).collect()] == [True, True, False, True, False, False]


def test_html(spark):
    page = "<html><head><title>T &amp; more</title><meta content='Og title' property='og:title'><meta name='author' content='Ann'></head><body><p>outside</p><article><h1>H</h1><p class=a>One <b>two</b></p><script>x='<p>no</p>'</script><p>Three</article></body></html>"
    df = spark.createDataFrame([(page,), (None,)], "html string")
    h = F.col("html")
    row = df.select(html.title(h).alias("t"), html.author(h).alias("a"), html.paragraphs(h).alias("p")).first()
    assert (row["t"], row["a"], row["p"]) == ("Og title", "Ann", "One two\nThree")
    got = html.select_texts(df, "html", {"body": [".missing", "p.a", "p"], "head": ["h1"]}).collect()
    assert (got[0]["body"], got[0]["head"], got[1]["body"]) == (["One two"], ["H"], [])


def test_stories_are_components(spark):
    base = datetime(2024, 1, 1)
    rows = [("a1", "Ministers debate harbour expansion", "p1", 0), ("a2", "Harbour expansion stalls again", "p2", 1), ("a3", "Storm halts harbour expansion works", "p3", 2), ("a4", "Garden show opens", "p1", 3), ("a5", "Harbour expansion remembered", "p1", 24 * 30), ("a6", None, "p1", 1)]
    df = spark.createDataFrame([(i, t, s, base + timedelta(hours=h)) for i, t, s, h in rows], "article_id string, title string, source string, event_ts timestamp")
    label = {r["article_id"]: r["story"] for r in stories.stories(df).collect()}
    assert label == {"a1": "a1", "a2": "a1", "a3": "a1", "a4": "a4", "a5": "a5", "a6": "a6"}
    [story] = stories.developing(df).collect()
    assert (story["updates"], story["sources"], story["status"], story["confidence"]) == (3, "p1,p2,p3", "DEVELOPING", 90)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("event_ts", F.col("ts").cast("timestamp"))
    events.unionByName(events.limit(50)).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = st.file_stream(spark, f"{tmp_path}/in", events.schema, per_trigger=1)
    st.start(st.deduplicated(stream, "event_id", late="60 days").select("event_id"), f"{tmp_path}/c1", f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.distinct().count() == events.select("event_id").distinct().count()
    # a second run with the same checkpoint adds nothing
    st.start(st.deduplicated(stream, "event_id", late="60 days").select("event_id"), f"{tmp_path}/c1", f"{tmp_path}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == got.count()
    st.start(st.tumbling(stream, "event_type"), f"{tmp_path}/c2", lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/windows"), mode="complete").awaitTermination()
    batch = spark.read.parquet(f"{tmp_path}/in").groupBy(F.window("event_ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("count"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/windows").collect())) == sorted(map(tuple, batch.collect()))
