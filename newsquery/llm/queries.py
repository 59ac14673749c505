"""The registered queries of this subpackage; each is a thin use of its operator over a whole table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, pii, secret_scan, toxicity, warc
from .common import held_out, table
from .decontaminate import contaminated
from .embedding_dedup import near_duplicates
from .jaccard_join import jaccard_components
from .packing import pack_documents
from .token_counts import token_counts


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The key of the registered query only; a deployment passes its own.
PII_KEY = "newsquery-demonstration-key"


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    return found.select("doc_id", "text", F.size("found").alias("n_replaced"), F.array_join(F.array_sort(F.col("found.kind")), ",").alias("kinds"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the pages carry no capture time: one fixed date stands for it
    responses = warc.pages_to_responses(table(spark, sf_dir, "pages"), datetime(2024, 1, 1, tzinfo=timezone.utc))
    return warc.build_derivatives(responses, "page_id")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_embedding_dedup": op2_embedding_dedup, "op3_pii_pseudonyms": op3_pii_pseudonyms, "op4_token_counts": op4_token_counts, "op5_language_id": op5_language_id, "op6_warc_derivatives": op6_warc_derivatives, "op7_jaccard_join": op7_jaccard_join, "op8_decontamination": op8_decontamination, "op9_best_fit_packing": op9_best_fit_packing, "op10_toxicity": op10_toxicity}
#: Links within labels by all pairs, and what chains of them reach.
_OP2 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN n ON n.x = c.id"""

#: Shingle sets, their intersections by shared shingles, and what chains of links reach.
_OP7 = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, unnest(g) AS t FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.reach)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY 1, 2"""

#: Where there is none, SQL can't say it: tests hold those operators against brute force.
ORACLES: dict[str, str] = {"op2_embedding_dedup": _OP2, "op7_jaccard_join": _OP7}
