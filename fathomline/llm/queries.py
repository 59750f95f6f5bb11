"""The operators of this subpackage as named queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import ship
from . import decontamination, embeddings, htmltext, langid, minhash, packing, quality, sharding, substrings, toxicity
from .common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100, bands=20, rows=5)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substrings.kept_words(table(spark, sf_dir, "documents")).drop("kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embeddings.link(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_packing, op3_html, op4_sharding, op5_decontamination, op6_toxicity, op7_substrings, op8_quality, op9_language, op10_embeddings)}

#: Removal of repeated 35-word windows is a count of windows; DuckDB can say it as it stands.
ORACLES = {
    "op7_substrings": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 34], ' ')) AS a, md5_number(array_to_string(ws[i:i + 34], ' ')) AS b FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY a, b) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
e AS (SELECT w.doc_id, u.k, w.ws[u.k] AS word FROM w, LATERAL (SELECT unnest(range(1, len(w.ws) + 1)) AS k) u),
l AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.k) AS kept, count(*) AS n FROM e ANTI JOIN c USING (doc_id, k) GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id)""",
    "op10_embeddings": r"""
WITH RECURSIVE g AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(u, v) AS (SELECT vec_id, vec_id FROM g UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT g.vec_id, (SELECT count(*) FROM l WHERE l.u = g.vec_id) AS n_links, m.c AS component_id, m.c = g.vec_id AS kept
FROM g JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) m ON m.u = g.vec_id""",
}
