"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import gif, langid, mixing, pieces, repeats, sharding, simhash, topk, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(_table(spark, sf_dir, "documents"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 on web pages, where markup, address and host all speak."""
    return langid.identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(_table(spark, sf_dir, "documents"))


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's digests; the frames and the media bytes are the operator's own output."""
    return gif.archive_texts(_table(spark, sf_dir, "documents"), keep_media=False).drop("frames")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def sharding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 per shard: rows, and that its slots run from 0 without a gap."""
    out = op3_sharding(spark, sf_dir).groupBy("shard")
    return out.agg(F.count("*").alias("rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("slots"))


def sharded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 per document: every one is there, with its size."""
    return op3_sharding(spark, sf_dir).select("doc_id", "size", "law")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10's parts of every url and the rule that decides it, with the rule's verdict."""
    rows = op10_url_filter(spark, sf_dir)
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("told"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_sharding, op4_suffix_dedup, op5_gif_media, op6_sentencepiece, op7_simhash, op8_top_k, op9_mixing, op10_url_filter, language_of_pages, sharding_sizes, sharded_documents, url_rules)}

ORACLES = {
    "op8_top_k": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, q.own AS own, c.vec_id AS vec_id,
                   list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
            FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "sharding_sizes": """
        WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT unnest(range(16)) AS s),
        r AS (SELECT CAST(s AS INTEGER) AS shard, n // 16 + CAST(s < n % 16 AS BIGINT) AS rows FROM s, n)
        SELECT shard, CAST(rows AS BIGINT) AS rows, CAST(0 AS BIGINT) AS first_slot, CAST(rows - 1 AS BIGINT) AS last_slot, CAST(rows AS BIGINT) AS slots FROM r WHERE rows > 0""",
    "sharded_documents": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, 'rows' AS law FROM documents",
    "url_rules": r"""
        WITH p AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r AS (
            SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                           WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                           WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                           WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' END AS told FROM r""",
}
