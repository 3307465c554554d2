"""Registered queries of the text operators, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import exact, langid, mixing, packing, pii, quality, repair, rollups, simhash, toxicity, vectors, warc, whitening
from tarmac.llm.tables import read
from tarmac.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return register


@_query()
def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query()
def op2_archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no capture time, so pages are a second apart in the order of their ids.
    return warc.round_trip(read(spark, sf_dir, "pages"), time=F.lit(946684800) + F.col("page_id"))


@_query()
def op3_shape_field_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


@_query()
def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted; then toxic ones deleted and those of low quality counted anew without repeated lines, twice.

    Documents without an id stay as inserted.
    """
    documents, path = read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    version = F.lit("word_bpe_49k").alias("version")
    rollup = rollups.Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit(1, rollups.token_counts(documents, path).select("*", version), unnamed=True)
    lines = F.split("text", "\n")
    shorter = documents.where(F.size(lines) > F.size(F.array_distinct(lines))).withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    labels = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    revised = rollups.token_counts(shorter, path).join(labels.where("toxic = 0 AND quality = 0"), F.col("id") == F.col("_id"))
    deleted = labels.where("toxic = 1").select(
        F.col("_id").alias("id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"),
        F.lit(None).cast("bigint").alias("tokens"), version)
    for _ in range(2):
        rollup.commit(2, revised.select("id", "source", "lang", "tokens", version).unionByName(deleted), unnamed=True)
    return rollup.totals()


@_query()
def op5_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"))


@_query()
def op6_segmentation_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    labelled = documents.where("NOT held_out").select(F.col("doc_id").alias("key"), "text", "lang")
    model = langid.fit(labelled, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(documents, model, keep=["doc_id", "held_out"])


@_query()
def op7_itq_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(read(spark, sf_dir, "embeddings"))


@_query("""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""")
def op8_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decisions(read(spark, sf_dir, "documents"))


@_query()
def op9_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    texts = documents.where("NOT held_out").select(F.col("doc_id").alias("key"), "text")
    labels = read(spark, sf_dir, "labels").where(~langid.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"))
    return toxicity.score(documents, toxicity.fit(texts, labels), keep=["doc_id", "held_out"])


@_query(r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), named AS (
  SELECT source, count(*) AS documents, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sizes GROUP BY source
), limits AS (
  SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS lim,
         1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM named
), levels AS (
  SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY lim, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY lim, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM limits
), targets AS (
  SELECT source, documents, source_size, CASE WHEN lim <= coalesce(common, lim) THEN cap::DOUBLE ELSE weight * common END AS target
  FROM (SELECT *, max(CASE WHEN lim > level THEN level END) OVER () AS common FROM levels)
), dealt AS (
  SELECT s.*, t.source_size, t.target,
         ('0x' || substr(md5('17:shard:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
           % ceil(sqrt(t.documents))::BIGINT AS shard
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), shards AS (
  SELECT source, shard, sum(size)::BIGINT AS words, greatest(1, round(sum(size) / 32)::BIGINT) AS blocks
  FROM dealt GROUP BY source, shard HAVING sum(size) > 0
), seats AS (SELECT round(sum(target) / 32)::BIGINT AS seats FROM targets),
source_ranks AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS place, seats
  FROM targets, seats, LATERAL (SELECT unnest(range(seats + 1)) AS k)
), source_quotas AS (
  SELECT r.source, least(count(*) FILTER (place <= seats), 2 * any_value(b.blocks))::BIGINT AS quota
  FROM source_ranks r JOIN (SELECT source, sum(blocks) AS blocks FROM shards GROUP BY source) b
    ON r.source IS NOT DISTINCT FROM b.source GROUP BY r.source
), shard_ranks AS (
  SELECT h.*, q.quota AS seats,
         row_number() OVER (PARTITION BY h.source ORDER BY h.blocks / (2 * k + 1) DESC, h.shard, k) AS place
  FROM shards h JOIN source_quotas q ON h.source IS NOT DISTINCT FROM q.source,
       LATERAL (SELECT unnest(range(q.quota + 1)) AS k)
), shard_quotas AS (
  SELECT source, shard, words, blocks, quota // blocks AS whole, quota % blocks AS extra,
         CASE WHEN blocks % 1000003 <> 0 THEN 1000003 ELSE 998244353 END AS step,
         ('0x' || substr(md5('17:' || coalesce('=' || source, '') || ':' || shard), 1, 8))::BIGINT AS shift
  FROM (SELECT source, shard, words, blocks, least(count(*) FILTER (place <= seats), 2 * blocks) AS quota
        FROM shard_ranks GROUP BY source, shard, words, blocks)
), line AS (
  SELECT d.*, q.words, q.blocks, q.whole, q.extra, q.step, q.shift,
         (sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
                          ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM dealt d LEFT JOIN shard_quotas q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 OR blocks IS NULL THEN 0 ELSE whole * size + coalesce(list_sum(list_transform(
         range(((start + 1) * blocks - 1) // words, ((start + size) * blocks - 1) // words + 1),
         lambda b: CASE WHEN (b * step + shift) % blocks < extra
           THEN least(start + size, ((b + 1) * words) // blocks) - greatest(start, (b * words) // blocks) ELSE 0 END
       )), 0) END::BIGINT AS taken
FROM line
""")
def op10_apportioned_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.quotas(read(spark, sf_dir, "documents"))


@_query()
def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@_query()
def op12_ranked_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return repair.audit(repair.damage(conversations), conversations)


@_query()
def op13_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    texts = documents.where("NOT held_out").select(F.col("doc_id").alias("key"), "text")
    labels = read(spark, sf_dir, "labels").where(~langid.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    return quality.score(documents, quality.fit(texts, labels), keep=["doc_id", "held_out"])
