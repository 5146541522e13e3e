"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, hard_negatives, licenses
from .common import table
from .tokenizer import public_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs.where(~held_out), public_path("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantised, top_k

    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP5_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shuffled

    got, text = shuffled(table(spark, sf_dir, "documents"), 8), F.coalesce(F.col("text"), F.lit(""))
    return got.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import best_license, license_scan

    return best_license(license_scan(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_spans

    return find_spans(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives, quantised

    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(vectors.select("vec_id", "embedding", label.alias("label")))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0), positives=5, negatives=10, least=30, most=90)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clusters import lloyd

    return lloyd(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import count_of, find_secrets, joined

    counts = [count_of(k, "base").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_bpe, op3_token_counts, op4_language, op5_topk, op6_sharding, op7_licenses, op8_quality, op9_pii, op10_decontaminate, op11_hard_negatives, op12_clusters, op13_secrets)}

ORACLE_SQL: dict[str, str] = {"op5_topk": OP5_SQL, "op7_licenses": licenses.oracle_sql(), "op11_hard_negatives": hard_negatives.oracle_sql(), "op12_clusters": clusters.oracle_sql()}
