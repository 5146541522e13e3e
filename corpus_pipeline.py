"""The corpus pipeline: documents of good quality, once each, free of test items and personal data, as tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.llm import bpe, decontaminate, jaccard, pii, quality
from docweir.llm.common import delete_path, scratch_folder, table
from docweir.llm.tokenizer import public_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return quality.keep_good(docs, quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (proposed by SimHash; five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    return jaccard.first_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.redact(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, encoded and decoded: their number and the hashes of both."""
    return bpe.round_trip(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", without_personal_data),
    ("BPE encoding and decoding", tokenized),
]

#: Fingerprints, alignments, the random field and tokens have no SQL; the tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. Each but the last is written as Parquet to the shared folder and read again; what is left of it goes when the driver ends."""
    docs, folder, before = table(spark, sf_dir, "documents"), scratch_folder(spark, "pipeline"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{k}")
            docs = spark.read.parquet(path)
            if before:
                delete_path(spark, before)
            before = path
    return docs
