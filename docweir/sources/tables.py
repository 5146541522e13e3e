"""Tables by name, and the columns that each store must have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: Schemas of the message store, the state store and listings.
SCHEMAS = {
    "messages": "message_id string, thread_id string, label_id string, status string, subject string, sender string, date string, raw_text_path string, raw_html_path string, markdown_path string, error_message string, created_at string, updated_at string",
    "message_labels": "message_id string, label_id string",
    "labels": "label_id string, label_name string, updated_at string",
    "fetch_runs": "run_id long, label_id string, started_at string, completed_at string, ids_discovered long, messages_fetched long, messages_converted long, messages_failed long",
    "sync_state": "label_id string, history_id string, updated_at string",
    "articles": "article_id string, label_name string, label_id string, url string, title string, published_at string, status string, match_reason string, raw_html_path string, markdown_path string, error_message string, created_at string, updated_at string",
    "runs": "run_id long, label_name string, started_at string, completed_at string, articles_listed long, articles_held long, articles_written long, articles_failed long, dry_run boolean",
    "listing_pages": "source_index int, page_no int, payload string",
    "listing_items": "source_index int, page_no int, pos int, url string, title string, date_raw string",
}


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of a store: missing ones null, others dropped, types cast."""
    fields = T._parse_datatype_string(SCHEMAS[name]).fields
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def store_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A store's table, empty if there is none."""
    try:
        return conformed(spark.read.parquet(path), name)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return empty(spark, name)
        raise
