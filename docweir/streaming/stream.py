"""Arriving pages: a file stream that is linked against the held corpus and merged into the state, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweir.functions.text import article_id, canonical_url
from docweir.operators import linkage, listing, state
from docweir.sources.durable import durable


def page_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def merged(old: DataFrame, refs: DataFrame, index: DataFrame, label: str, now: str) -> DataFrame:
    """The state after a batch of refs: what the label has already is not looked at again unless it failed, the rest is classified and merged.

    An article's id is its address's, so ``old`` need hold no more than the
    buckets of the refs' ids. A batch that is merged twice leaves what it left
    the first time.
    """
    known = old.where((F.col("label_name") == label) & (F.col("status") != "failed")).select(canonical_url("url").alias("canonical"))
    fresh = listing.deduplicated(listing.with_keys(refs).join(known, F.col("url_key") == F.col("canonical"), "left_anti")).drop("url_key", "title_key")
    entries = linkage.classify(fresh, index, known.limit(0))
    blank = F.lit("")
    new = entries.select("article_id", F.lit(label).alias("label_name"), blank.alias("label_id"), "url", "title", blank.alias("published_at"), "status", "match_reason")
    return state.upserted(old, new, F.lit(now))


def run(pages: DataFrame, to_refs: Callable[[DataFrame], DataFrame], index: DataFrame, store: state.StateStore, checkpoint: str, label: str, clock: Callable[[], str], available_now: bool = True) -> StreamingQuery:
    """Starts the stream; a batch reads and writes the buckets of its own articles. The corpus is the snapshot that ``index`` reads; a later scan corrects what it did not hold yet."""

    def each(batch: DataFrame, number: int) -> None:
        refs = durable(to_refs(batch))
        store.merge("articles", refs.select(article_id("url").alias("article_id")), lambda old: merged(old, refs, index, label, clock()))

    writer = pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def status_stream(rows: DataFrame, delay: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Counts by status and event-time window of a stream of ``(ts, status)``, late rows bounded by a watermark."""
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", width).start.alias("start"), "status").agg(F.count(F.lit(1)).alias("n"))
