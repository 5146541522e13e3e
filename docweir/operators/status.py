"""Status, timeline and lookup queries on the message store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The message statuses that a dashboard shows, in order.
SHOWN = ("pending", "fetched", "converted", "failed")


def count_by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("cnt"))


def status_row(rows: DataFrame, by: list[str], shown: tuple[str, ...] = SHOWN) -> DataFrame:
    """A column for each shown status, 0 where there is none, and their total."""
    each = [F.count_if(F.col("status") == s).alias(s) for s in shown]
    return rows.groupBy(*by).agg(*each, F.count_if(F.col("status").isin(*shown)).alias("total"))


def messages_for_label(messages: DataFrame, bridge: DataFrame, label: Column) -> DataFrame:
    """Messages that the bridge links to a label, latest first."""
    return messages.join(bridge.where(label).select("message_id"), "message_id").select("message_id", "subject", "date").orderBy(F.col("date").desc(), "message_id")


def sync_states(sync: DataFrame, labels: DataFrame) -> DataFrame:
    """Each sync state with its label's name, null if there is none; latest first."""
    return sync.join(labels.select("label_id", "label_name"), "label_id", "left").select("label_id", "label_name", "history_id", "updated_at").orderBy(F.col("updated_at").desc(), "label_id")


def recent(rows: DataFrame, by: str, tie: str, k: int = 20) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(k)


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The row with the highest ``by`` of each key, aggregated before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(by)).alias("_r")).select(key, "_r.*")


def timeline(rows: DataFrame, sender: str, date: str) -> DataFrame:
    """First and last date and number of messages of each sender, by the first date."""
    return rows.groupBy(sender).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n")).orderBy("first_date", sender)


def summary_text(counted: DataFrame, by: list[str]) -> DataFrame:
    """``k=v, k=v`` by status, for each group of ``counted(status, n)``."""
    pair = F.concat(F.col("status"), F.lit("="), F.col("n").cast("string"))
    return counted.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(pair)), ", ").alias("summary"))


def label_filter(labels: DataFrame, text: str) -> DataFrame:
    """Labels whose name or id has the text in it, in any case; all if it is empty."""
    f = text.strip().lower()
    return labels if not f else labels.where(F.contains(F.lower("label_name"), F.lit(f)) | F.contains(F.lower("label_id"), F.lit(f)))


def selected(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Labels with a mark on the chosen ones, in order of their names."""
    mark = chosen.select("label_id").distinct().withColumn("_s", F.lit(True))
    return labels.join(mark, "label_id", "left").withColumn("selected", F.coalesce("_s", F.lit(False))).drop("_s").orderBy("label_name", "label_id")


def toggled(selection: Column, item: Column) -> Column:
    """A set with an item added or, if it is there, taken away."""
    return F.when(F.array_contains(selection, item), F.array_remove(selection, item)).otherwise(F.array_append(selection, item))


def mapping_states(mappings: DataFrame, articles: DataFrame) -> DataFrame:
    """Each mapping's counts by status as text, ``no runs yet`` without any."""
    texts = summary_text(articles.groupBy("label_name", "status").agg(F.count(F.lit(1)).alias("n")), ["label_name"])
    return mappings.join(texts, "label_name", "left").withColumn("summary", F.coalesce("summary", F.lit("no runs yet")))


def preview(rows: DataFrame, order: list[Column], most: int = 40) -> tuple[DataFrame, int]:
    """The first rows of a report, and how many more there are."""
    return rows.orderBy(*order).limit(most), max(0, rows.count() - most)


def page_of(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in order from an offset on, at most ``limit``."""
    out = rows.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def advanced(sync: DataFrame, new: DataFrame) -> DataFrame:
    """Sync cursors ``(label_id, history_id, updated_at)`` with each label's latest one taken over from ``new``."""
    both = sync.withColumn("_n", F.lit(0)).unionByName(new.select(*sync.columns).withColumn("_n", F.lit(1)))
    return both.groupBy("label_id").agg(F.max(F.struct("updated_at", "_n", "history_id")).alias("m")).select("label_id", "m.history_id", "m.updated_at")


def cursor(sync: DataFrame, label_id: str, full: bool = False) -> str | None:
    """Where a label's next sync begins; null for a full one."""
    row = None if full else sync.where(F.col("label_id") == label_id).select("history_id").head()
    return row.history_id if row else None
