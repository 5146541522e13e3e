"""What a label's articles left behind, and taking it away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.functions.text import ID_HEX, ID_PREFIX, is_own_id

#: Statuses that a prune owns.
PRUNABLE = ("done", "failed", "discovered")


def with_ids(paths: DataFrame) -> DataFrame:
    """``paths(path, is_dir)`` that carry an article's id: ``*_{id}.md``, ``{id}.html``, ``{id}.txt``, or a folder ``{id}``."""
    name = F.substring_index(F.regexp_replace("path", "/+$", ""), "/", -1)
    own = rf"{ID_PREFIX}[0-9a-f]{{{ID_HEX}}}"
    found = F.when(F.col("is_dir"), F.regexp_extract(name, f"^({own})$", 1)).otherwise(F.coalesce(F.nullif(F.regexp_extract(name, rf"_({own})\.md$", 1), F.lit("")), F.regexp_extract(name, rf"^({own})\.(?:html|txt)$", 1)))
    return paths.select("path", "is_dir", found.alias("article_id")).where("article_id <> ''")


def plan(articles: DataFrame, paths: DataFrame) -> DataFrame:
    """Targets ``(article_id, title, published_at, status, files, directories)`` among a label's articles.

    Only ids of the engine's own; an article goes if its status is prunable or
    if anything of it is there.
    """
    there = with_ids(paths).groupBy("article_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_dir"), F.col("path")))).alias("files"), F.array_sort(F.collect_list(F.when(F.col("is_dir"), F.col("path")))).alias("directories")
    )
    none = F.array().cast("array<string>")
    rows = articles.where(is_own_id("article_id")).join(there, "article_id", "left")
    rows = rows.select("article_id", F.coalesce("title", F.lit("")).alias("title"), F.left(F.coalesce("published_at", F.lit("")), F.lit(10)).alias("published_at"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("files", none).alias("files"), F.coalesce("directories", none).alias("directories"))
    return rows.where(F.col("status").isin(*PRUNABLE) | (F.size("files") > 0) | (F.size("directories") > 0))


def totals(targets: DataFrame) -> DataFrame:
    return targets.agg(F.coalesce(F.sum(F.size("files")), F.lit(0)).alias("files_removed"), F.coalesce(F.sum(F.size("directories")), F.lit(0)).alias("directories_removed"), F.count(F.lit(1)).alias("rows_removed"))
