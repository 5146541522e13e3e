"""Archive listings: pages, items, first occurrences and where a walk ends.

Order is part of the meaning: ``ord`` is an item's place in the whole listing,
and every choice of a first one is a minimum by it. Minima are aggregated before
a shuffle, so that a title that a third of all items share costs one row a task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir.functions.jsonpath import dotted_items, dotted_value, json_path
from docweir.functions.text import canonical_url, stripped, template_filled, title_key
from docweir.sources.durable import durable


def page_urls(config: DataFrame) -> DataFrame:
    """``(source_index, page_no, url)`` of ``config(source_index, url_template, type, page_size, start, max_pages)``."""
    pages = F.when(F.col("type") == "none", F.array(F.lit(0))).when(F.col("max_pages") > 0, F.sequence(F.lit(0), F.col("max_pages") - 1)).otherwise(F.array().cast("array<int>"))
    rows = config.withColumn("page_no", F.explode(pages))
    value = F.when(F.col("type") == "offset", F.col("start") + F.col("page_no") * F.col("page_size")).otherwise(F.col("start") + F.col("page_no"))
    url = template_filled("url_template", offset=value, page=value, limit=F.col("page_size"))
    return rows.select("source_index", "page_no", F.when(F.col("type") == "none", F.col("url_template")).otherwise(url).alias("url"))


def json_items(pages: DataFrame, items_path: str, fields: dict[str, str]) -> DataFrame:
    """Items of ``pages(source_index, page_no, payload)`` as ``(source_index, page_no, pos, url, title, date_raw)``.

    A path that leads nowhere or to no array gives no items. A date counts only
    if it is a JSON string.
    """
    rows = pages.select("source_index", "page_no", F.posexplode(dotted_items("payload", items_path)).alias("pos", "item"))
    field = lambda name: stripped(F.coalesce(dotted_value("item", fields[name]), F.lit(""))) if fields.get(name) else F.lit("")
    date = F.lit(None).cast("string")
    if fields.get("date"):
        value = F.try_variant_get(F.try_parse_json("item"), json_path(fields["date"]), "variant")
        date = F.when(F.schema_of_variant(value) == "STRING", dotted_value("item", fields["date"]))
    return rows.select("source_index", "page_no", "pos", field("url").alias("url"), field("title").alias("title"), date.alias("date_raw"))


def running_offsets(pages: DataFrame, start: int = 0) -> DataFrame:
    """The offset that each page was asked at: ``start`` and the items of all pages before; by source."""
    before = Window.partitionBy("source_index").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.lit(start) + F.coalesce(F.sum("n_items").over(before), F.lit(0)))


def with_keys(items: DataFrame) -> DataFrame:
    """``items(url, title, ...)`` with ``url_key`` and ``title_key``; items without a URL go."""
    return items.where(F.coalesce(F.col("url"), F.lit("")) != "").withColumn("url_key", canonical_url("url")).withColumn("title_key", title_key("title"))


def first_by(items: DataFrame, key: str, ord_: str = "ord") -> DataFrame:
    """The first row of each key by ``ord``, as a minimum of rows."""
    others = [c for c in items.columns if c not in (key, ord_)]
    return items.groupBy(key).agg(F.min_by(F.struct(ord_, *others), F.col(ord_)).alias("_first")).select(key, "_first.*").select(*items.columns)


def first_urls(items: DataFrame) -> DataFrame:
    """Keyed items, the first of each canonical URL."""
    return first_by(items, "url_key")


def first_titles(items: DataFrame) -> DataFrame:
    """Of items with distinct URLs the first of each title; those without a title all stay."""
    return first_by(items.where("title_key <> ''"), "title_key").unionByName(items.where("title_key = ''"))


def deduplicated(items: DataFrame) -> DataFrame:
    """First by URL, then by title among what is left."""
    return first_titles(first_urls(items))


def new_on_page(pages: DataFrame, items: DataFrame) -> DataFrame:
    """``(source_index, page_no, new_count)``: of each page the items whose URL no page had before; pages without items count 0."""
    first = first_urls(items).groupBy("source_index", "page_no").agg(F.count(F.lit(1)).alias("new_count"))
    return pages.select("source_index", "page_no").distinct().join(first, ["source_index", "page_no"], "left").select("source_index", "page_no", F.coalesce("new_count", F.lit(0)).cast("long").alias("new_count"))


def pages_read(counts: DataFrame) -> DataFrame:
    """The pages before each source's first one that brought nothing new."""
    end = counts.groupBy("source_index").agg(F.min(F.when(F.col("new_count") == 0, F.col("page_no"))).alias("_end"))
    return counts.join(end, "source_index").where(F.col("_end").isNull() | (F.col("page_no") < F.col("_end"))).drop("_end")


def read_listing(sources: list[tuple[DataFrame, DataFrame]], limit: int | None = None) -> DataFrame:
    """Folds sources, each ``(pages(page_no), items(page_no, pos, url, title, ...))``, in order.

    A source's walk ends at its first page without a new URL; what an earlier
    source has, by URL or title, a later one does not add. ``limit`` counts over
    all sources. Sources are few, so the fold is a loop on the driver; each step
    is a join, and is kept, so that the plan does not grow with their number.
    """
    kept: DataFrame | None = None
    seen: DataFrame | None = None
    for k, (pages, items) in enumerate(sources):
        own = durable(with_keys(items).withColumn("source_index", F.lit(k)).withColumn("ord", F.struct(F.lit(k).alias("s"), F.col("page_no").cast("int").alias("p"), F.col("pos").cast("int").alias("i"))))
        fresh = own if seen is None else own.join(seen.select("url_key").distinct(), "url_key", "left_anti")
        counts = new_on_page(pages.withColumn("source_index", F.lit(k)), fresh)
        urls = durable(first_urls(fresh).join(pages_read(counts).select("page_no"), "page_no", "left_semi"))
        titles = first_titles(urls)
        if kept is not None:
            titles = titles.join(kept.where("title_key <> ''").select("title_key").distinct(), "title_key", "left_anti")
        titles, urls = durable(titles.select(*own.columns)), urls.select(*own.columns)
        kept = titles if kept is None else kept.unionByName(titles)
        seen = urls if seen is None else seen.unionByName(urls)
    if kept is None:
        raise ValueError("no sources")
    return kept if limit is None else kept.orderBy("ord").limit(limit)


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows(source_index, ...)`` with the columns of ``sources(source_index, ...)``; a number that no source has means the first one.

    Sources are those of a label, few enough to be read as one row.
    """
    others = [c for c in sources.columns if c != "source_index"]
    by_number = sources.agg(F.map_from_entries(F.collect_list(F.struct("source_index", F.struct(*others).alias("s")))).alias("_by"))
    got = rows.join(F.broadcast(by_number)).withColumn("_s", F.coalesce(F.try_element_at("_by", F.col("source_index")), F.try_element_at("_by", F.lit(0))))
    return got.select(*rows.columns, "_s.*")


def contributions(listing: DataFrame) -> DataFrame:
    """Items that each source added."""
    return listing.groupBy("source_index").agg(F.count(F.lit(1)).alias("n"))


def walked(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """``(source_index, step, url)``: the first ``most`` pages of each walk from ``starts(source_index, url)`` along ``edges(source_index, url, next_url)``.

    All walks at once, by list ranking: each round doubles how far a jump leads
    and how many pages are known, so there are no more rounds than ``most`` has
    binary digits, whatever the pages. A page seen before ends a walk. Of edges
    from one page the smallest counts. The pages found, ``most`` for each start
    and no more, pass through the driver; the edges never do.
    """
    spark, found = edges.sparkSession, "source_index int, url string, step int"
    jumps = durable(edges.where("next_url is not null").groupBy("source_index", "url").agg(F.min("next_url").alias("next_url")))
    known = {(r.source_index, r.url): 0 for r in starts.collect()}
    for k in range(max(0, most - 1).bit_length()):
        before = spark.createDataFrame([(*page, step) for page, step in known.items()], found)
        further = before.join(jumps, ["source_index", "url"]).where(F.col("step") + (1 << k) < most).select("source_index", F.col("next_url").alias("url"), (F.col("step") + (1 << k)).alias("step")).collect()
        new = {(r.source_index, r.url): r.step for r in sorted(further, key=lambda r: -r.step) if known.get((r.source_index, r.url), most) > r.step}
        if not new:
            break
        known |= new
        if most > 2 << k:
            then = jumps.select("source_index", F.col("url").alias("next_url"), F.col("next_url").alias("after"))
            jumps = durable(jumps.join(then, ["source_index", "next_url"]).select("source_index", "url", F.col("after").alias("next_url")))
    return spark.createDataFrame([(*page, step) for page, step in known.items() if step < most], found).select("source_index", "step", "url")


def next_link_walk(edges: DataFrame, start: str, max_pages: int) -> DataFrame:
    """``(step, url)``: pages in the order in which next links lead to them, from ``start``."""
    starts = edges.sparkSession.createDataFrame([(0, start)], "source_index int, url string")
    return walked(edges.withColumn("source_index", F.lit(0)), starts, max_pages).select("step", "url")


def offset_edges(store: DataFrame, source_index: int, template: str, page_size: int, items_path: str) -> DataFrame:
    """``(source_index, url, next_url)`` of the pages of ``store(url, html)`` that a template can ask for: the next one is asked at the offset after the items that this one has."""
    parts = template.replace("{limit}", str(page_size)).split("{offset}")
    pattern = "^" + re.escape(parts[0]) + "([0-9]+)" + r"\1".join(map(re.escape, parts[1:])) + "$"
    at = F.regexp_extract("url", pattern, 1).cast("long")
    own = store.where(F.rlike("url", F.lit(pattern))).groupBy("url").agg(F.max("html").alias("html"))
    n = F.coalesce(F.size(dotted_items("html", items_path)), F.lit(0))
    following = template_filled(F.lit(template), offset=at + n, limit=F.lit(page_size))
    return own.select(F.lit(source_index).alias("source_index"), "url", F.when(n > 0, following).alias("next_url"))


def json_problem(payload: Column | str, items_path: str) -> Column:
    """Why a page is no page of a listing: its text is no JSON, or there is something else than a list at the path. Null if there is a list, nothing, or JSON's null."""
    parsed = F.try_parse_json(payload)
    value = F.try_variant_get(parsed, json_path(items_path), "variant")
    kind = F.schema_of_variant(value)
    wrong = value.isNotNull() & ~F.is_variant_null(value) & ~F.startswith(kind, F.lit("ARRAY"))
    return F.when(parsed.isNull(), "no JSON").when(wrong, F.concat(F.lit(f"items path {items_path!r} leads to "), F.lower(kind), F.lit(", not to a list")))


def reachable(edges: DataFrame, start: Column | int, max_pages: int) -> DataFrame:
    """``(step, node)`` from a recursive query over ``edges(node, next_node)`` with one next node each."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("_next_links")
    return spark.sql(
        f"""WITH RECURSIVE walk(step, node) MAX RECURSION LEVEL {max_pages + 1} AS (
            SELECT 0, CAST({int(start)} AS BIGINT)
            UNION ALL SELECT step + 1, next_node FROM walk JOIN _next_links USING (node) WHERE step + 1 < {max_pages} AND next_node IS NOT NULL
        ) SELECT step, node FROM walk"""
    )
