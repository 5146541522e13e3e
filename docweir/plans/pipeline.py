"""What a user runs: scan, run, prune, validate, retry, and reading a label's listing."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.functions.dates import parsed_date
from docweir.functions.markdown import converted
from docweir.functions.text import canonical_url
from docweir.operators import articles, linkage, listing, prune, render, state, status
from docweir.sources import files, sinks
from docweir.sources.config import Mapping
from docweir.sources.durable import durable, scratch

from .control import Control


LOG = logging.getLogger(__name__)

#: A task reads about so many articles; a prune shows so many errors of files, and of folders.
ARTICLES_A_TASK, SHOWN_ERRORS = 32, 100


class ListingError(RuntimeError):
    """No archive of a label could be listed, or its only one has a page that is no listing."""


@dataclass(frozen=True)
class Folders:
    """Where files go; on a cluster, shared ones."""

    raw: str
    markdown: str
    published: str = ""


@dataclass(frozen=True)
class Result:
    label: str
    listed: int
    held: int
    missing: int
    selected: int = 0
    written: int = 0
    failed: int = 0
    dry_run: bool = False


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def listing_pages(spark: SparkSession, m: Mapping, store: DataFrame) -> DataFrame:
    """``(source_index, page_no, url, payload)`` of all sources' listing pages that are in ``store(url, html)``.

    Where a page's place follows from the pages before, by its offset or by a
    link, all such sources are walked together in a fixed number of rounds.
    """
    edges, starts, most, fixed = [], [], 1, []
    for i, source in enumerate(m.sources):
        cfg = source.listing
        if cfg.next_page_selector:
            edges.append(articles.next_links(store.select("url", "html"), cfg.next_page_selector).withColumn("source_index", F.lit(i)))
            starts.append((i, cfg.url_template, cfg.paging.max_pages))
        elif cfg.mode == "json" and cfg.paging.type == "offset":
            edges.append(listing.offset_edges(store, i, cfg.url_template, cfg.paging.page_size, cfg.items_path))
            starts.append((i, cfg.url_template.format(offset=cfg.paging.start, limit=cfg.paging.page_size), cfg.paging.max_pages))
        else:
            fixed.append((i, cfg.url_template, cfg.paging.type, cfg.paging.page_size, cfg.paging.start, cfg.paging.max_pages))
    wanted = listing.page_urls(spark.createDataFrame(fixed, "source_index int, url_template string, type string, page_size int, start int, max_pages int"))
    if starts:
        own, most = spark.createDataFrame(starts, "source_index int, url string, max_pages int"), max(n for *_, n in starts)
        walks = listing.walked(reduce(DataFrame.unionByName, edges), own, most).join(own.select("source_index", "max_pages"), "source_index").where("step < max_pages")
        wanted = wanted.unionByName(walks.select("source_index", F.col("step").alias("page_no"), "url"))
    return durable(wanted.join(articles.looked_up(store, wanted).withColumnRenamed("html", "payload"), "url").select("source_index", "page_no", "url", "payload"))


def list_sources(spark: SparkSession, m: Mapping, store: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], list[tuple[int, str]]]:
    """Pages and items of each source, up to its first page that is missing or has no item; and what is wrong with that page where it is no page of a listing."""
    pages, items, problems = listing_pages(spark, m, store), [], []
    for i, source in enumerate(m.sources):
        own, cfg = pages.where(F.col("source_index") == i), source.listing
        items.append(listing.json_items(own, cfg.items_path, cfg.fields) if cfg.mode == "json" else articles.html_items(own, cfg.item_selector, cfg.fields))
        if cfg.mode == "json":
            problems.append(own.select("source_index", "page_no", F.concat_ws(" at ", listing.json_problem("payload", cfg.items_path), "url").alias("problem")).where(listing.json_problem("payload", cfg.items_path).isNotNull()))
    found = durable(reduce(DataFrame.unionByName, items))
    # a page that is not there ends its source like one without items; there are as many ends as sources
    there = found.select("source_index", "page_no").distinct()
    asked = there.groupBy("source_index").agg(F.max("page_no").alias("m")).select("source_index", F.explode(F.sequence(F.lit(0), F.col("m") + 1)).alias("page_no"))
    missing = asked.unionByName(pages.select("source_index", "page_no")).join(there, ["source_index", "page_no"], "left_anti")
    ends = {r.source_index: r.end for r in missing.groupBy("source_index").agg(F.min("page_no").alias("end")).collect()}
    said, out = [], []
    for i in range(len(m.sources)):
        own = F.col("source_index") == i
        before = own & (F.col("page_no") < ends[i]) if i in ends else own
        out.append((pages.where(before).select("page_no"), found.where(before).drop("source_index")))
    if problems and ends:
        at_end = reduce(DataFrame.unionByName, problems).where(reduce(lambda a, b: a | b, ((F.col("source_index") == i) & (F.col("page_no") == end) for i, end in ends.items())))
        said = sorted((r.source_index, r.problem) for r in at_end.groupBy("source_index").agg(F.min("problem").alias("problem")).collect())
    return out, said


def read_listing(spark: SparkSession, m: Mapping, store: DataFrame, limit: int | None = None) -> DataFrame:
    """All sources of a label in order; one that gives nothing, or whose pages are no listing, does not stop the others."""
    sources, problems = list_sources(spark, m, store)
    for i, problem in problems:
        pages, items = sources[i]
        # a walk ends before a wrong page if a page before that brought nothing new
        all_new = listing.pages_read(listing.new_on_page(pages.withColumn("source_index", F.lit(i)), listing.with_keys(items).withColumn("source_index", F.lit(i)).withColumn("ord", F.struct("page_no", "pos")))).count() == pages.count()
        if all_new and len(m.sources) == 1:
            raise ListingError(problem)
        if all_new:
            LOG.warning("%s of %r ends early: %s", m.sources[i].display_name, m.label_name, problem)
    found = listing.read_listing(sources, limit)
    if len(m.sources) > 1 and not found.take(1):
        raise ListingError(f"no articles of {m.label_name!r} in any of {len(m.sources)} archives")
    return durable(found.withColumn("published_at", parsed_date("date_raw")))


def held_messages(messages: DataFrame, bridge: DataFrame, label_id: str) -> DataFrame:
    """The messages that ``bridge(message_id, label_id)`` puts under a label, whatever label they were found under; none without a label id."""
    return status.messages_for_label(messages, bridge.distinct(), (F.col("label_id") == label_id) & F.lit(bool(label_id)))


def corpus(messages: DataFrame, files: DataFrame | None, label: str) -> DataFrame:
    """The held index: a label's messages, latest first, or else its Markdown files."""
    if not messages.take(1) and files is not None:
        messages = render.held_from_markdown(files, label)
    return linkage.corpus_index(messages.select("message_id", F.coalesce("subject", F.lit("")).alias("subject"), F.struct((-F.coalesce(F.unix_timestamp(parsed_date("date")), F.lit(0))).alias("d"), "message_id").alias("corpus_ord")))


def scan(refs: DataFrame, index: DataFrame, articles_state: DataFrame, label: str) -> DataFrame:
    """Classifies a listing and writes nothing."""
    known = state.completed_urls(articles_state, label).select(canonical_url("url").alias("canonical"))
    entries = linkage.classify(refs, index, known)
    return entries.join(refs.select("ord", "source_index", "published_at"), "ord")


def settle(spark: SparkSession, store: state.StateStore, folders: Folders) -> tuple[int, int]:
    """Finishes the batches that are staged: files go to their places, rows to the state; how many were written and failed.

    After each batch, and before a run for what one that was killed has left.
    What has no journal was cut off before its end and goes without a trace.
    """
    written = failed = 0
    for folder in sinks.staged(spark, folders.markdown):
        out = sinks.settle(spark, folder, folders.raw, folders.markdown)
        if out:
            rows = spark.createDataFrame(out, "article_id string, raw_html_path string, markdown_path string, error string")
            good, bad = rows.where("error = ''"), rows.where("error <> ''").select("article_id", F.col("error").alias("error_message"))
            stamp = F.lit(now())
            store.merge("articles", rows, lambda old: state.marked_failed(state.marked_done(old, good, stamp), bad, stamp))  # noqa: B023
        sinks.let_go(spark, folder)
        bad_ones = sum(e != "" for *_, e in out)
        written, failed = written + len(out) - bad_ones, failed + bad_ones
    return written, failed


def ready(part: DataFrame, m: Mapping, source) -> DataFrame:
    """``part(article_id, url, title, published_at, html)`` as ``(article_id, file_name, html, markdown, error)``, each article by itself."""
    got = articles.read(part, source.article).withColumn("_m", converted(F.col("content")))
    html = articles.wrapped(F.col("content"), F.col("url"), F.col("title"), F.col("preview"))
    head = render.front_matter(F.col("article_id"), F.col("title"), F.lit(source.sender), F.col("published_at"), F.lit(m.label_name), F.lit(m.label_id))
    whole = render.with_keys(F.concat(head, F.lit("\n"), F.col("_m.body"), F.lit("\n")), {"source_url": F.col("url"), "origin": F.lit(render.ORIGIN)})
    error = F.when(F.col("error") != "", F.col("error")).otherwise(F.col("_m.error"))
    return got.select("article_id", render.file_name(F.col("title"), F.col("article_id")).alias("file_name"), html.alias("html"), F.when((error == "") & (F.col("_m.body") != ""), whole).alias("markdown"), error.alias("error"))


def run(spark: SparkSession, m: Mapping, pages: DataFrame, index: DataFrame, store: state.StateStore, folders: Folders, limit: int | None = None, dry_run: bool = False, control: Control | None = None, batch: int = 1000) -> Result:
    """Writes what is missing; ``limit`` takes the first ones as listed. A dry run only counts.

    Held entries are recorded, then the selected ones as ``discovered``; these
    are read and written in batches of about ``batch`` articles, and the state
    knows each batch's outcome before the next begins. An article that fails is
    recorded as failed and stops no other. ``control`` hears of each batch. A
    stop lets the batch at hand end; a cancellation, an interruption or a fault
    drops it whole, so that files, state and audit agree whenever the run ends:
    it is closed with what it has written, and the others stay ``discovered``. A
    run whose driver was killed is finished by the next one. Running again
    writes nothing new.
    """
    if not dry_run:
        settle(spark, store, folders)
    refs = read_listing(spark, m, pages)
    entries = durable(scan(refs, index, store.read("articles"), m.label_name))
    total = linkage.summary(entries).first()
    missing = entries.where("status = 'discovered'").orderBy("ord")
    chosen = durable(missing.limit(limit) if limit is not None else missing)
    n = {r.source_index: r.n for r in chosen.groupBy("source_index").agg(F.count(F.lit(1)).alias("n")).collect()}
    selected = sum(n.values())
    if dry_run:
        return Result(m.label_name, total.listed, total.held, total.missing, selected=selected, dry_run=True)
    report = control.report if control else lambda stage, **counts: None
    run_id = store.start_run(m.label_name, now())
    work, written, failed = scratch(spark, "run"), 0, 0
    try:
        stamp = F.lit(now())
        row = lambda df: df.select("article_id", F.lit(m.label_name).alias("label_name"), F.lit(m.label_id).alias("label_id"), "url", "title", F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("published_at"), "status", "match_reason")
        fresh = row(entries.where("status = 'have'").unionByName(chosen))
        store.merge("articles", fresh, lambda old: state.upserted(old, fresh, stamp))
        report("listed", listed=total.listed, held=total.held, selected=selected)
        # the pages are looked up once for all batches, each of which reads its own folder
        batches = {i: -(-k // batch) for i, k in n.items()}
        of = F.create_map(*[F.lit(x) for kv in batches.items() for x in kv]) if batches else F.create_map().cast("map<int,int>")
        number = F.pmod(F.xxhash64("article_id"), F.try_element_at(of, F.col("source_index"))).alias("batch")
        found = articles.with_pages(chosen.select("article_id", "url", "title", "published_at", "source_index", number), pages)
        if batches and not (control and control.stopped):
            found.write.partitionBy("source_index", "batch").parquet(f"{work}/pages")
        for i, k in [(i, k) for i, source in enumerate(m.sources) for k in range(batches.get(i, 0))]:
            if control and control.stopped:
                break
            where = f"{work}/pages/source_index={i}/batch={k}"
            if files.names_in(spark, where):
                part = spark.read.parquet(where).repartition(-(-n[i] // (batches[i] * ARTICLES_A_TASK)))
                sinks.stage(ready(part, m, m.sources[i]), folders.markdown)
            w, f = settle(spark, store, folders)
            written, failed = written + w, failed + f
            report("written", sources=i + 1, written=written, failed=failed)
    except Exception:
        if not (control and control.stopped):
            raise
    finally:
        w, f = settle(spark, store, folders)  # a batch that was cut off: whole, or not at all
        written, failed = written + w, failed + f
        store.complete_run(run_id, now(), total.listed, total.held, written, failed)
        files.delete(spark, work)
    return Result(m.label_name, total.listed, total.held, total.missing, selected, written, failed)


def prune_label(spark: SparkSession, label: str, store: state.StateStore, folders: Folders, dry_run: bool = True) -> dict:
    """Takes a label's files, then its folders, then its rows away; a dry run reports the same totals. The plan is made anew each time."""
    rows = store.read("articles")
    own = rows.where(F.col("label_name") == label)
    targets = prune.plan(own, sinks.files_in(spark, [folders.raw, folders.markdown, *([f"{folders.published}/{label}"] if folders.published else [])]))
    if dry_run:
        return {**prune.totals(targets).first().asDict(), "dry_run": True, "errors": []}
    targets = durable(targets)
    done = []
    for kind in ("files", "directories"):  # files first, so that folders are there as the plan saw them
        gone = durable(sinks.delete_paths(targets.select(F.explode(kind).alias("path"))))
        done.append((gone.where("gone").count(), [r.error for r in gone.where("error <> ''").orderBy("path").limit(SHOWN_ERRORS).collect()]))
    ids = targets.select("article_id")
    number = state.number_of_ids(rows, ids)
    store.merge("articles", ids, lambda old: state.without_ids(old, ids))
    return {"files_removed": done[0][0], "directories_removed": done[1][0], "rows_removed": number, "dry_run": False, "errors": done[0][1] + done[1][1]}


def validate(mappings: DataFrame, bridge: DataFrame) -> DataFrame:
    """``(label_name, problem)`` for mappings ``(label_name, label_id)`` against ``bridge(message_id, label_id)``: no id, or no messages; '' if there are some."""
    n = bridge.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    return mappings.join(n, "label_id", "left").select("label_name", F.when(F.coalesce("label_id", F.lit("")) == "", "no label id").when(F.col("n").isNull(), "no messages held").otherwise("").alias("problem"), F.coalesce("n", F.lit(0)).alias("n_held"))
