"""Article pages: title, date and clean content as a self-contained document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docweir.functions import dom, embeds
from docweir.functions.dates import parsed_date
from docweir.functions.slices import parts
from docweir.functions.text import html_escaped

# What is stripped, where content is, marks of a preview, containers that may go, and what keeps them.
STRIP = ("script", "style", "noscript", "template", "button", '[role="button"]', "form", "input", "select", "textarea")
CONTENT = ("div.available-content", "article", "main", "div.post-content", "div.entry-content", "div.content")
PAYWALL = ("div.paywall", ".paywall-jump", '[data-component-name*="Paywall"]')
PRUNABLE = frozenset(["div", "span", "section", "figure"])
MEANINGFUL = frozenset(["img", "picture", "source", "video", "audio", "embed", "object", "svg", "canvas", "iframe", "hr", "br", "input"])
TITLES = (('meta[property="og:title"]', "content"), ('meta[name="twitter:title"]', "content"), ("h1", ""), ("title", ""))
DATES = (('meta[property="article:published_time"]', "content"), ('meta[name="publish_date"]', "content"), ('meta[property="og:published_time"]', "content"), ("time[datetime]", "datetime"), ("time", ""))

# The stored document's parts, around the title, the address, the style, the content and the note on a preview.
HEAD = '<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1.0">\n<title>'
CANONICAL, STYLED, BODY = '</title>\n<link rel="canonical" href="', '">\n<style>\n', '</style>\n</head>\n<body>\n<div class="email-body">\n'
NOTE, NOTE_LINK, NOTE_END, END = '<p class="backfill-note">Subscriber-only post — this is the public preview. The full text is at <a href="', '">', "</a>.</p>\n", "</div>\n</body>\n</html>\n"

#: The stored page's style; a parameter of :func:`wrapped`.
STYLE = "body{max-width:68ch;margin:0 auto;padding:2rem 1.5rem;font:16px/1.6 sans-serif}\nimg{max-width:100%;height:auto}\n"


@dataclass(frozen=True)
class ArticleConfig:
    """How one archive's pages are read; empty settings mean the fixed ones."""

    content_selector: str = ""
    title_selector: str = ""
    date_selector: str = ""
    date_attr: str = "datetime"
    strip_selectors: tuple[str, ...] = field(default=())


def page_title(tree: dom.Node, config: ArticleConfig) -> str:
    """From the configured place, even if it is blank there; else the first fixed place that has one."""
    own = tree.first(config.title_selector) if config.title_selector else None
    if own is not None:
        return own.line()
    for selector, attr in TITLES:
        n = tree.first(selector)
        value = "" if n is None else " ".join(n.attrs.get(attr, "").split()) if attr else n.line()
        if value:
            return value
    return ""


def page_dates(tree: dom.Node, config: ArticleConfig) -> list[str]:
    """What may be the date, in order; the first that is a date counts."""
    out = []
    own = tree.first(config.date_selector) if config.date_selector else None
    if own is not None:
        out.append(own.attrs.get(config.date_attr) or own.text())
    for selector, attr in DATES:
        n = tree.first(selector)
        if n is not None:
            out.append(n.attrs.get(attr, "") if attr else n.text())
    return out


def stripped(content: dom.Node, selectors: tuple[str, ...]) -> None:
    """Takes matching elements away; the text after them stays. Unusable selectors are passed over."""
    for s in selectors:
        try:
            found = content.select(s)
        except ValueError:
            continue
        for n in found:
            n.remove()


def without_empty(content: dom.Node) -> None:
    """Takes containers away that hold neither text nor anything that is seen: one pass that carries upwards what each element holds."""
    holds: set[int] = set()
    gone: dict[int, dom.Node] = {}
    for n in reversed(list(content.walk())):
        if n.tag == "!comment":
            continue
        if any(c.strip() if isinstance(c, str) else c.tag in MEANINGFUL or id(c) in holds for c in n.children):
            holds.add(id(n))
        elif n.tag in PRUNABLE:
            gone[id(n)] = n
    for parent in {id(n.parent): n.parent for n in gone.values()}.values():
        parent.children = [c for c in parent.children if id(c) not in gone]
    for n in gone.values():
        n.parent = None


def page_content(tree: dom.Node, config: ArticleConfig) -> tuple[str, bool]:
    """The content's markup, and whether the page is a preview."""
    preview = any(tree.first(s) is not None for s in PAYWALL)
    places = (config.content_selector, *CONTENT, "body")
    content = next((n for s in places if s and (n := tree.first(s)) is not None), tree)
    embeds.rewrite(content)
    stripped(content, config.strip_selectors or STRIP)
    without_empty(content)
    markup = content.html() if not content.tag.startswith("!") else "".join(c.html() if isinstance(c, dom.Node) else c for c in content.children)
    return markup, preview


def _extract(url: str, markup: str | None, config: ArticleConfig) -> tuple:
    if markup is None:
        return "", [], "", False, "FetchError", f"no page at {url}"
    try:
        tree = dom.parse(markup, url or "")
        title, dates = page_title(tree, config), page_dates(tree, config)
        content, preview = page_content(tree, config)
    except Exception as e:  # a fault of one page is that page's alone
        return "", [], "", False, "ExtractionError", f"{type(e).__name__}: {e}"
    if not content.strip():
        return title, dates, "", preview, "ExtractionError", f"no content at {url}"
    return title, dates, content, preview, "", ""


def extracted(pages: DataFrame, config: ArticleConfig = ArticleConfig()) -> DataFrame:
    """``pages(url, html, ...)`` with ``page_title, page_dates, content, preview, error_class, error``; a vectorised pass, no shuffle."""
    schema = "page_title string, page_dates array<string>, content string, preview boolean, error_class string, error string"

    out = pa.struct(list(to_arrow_schema(T._parse_datatype_string(schema))))

    @F.arrow_udf(f"struct<{schema}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, pages_html in batches:
            for html, url in parts(pages_html, urls):
                yield pa.array([dict(zip(out.names, _extract(u, h, config))) for u, h in zip(url, html)], out)

    return pages.withColumn("_e", run("url", "html")).select(*pages.columns, "_e.*")


def looked_up(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(url, html)`` of the pages at ``wanted(url)``, one for each address; the other pages are left before the shuffle."""
    return pages.join(wanted.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.max("html").alias("html"))


def articles(refs: DataFrame, pages: DataFrame, config: ArticleConfig = ArticleConfig()) -> DataFrame:
    """Each ref of ``refs(url, title, published_at, ...)`` with its article or its error: a lookup in ``pages(url, html)``.

    What the listing says of title and date goes before what the page says.
    """
    return read(with_pages(refs, pages), config)


def with_pages(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """Each ref with its page's ``html``, null where there is none."""
    once = looked_up(pages, refs).withColumnRenamed("url", "_url")
    return refs.join(once, refs["url"] == once["_url"], "left").drop("_url")


def read(refs: DataFrame, config: ArticleConfig = ArticleConfig()) -> DataFrame:
    """``refs(url, title, published_at, html, ...)`` with each one's article or its error."""
    found = extracted(refs, config)
    title = F.coalesce(F.nullif("title", F.lit("")), "page_title")
    own = F.get(F.filter(F.transform("page_dates", parsed_date), lambda d: d.isNotNull()), 0)
    out = found.withColumn("title", title).withColumn("published_at", F.coalesce("published_at", own))
    missing = F.when(F.col("error") != "", F.col("error")).when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit("no title at "), "url")).when(F.col("published_at").isNull(), F.concat(F.lit("no date at "), "url")).otherwise("")
    return out.withColumn("error", missing).withColumn("error_class", F.when((F.col("error_class") == "") & (missing != ""), "ExtractionError").otherwise(F.col("error_class"))).drop("page_title", "page_dates", "html")


def wrapped(content: Column, url: Column, title: Column, preview: Column, style: str = STYLE) -> Column:
    """A document that needs nothing else: charset, title, canonical link, style, the content, and a note on a preview."""
    href = html_escaped(url)
    note = F.when(preview, F.concat(F.lit(NOTE), href, F.lit(NOTE_LINK), href, F.lit(NOTE_END))).otherwise("")
    return F.concat(F.lit(HEAD), html_escaped(title), F.lit(CANONICAL), href, F.lit(STYLED + style + BODY), content, F.lit("\n"), note, F.lit(END))


def html_items(pages: DataFrame, item_selector: str, fields: dict) -> DataFrame:
    """Listing items of ``pages(source_index, page_no, url, payload)``: ``(source_index, page_no, pos, url, title, date_raw)``."""
    specs = {k: fields.get(k) for k in ("url", "title", "date")}

    def run(batches):
        for b in batches:
            rows = []
            for s, p, base, markup in zip(b.source_index, b.page_no, b.url, b.payload):
                tree = dom.parse(markup or "", base or "")
                for i, item in enumerate(tree.select(item_selector)):
                    rows.append((s, p, i, *(dom.field(item, specs[k], base or "") for k in ("url", "title", "date"))))
            yield pd.DataFrame(rows, columns=["source_index", "page_no", "pos", "url", "title", "date_raw"])

    return pages.select("source_index", "page_no", "url", "payload").mapInPandas(run, "source_index int, page_no int, pos int, url string, title string, date_raw string")


def next_links(pages: DataFrame, selector: str) -> DataFrame:
    """``(url, next_url)``: where each page's next link leads; null without one."""

    @F.pandas_udf("string")
    def run(url: pd.Series, html: pd.Series) -> pd.Series:
        found = (dom.parse(h or "", u or "").first(selector) for u, h in zip(url, html))
        return pd.Series([n.attrs.get("href") or None if n is not None else None for n in found], dtype=object)

    return pages.select("url", run("url", "html").alias("next_url"))
