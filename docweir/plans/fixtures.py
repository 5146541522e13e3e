"""Queries on markup and payloads that are written here around each row of ``pages``, so that SQL can say what comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.functions import jsonpath, text
from docweir.functions.dates import iso_date
from docweir.operators import articles, listing, probe, state, status
from docweir.operators.articles import ArticleConfig
from docweir.sources.durable import scratch

from . import pipeline
from .queries import documents, pages, query


def numbered(template: str) -> Column:
    """A text with each row's number in place of ``#``."""
    return F.replace(F.lit(template), F.lit("#"), F.col("page_id").cast("string"))


def chosen(*templates: str) -> Column:
    """One text for each row, in turn."""
    return F.element_at(F.array(*map(numbered, templates)), (F.col("page_id") % len(templates) + 1).cast("int"))


def sql_chosen(*templates: str | None) -> str:
    said = ["NULL" if t is None else "replace('" + t.replace("'", "''") + "', '#', CAST(page_id AS VARCHAR))" for t in templates]
    return f"CASE page_id % {len(said)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(said)) + " END"


def written(spark: SparkSession, sf: str, *templates: str) -> DataFrame:
    """``(page_id, url, html)``: an address for each page, and its markup."""
    return pages(spark, sf).select("page_id", numbered("https://x.test/p/#").alias("url"), chosen(*templates).alias("html"))


EMBEDS = (
    ("""<div data-component-name="EmbeddedPostToDOM" data-attrs='{"url": "https://a.test/#?utm_source=x", "title": "T  #", "bylines": [{"name": "A"}, {"name": "B"}, {"name": "C"}], "publication_name": "Pub"}'></div>""", '<p data-backfill-embed="EmbeddedPostToDOM">Embedded post: <a href="https://a.test/#">T #</a> — A, B and C · Pub</p>'),
    ("""<div data-component-name="DigestPostEmbed"><a href="https://a.test/#"><h4>Title #</h4><div><span>Ann</span><span>·</span><span>May 1</span></div></a></div>""", '<p data-backfill-embed="DigestPostEmbed">Embedded post: <a href="https://a.test/#">Title #</a> — Ann · May 1</p>'),
    ("""<div data-component-name="EmbeddedPublicationToDOMWithSubscribe" data-attrs='{"base_url": "https://p.test/#", "name": "N #", "author_name": "Au", "hero_text": "H"}'></div>""", '<p data-backfill-embed="EmbeddedPublicationToDOMWithSubscribe">Embedded publication: <a href="https://p.test/#">N #</a> — H · by Au</p>'),
    ("""<div data-component-name="Youtube2ToDOM" data-attrs='{"videoId": "abcDEF#", "startTime": "12s"}'></div>""", '<p data-backfill-embed="Youtube2ToDOM">Embedded media: <a href="https://www.youtube.com/watch?v=abcDEF#&amp;t=12s">Watch on YouTube</a></p>'),
    ("""<iframe src="data:text/html,%3Cblockquote%20data-instgrm-permalink%3D%22https%3A%2F%2Fi.test%2F#%3Futm_a%3D1%22%3E"></iframe>""", '<p data-backfill-embed="instagram">Embedded media: <a href="https://i.test/#">View on Instagram</a></p>'),
    ("""<div data-component-name="EmbeddedPostToDOM" data-attrs='{"url": "javascript:#", "title": "T"}'></div>""", ""),
)


@query(f"SELECT page_id, {sql_chosen(*(want for _, want in EMBEDS))} AS embed FROM pages")
def embeds_rewritten(spark, sf):
    """What each kind of embed becomes; one with an address that is none stays as it is."""
    rows = written(spark, sf, *(f"<div class='content'><p>before</p>{markup}<p>after</p></div>" for markup, _ in EMBEDS))
    got = articles.extracted(rows, ArticleConfig(content_selector="div.content"))
    return got.select("page_id", F.regexp_extract("content", "(?s)(<p data-backfill-embed.*?</p>)", 1).alias("embed"))


@query(f"""SELECT page_id, {sql_chosen('Open #', 'Head #', 'Listed #', 'Listed #')} AS title, {sql_chosen('2026-05-01 10:00:00', '2026-01-02 00:00:00', '2020-01-01 00:00:00', '2020-01-01 00:00:00')} AS published, {sql_chosen('', '', '', 'FetchError')} AS error_class FROM pages""")
def article_titles_and_dates(spark, sf):
    """Titles and dates as pages give them, or as listed; every fourth page is not in the store."""
    store = written(spark, sf, '<meta property="og:title" content="Open #"><meta property="article:published_time" content="2026-05-01T10:00:00Z"><article>Body #</article>', '<h1>Head  #</h1><time datetime="2026-01-02">x</time><article>Body #</article>', '<title>Page #</title><article>Body #</article>', "")
    listed = F.col("page_id") % 4 >= 2
    refs = store.select("page_id", "url", F.when(listed, numbered("Listed #")).otherwise("").alias("title"), F.when(listed, F.to_timestamp(F.lit("2020-01-01"))).alias("published_at"))
    got = articles.articles(refs, store.where("page_id % 4 < 3").select("url", "html"))
    return got.select("page_id", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "error_class")


@query("SELECT 'https://x.test/p/' || page_id AS url, 'div.bb-long' AS selector, page_id % 3 + 1 AS n FROM pages WHERE page_id % 3 > 0")
def page_containers(spark, sf):
    """Boxes that hold a link and come twice, by their longest class."""
    box = "<div class='a bb-long'><a href='/p/x'>One</a></div>"
    rows = written(spark, sf, *("<div class='none'><p class='c'>no link</p></div><li class='once'><a href='/q'>q</a></li>" + box * k for k in (1, 2, 3)))
    return probe.container_histogram(probe.containers(rows), ["url"])


@query(f"""SELECT 'https://x.test/p/' || page_id AS url, {sql_chosen('{"datetime": "2026-01-0#", "text": "Jan #"}', '')} AS times, {sql_chosen('{"type": "application/rss+xml", "href": "https://x.test/feed/#"}', '')} AS feeds FROM pages""")
def page_times_and_feeds(spark, sf):
    rows = written(spark, sf, '<link rel="alternate" type="application/rss+xml" href="/feed/#"><link rel="alternate" type="text/html" href="/x"><time datetime="2026-01-0#"> Jan  # </time>', "<p>none</p>")
    return probe.times_and_feeds(rows).select("url", F.array_join("times", "|").alias("times"), F.array_join("feeds", "|").alias("feeds"))


@query("SELECT CAST(page_id AS INTEGER) AS page_no, CAST(pos AS INTEGER) AS pos, 'https://x.test/' || page_id || '/' || pos AS url, 'T ' || page_id AS title, CASE WHEN pos = 0 THEN '2026-01-01' END AS date_raw FROM pages, (VALUES (0), (1)) AS v(pos) WHERE page_id % 2 = 0")
def json_listing(spark, sf):
    """Items at a dotted path; a path that leads to no array gives none, and a date counts only as a string."""
    one = '{"link": {"u": "https://x.test/#/%d"}, "t": " T # ", "d": %s}'
    payload = chosen('{"data": {"posts": [' + one % (0, '"2026-01-01"') + ", " + one % (1, "5") + "]}}", '{"data": {"posts": {"u": "#"}}}')
    rows = pages(spark, sf).select(F.lit(0).alias("source_index"), F.col("page_id").cast("int").alias("page_no"), payload.alias("payload"))
    return listing.json_items(rows, "data.posts", {"url": "link.u", "title": "t", "date": "d"}).select("page_no", "pos", "url", "title", "date_raw")


@query("SELECT CAST(page_id AS INTEGER) AS page_no, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'https://x.test/s/' || page_id ELSE 'https://y.test/' || page_id END AS url, CASE pos WHEN 0 THEN 'One ' || page_id ELSE 'Two' END AS title, CASE pos WHEN 0 THEN '2026-01-02' ELSE '' END AS date_raw FROM pages, (VALUES (0), (1)) AS v(pos) WHERE page_id % 2 = 0")
def html_listing(spark, sf):
    """Items by a selector; a field is a selector, or a selector's attribute, and addresses are made whole."""
    html = chosen('<article class="post"><a href="/s/#">One  #</a><time datetime="2026-01-02">x</time></article><article class="post"><a href="https://y.test/#">Two</a></article><article><a href="/z">no</a></article>', "<p>none</p>")
    rows = pages(spark, sf).select(F.lit(0).alias("source_index"), F.col("page_id").cast("int").alias("page_no"), F.lit("https://x.test/all").alias("url"), html.alias("payload"))
    return articles.html_items(rows, "article.post", {"url": {"selector": "a", "attr": "href"}, "title": "a", "date": {"selector": "time", "attr": "datetime"}}).select("page_no", "pos", "url", "title", "date_raw")


@query(f"SELECT 'https://x.test/p/' || page_id AS url, {sql_chosen('https://x.test/p/#?page=#', 'https://y.test/#', None)} AS next_url FROM pages")
def next_page_links(spark, sf):
    return articles.next_links(written(spark, sf, '<a class="next" href="?page=#">more</a>', '<a href="/no">n</a><a class="b next" href="https://y.test/#">more</a>', '<a class="prev" href="?page=#">less</a>'), "a.next")


@query(f"""SELECT page_id, 'https://a.test/p?b=' || page_id AS clean, 'https://a.test/x/q?z=' || page_id AS joined, 'a b/' || page_id || '+' AS decoded, {sql_chosen('https://www.youtube.com/watch?v=abc_DEF-#', 'https://www.youtube.com/watch?v=abc_DEF-#&t=1m+2s', None)} AS video,
{sql_chosen('A #|B', '')} AS names, {sql_chosen('a|b#', '')} AS keys, '2026-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS day, {sql_chosen('{"b#": 1, "a": 2}', '{}')} AS object FROM pages""")
def address_and_json_scalars(spark, sf):
    """Scalar functions on addresses and payloads."""
    day = F.date_add(F.to_date(F.lit("2026-03-01")), (F.col("page_id") % 28).cast("int"))
    made = {
        "clean": numbered("https://a.test/p?utm_source=x&b=#&UTM_y=2"), "base": numbered("https://a.test/x/#/y"), "ref": numbered("../q?z=#"), "escaped": numbered("a%20b%2F#+"), "id": chosen("abc_DEF-#", "abc_DEF-#", "no id #"), "at": chosen("", "1m 2s", "3"),
        "people": chosen('{"bylines": [{"name": "A #"}, 3, {"name": "B"}]}', '{"bylines": 7}'), "object": chosen('{"b#": 1, "a": 2}', "[1]"), "day": day,
    }
    rows = pages(spark, sf).select("page_id", *[c.alias(n) for n, c in made.items()])
    return rows.select(
        "page_id", text.clean_url("clean").alias("clean"), text.joined_url("base", "ref").alias("joined"), text.percent_decoded("escaped").alias("decoded"), text.video_link("id", "at").alias("video"), F.array_join(jsonpath.byline_names("people"), "|").alias("names"),
        F.array_join(jsonpath.object_keys("object"), "|").alias("keys"), iso_date("day").alias("day"), jsonpath.object_or_empty("object").alias("object"),
    )


@query("SELECT CAST(k + 1 AS BIGINT) AS run_id, 'L' || k AS label_name, '2024-01-01' AS started_at, CASE WHEN k < 2 THEN '2024-01-02' END AS completed_at, CASE WHEN k < 2 THEN count(*) ELSE 0 END AS articles_listed, CASE WHEN k < 2 THEN count(*) FILTER (page_id % 4 = 0) ELSE 0 END AS articles_held, k = 1 AS dry_run FROM pages, (VALUES (0), (1), (2)) AS v(k) GROUP BY k")
def run_audit(spark, sf):
    """Three runs, of which two are closed with what they counted."""
    store = state.StateStore(spark, scratch(spark, "audit"))
    n = pages(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("page_id") % 4 == 0).alias("held")).first()
    for k in range(3):
        run_id = store.start_run(f"L{k}", "2024-01-01", dry_run=k == 1)
        if k < 2:
            store.complete_run(run_id, "2024-01-02", n.n, n.held, 0, 0)
    return store.read("runs").select("run_id", "label_name", "started_at", "completed_at", "articles_listed", "articles_held", "dry_run")


@query("SELECT m.label_name, CASE WHEN m.label_id = '' THEN 'no label id' WHEN n IS NULL THEN 'no messages held' ELSE '' END AS problem, coalesce(n, 0) AS n_held FROM (SELECT DISTINCT 'of ' || source AS label_name, CASE source WHEN 'src1' THEN '' WHEN 'src2' THEN 'gone' ELSE source END AS label_id FROM documents WHERE source IS NOT NULL) m LEFT JOIN (SELECT source AS label_id, count(*) AS n FROM documents GROUP BY source) USING (label_id)")
def validated_mappings(spark, sf):
    """Mappings without a label id, with a stale one, and with messages."""
    d = documents(spark, sf).where("source is not null")
    label_id = F.when(F.col("source") == "src1", "").when(F.col("source") == "src2", "gone").otherwise(F.col("source"))
    mappings = d.select(F.concat(F.lit("of "), "source").alias("label_name"), label_id.alias("label_id")).distinct()
    return pipeline.validate(mappings, d.select(F.col("doc_id").cast("string").alias("message_id"), F.col("source").alias("label_id")))


@query("SELECT page_id, greatest(0, (SELECT count(*) FROM pages) - 40) AS more FROM pages ORDER BY page_id DESC LIMIT 40")
def report_preview(spark, sf):
    """The first rows of a report, and how many more there are."""
    shown, more = status.preview(pages(spark, sf).select("page_id"), [F.col("page_id").desc()])
    return shown.withColumn("more", F.lit(more).cast("long"))
