"""One query for each operator family, on the standing tables, with DuckDB's SQL where SQL can express it.

``pages`` are the archive's listing and the page store, ``documents`` the held
corpus (its subject is the leading text, its label the source, its order the
id), ``labels`` the bridge, ``events`` status rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.functions import jsonpath, text
from docweir.functions.dates import parsed_date
from docweir.operators import articles, linkage, listing, probe, prune, render, state, status
from docweir.sources.durable import durable, scratch
from docweir.sources.tables import parquet

PAGE_ITEMS, SUBJECT = 25, 60
NOW = "2024-02-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- shared inputs, and the same in SQL ---


def documents(spark, sf):
    return parquet(spark, sf, "documents")


def pages(spark, sf):
    return parquet(spark, sf, "pages")


def events(spark, sf):
    return parquet(spark, sf, "events")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Listing items of ``pages``: ``(ord, page_no, source_index, url, title)``."""
    title = text.collapsed(text.html_unescaped(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)))
    return pages(spark, sf).select(F.col("page_id").alias("ord"), F.floor(F.col("page_id") / PAGE_ITEMS).cast("int").alias("page_no"), F.lit(0).alias("source_index"), "url", title.alias("title"))


def held(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").alias("message_id"), F.left("text", F.lit(SUBJECT)).alias("subject"), F.col("doc_id").alias("corpus_ord"))


def known(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).where("page_id % 5 = 0").select(text.canonical_url("url").alias("canonical"))


_U = r"regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '[\t\r\n]', '', 'g')"
_R = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def canon_sql(url: str = "url") -> str:
    u = _U.replace("url", url)
    part = lambda k: f"regexp_extract({u}, '{_R}', {k})"
    return f"(CASE WHEN {part(1)} <> '' THEN lower({part(1)}) || ':' ELSE '' END || CASE WHEN {part(2)} <> '' THEN '//' || lower({part(2)}) ELSE '' END || coalesce(nullif(regexp_replace({part(3)}, '/+$', ''), ''), '/'))"


def key_sql(title: str) -> str:
    t = rf"translate(regexp_replace(coalesce({title}, ''), '^(\s*(re|fwd?|fw)\s*:\s*)+', '', 'i'), '{text.DASHES}', '-------')"
    return rf"left(trim(regexp_replace(regexp_replace(lower(strip_accents({t})), '[^a-z0-9\s-]', '', 'g'), '[\s-]+', '-', 'g'), '-'), 200)"


_UNESCAPED = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_a}', '{_b}')"
ITEMS = rf"items AS (SELECT page_id AS ord, CAST(page_id // {PAGE_ITEMS} AS INTEGER) AS page_no, url, trim(regexp_replace({_UNESCAPED}, '\s+', ' ', 'g')) AS title FROM pages)"
KEYED = f"{ITEMS}, keyed AS (SELECT *, {canon_sql()} AS url_key, {key_sql('title')} AS title_key FROM items)"
FIRST = f"{KEYED}, urls AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY ord) = 1)"
INDEX = f"idx AS (SELECT key, doc_id AS message_id FROM (SELECT {key_sql(f'left(text, {SUBJECT})')} AS key, doc_id FROM documents) WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1)"
REFS = f"{KEYED}, refs AS (SELECT ord, url, title, url_key AS canonical, title_key AS probe_title, regexp_extract(url_key, '[^/]*$') AS probe_slug FROM keyed), {INDEX}, known AS (SELECT DISTINCT {canon_sql()} AS canonical FROM pages WHERE page_id % 5 = 0)"
PREFIX = f"""probes AS (SELECT ord, 0 AS rank, probe_title AS probe FROM refs UNION ALL SELECT ord, 1, probe_slug FROM refs),
prefixes AS (SELECT ord, probe, key, message_id FROM probes JOIN idx ON length(probe) >= {text.MIN_PROBE} AND (starts_with(probe, key) OR starts_with(key, probe))
    QUALIFY row_number() OVER (PARTITION BY ord ORDER BY rank, message_id) = 1)"""
CLASSIFIED = f"""{REFS}, {PREFIX}, entries AS (
SELECT r.ord, r.url, r.title, 'web-' || left(sha256(r.canonical), 16) AS article_id,
    CASE WHEN k.canonical IS NOT NULL THEN 'already backfilled'
         WHEN e.key IS NOT NULL THEN 'exact title match: ''' || e.key || ''' → ' || e.message_id
         WHEN p.key IS NOT NULL THEN 'prefix match: ''' || p.probe || ''' ~ ''' || p.key || ''' → ' || p.message_id ELSE '' END AS match_reason
FROM refs r LEFT JOIN known k USING (canonical) LEFT JOIN idx e ON e.key = r.probe_title LEFT JOIN prefixes p ON p.ord = r.ord)"""


# --- status ---

_STATUS = "CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'converted' ELSE 'fetched' END"


def message_rows(spark, sf):
    """Messages with a status: unlabelled ones are pending."""
    d, b = documents(spark, sf), parquet(spark, sf, "labels").withColumnRenamed("doc_id", "l_id")
    s = F.when(F.col("l_id").isNull(), "pending").when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "converted").otherwise("fetched")
    return d.join(b, d.doc_id == b.l_id, "left").select("doc_id", F.col("source").alias("label_name"), s.alias("status"))


@query("SELECT event_type AS status, count(*) AS cnt FROM events GROUP BY 1")
def status_counts(spark, sf):
    return status.count_by_status(events(spark, sf).select(F.col("event_type").alias("status")))


@query(f"SELECT d.source AS label_name, {_STATUS} AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2")
def status_counts_by_label(spark, sf):
    return message_rows(spark, sf).groupBy("label_name", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS cnt FROM documents")
def total_rows(spark, sf):
    return status.total(documents(spark, sf))


@query(f"SELECT label_name, {', '.join(f'count(*) FILTER (status = {s!r}) AS {s}' for s in status.SHOWN)}, count(*) AS total FROM (SELECT d.source AS label_name, {_STATUS} AS status FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1")
def status_pivot(spark, sf):
    return status.status_row(message_rows(spark, sf), ["label_name"])


@query(f"SELECT label_name, string_agg(status || '=' || n, ', ' ORDER BY status || '=' || n) AS summary FROM (SELECT d.source AS label_name, {_STATUS} AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2) GROUP BY 1")
def status_summary_text(spark, sf):
    return status.summary_text(status_counts_by_label(spark, sf), ["label_name"])


@query(f"SELECT d.doc_id AS message_id, left(d.text, {SUBJECT}) AS subject, d.n_chars AS date FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def messages_for_label(spark, sf):
    m = documents(spark, sf).select(F.col("doc_id").alias("message_id"), F.left("text", F.lit(SUBJECT)).alias("subject"), F.col("n_chars").alias("date"))
    return status.messages_for_label(m, parquet(spark, sf, "labels").withColumnRenamed("doc_id", "message_id"), F.col("toxic") == 1)


@query("SELECT d.doc_id AS label_id, l.quality AS label_name, d.source AS history_id, d.n_chars AS updated_at FROM documents d LEFT JOIN labels l USING (doc_id)")
def sync_state_left_join(spark, sf):
    sync = documents(spark, sf).select(F.col("doc_id").alias("label_id"), F.col("source").alias("history_id"), F.col("n_chars").alias("updated_at"))
    return status.sync_states(sync, parquet(spark, sf, "labels").select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label_name")))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_topk(spark, sf):
    return status.recent(events(spark, sf), "ts", "event_id").select("event_id", "event_type", "user_id")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_run_per_key(spark, sf):
    return status.latest(events(spark, sf).select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_date, count(*) AS n FROM events GROUP BY 1")
def sender_timeline(spark, sf):
    return status.timeline(events(spark, sf).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("d")), "user_id", "d")


@query("SELECT DISTINCT source AS label_id, 'Name of ' || source AS label_name FROM documents WHERE contains(lower(source), 'c1')")
def label_filter(spark, sf):
    return status.label_filter(documents(spark, sf).select(F.col("source").alias("label_id"), F.concat(F.lit("Name of "), "source").alias("label_name")).distinct(), " C1 ")


@query("SELECT DISTINCT d.source AS label_id, d.source AS label_name, d.source IN (SELECT d2.source FROM documents d2 JOIN labels l ON l.doc_id = d2.doc_id WHERE l.toxic = 1) AS selected FROM documents d")
def selected_labels(spark, sf):
    all_labels = documents(spark, sf).select(F.col("source").alias("label_id"), F.col("source").alias("label_name")).distinct()
    toxic = parquet(spark, sf, "labels").where("toxic = 1").join(documents(spark, sf), "doc_id").select(F.col("source").alias("label_id"))
    return status.selected(all_labels, toxic)


@query("WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events GROUP BY 1) SELECT user_id, array_to_string(list_sort(CASE WHEN list_contains(s, 'error') THEN list_filter(s, lambda x: x <> 'error') ELSE list_append(s, 'error') END), ',') AS selection FROM s")
def selection_toggle(spark, sf):
    sets = events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    return sets.select("user_id", F.array_join(F.array_sort(status.toggled(F.col("s"), F.lit("error"))), ",").alias("selection"))


# --- functions ---


@query(f"SELECT page_id, {canon_sql()} AS canonical FROM pages")
def canonical_urls(spark, sf):
    return pages(spark, sf).select("page_id", text.canonical_url("url").alias("canonical"))


@query(f"SELECT page_id, 'web-' || left(sha256({canon_sql()}), 16) AS article_id, true AS own FROM pages")
def article_ids(spark, sf):
    ids = pages(spark, sf).select("page_id", text.article_id("url").alias("article_id"))
    return ids.withColumn("own", text.is_own_id("article_id"))


@query(f"SELECT page_id, regexp_extract({canon_sql()}, '[^/]*$') AS slug, regexp_replace(url, '[?#].*$', '') AS clean, lower(regexp_replace(url, '/+$', '')) AS archive FROM pages")
def url_slugs(spark, sf):
    return pages(spark, sf).select("page_id", text.url_slug("url").alias("slug"), text.without_query("url").alias("clean"), text.archive_key("url").alias("archive"))


@query(f"WITH {ITEMS} SELECT 'p' AS kind, ord AS id, {key_sql('title')} AS key FROM items UNION ALL SELECT 'd', doc_id, {key_sql(f'left(text, {SUBJECT})')} FROM documents")
def title_keys(spark, sf):
    a = items(spark, sf).select(F.lit("p").alias("kind"), F.col("ord").alias("id"), text.title_key("title").alias("key"))
    return a.unionByName(held(spark, sf).select(F.lit("d").alias("kind"), F.col("message_id").alias("id"), text.title_key("subject").alias("key")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS missing, to_json(json_keys(props)) AS keys FROM events")
def json_field_projection(spark, sf):
    return events(spark, sf).select("event_id", jsonpath.dotted_value("props", "k").alias("k"), jsonpath.dotted_value("props", "none").alias("missing"), F.to_json(jsonpath.object_keys("props")).alias("keys"))


_STAMPS = (("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("d MMM yyyy HH:mm:ss '+0200'", "%-d %b %Y %H:%M:%S +0200"), ("MMMM d, yyyy", "%B %-d, %Y"), ("d MMM yyyy", "%-d %b %Y"), ("'on' yyyy", "on %Y"))


@query(
    "SELECT event_id, strftime(CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS published FROM events"
)
def parse_dates(spark, sf):
    rendered = F.lit(None).cast("string")
    for i, (p, _) in enumerate(_STAMPS):
        rendered = F.when(F.col("event_id") % 6 == i, F.date_format("ts", p)).otherwise(rendered)
    return events(spark, sf).select("event_id", F.date_format(parsed_date(rendered), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN lang WHEN doc_id % 4 = 2 THEN lang || ' and ' || source ELSE lang || ', ' || source || ' and x y' END AS names,
replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped, left(text, 10) AS shown FROM documents""")
def scalar_strings(spark, sf):
    n = F.col("doc_id") % 4
    names = F.when(n == 0, F.array(F.lit(" "))).when(n == 1, F.array("lang")).when(n == 2, F.array("lang", F.lit(""), "source")).otherwise(F.array("lang", "source", F.lit(" x  y ")))
    return documents(spark, sf).select("doc_id", text.joined_names(names).alias("names"), text.html_escaped("text").alias("escaped"), F.left("text", F.lit(10)).alias("shown"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS parts FROM documents")
def comma_lists(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(text.comma_list("text"), "|").alias("parts"))


# --- listing ---


@query(f"WITH {ITEMS} SELECT ord, page_no, url, title FROM items WHERE url <> ''")
def listing_items(spark, sf):
    return items(spark, sf).where("url <> ''").select("ord", "page_no", "url", "title")


@query(f"WITH {FIRST} SELECT ord, url, title, url_key FROM urls WHERE title_key = '' UNION ALL SELECT ord, url, title, url_key FROM (SELECT * FROM urls WHERE title_key <> '' QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY ord) = 1)")
def dedupe_url_then_title(spark, sf):
    return listing.deduplicated(listing.with_keys(items(spark, sf))).select("ord", "url", "title", "url_key")


@query(f"WITH {FIRST}, c AS (SELECT page_no, CAST(sum(CASE WHEN ord IN (SELECT ord FROM urls) THEN 1 ELSE 0 END) AS BIGINT) AS new_count FROM keyed GROUP BY 1) SELECT page_no, new_count FROM c WHERE page_no < coalesce((SELECT min(page_no) FROM c WHERE new_count = 0), 1000000000)")
def pagination_guard(spark, sf):
    rows = items(spark, sf)
    return listing.pages_read(listing.new_on_page(rows, listing.with_keys(rows))).select("page_no", "new_count")


_SITE = "regexp_extract(url, '^https?://[^/?#]+')"


@query(f"""SELECT CAST(page_id AS INTEGER) AS source_index, CAST(p AS INTEGER) AS page_no, {_SITE} || CASE page_id % 3 WHEN 0 THEN '/all' WHEN 1 THEN '/a?o=' || (page_id % 7 + p * (page_id % 40 + 10)) || '&n=' || (page_id % 40 + 10) ELSE '/p/' || (page_id % 7 + p) END AS url
FROM pages, range(20) r(p) WHERE CASE WHEN page_id % 3 = 0 THEN p = 0 ELSE p < page_id % 21 END""")
def page_urls(spark, sf):
    """Each page's site as an archive, with paging by offset, by number or none."""
    site, n = F.regexp_extract("url", "^https?://[^/?#]+", 0), F.col("page_id").cast("int")
    kind = lambda *of: F.element_at(F.array(*map(F.lit, of)), n % 3 + 1)
    config = pages(spark, sf).select(n.alias("source_index"), F.concat(site, kind("/all", "/a?o={offset}&n={limit}", "/p/{page}")).alias("url_template"), kind("none", "offset", "page").alias("type"), (n % 40 + 10).alias("page_size"), (n % 7).alias("start"), (n % 21).alias("max_pages"))
    return listing.page_urls(config)


@query(f"""SELECT page_id AS page_no, pos - 1 AS pos, {_SITE} || regexp_extract(item, 'href="([^"]*)"', 1) AS url, trim(regexp_replace(regexp_extract(item, '>([^<]*)</a>', 1), '\\s+', ' ', 'g')) AS title
FROM (SELECT page_id, url, unnest(i) AS item, CAST(generate_subscripts(i, 1) AS INTEGER) AS pos FROM (SELECT CAST(page_id AS INTEGER) AS page_id, url, regexp_extract_all(html, '<li>(<a href="[^"]*">[^<]*</a>)</li>', 1) AS i FROM pages))""")
def navigation_items(spark, sf):
    """The links in the lists of the given pages, as a listing's items."""
    rows = pages(spark, sf).select(F.lit(0).alias("source_index"), F.col("page_id").cast("int").alias("page_no"), "url", F.col("html").alias("payload"))
    return articles.html_items(rows, "nav li", {"url": {"selector": "a", "attr": "href"}, "title": "a"}).select("page_no", "pos", "url", "title")


_BARE, _QUERY = "regexp_replace(url, '[?#].*$', '')", "regexp_extract(url, '\\?([^#]*)', 1)"
_KEPT = f"list_filter(string_split({_QUERY}, '&'), lambda x: NOT starts_with(lower(x), 'utm_'))"


@query(f"""SELECT page_id, CASE WHEN regexp_matches({_QUERY}, '(?i)(^|&)utm_') THEN {_BARE} || CASE WHEN len({_KEPT}) > 0 THEN '?' ELSE '' END || array_to_string({_KEPT}, '&') || regexp_extract(url, '#.*$') ELSE url END AS clean,
{_SITE} || '/archive?sort=new' AS archive, regexp_replace({_BARE}, '[^/]*$', '') || 'next#top' AS beside FROM pages""")
def page_addresses(spark, sf):
    """The given addresses without tracking parameters, and references resolved against them."""
    return pages(spark, sf).select("page_id", text.clean_url("url").alias("clean"), text.joined_url("url", F.lit("/archive?sort=new")).alias("archive"), text.joined_url("url", F.lit("next#top")).alias("beside"))


@query(f"WITH {ITEMS}, n AS (SELECT page_no, count(*) AS n_items FROM items GROUP BY 1) SELECT page_no, n_items, CAST(10 + coalesce(sum(n_items) OVER (ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n")
def running_offsets(spark, sf):
    n = items(spark, sf).groupBy("source_index", "page_no").agg(F.count(F.lit(1)).alias("n_items"))
    return listing.running_offsets(n, 10).select("page_no", "n_items", "offset")


_HALF = f"{KEYED}, src AS (SELECT *, CAST(ord % 2 AS INTEGER) AS s FROM keyed)"
_FOLD = f"""{_HALF}, u AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY s, ord) = 1),
kept AS (SELECT * FROM u WHERE title_key = '' UNION ALL SELECT * FROM (SELECT * FROM u WHERE title_key <> '' QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY s, ord) = 1))"""


@query(f"WITH {_FOLD} SELECT s AS source_index, count(*) AS n FROM kept GROUP BY 1")
def source_contributions(spark, sf):
    return listing.contributions(multi_source_listing(spark, sf))


@query(f"WITH {_FOLD} SELECT s AS source_index, url FROM kept")
def multi_source_listing(spark, sf):
    """Pages with even and with odd ids as two archives, each one page."""
    rows = items(spark, sf)
    halves = [rows.where(F.col("ord") % 2 == k).select(F.lit(0).alias("page_no"), F.col("ord").alias("pos"), "url", "title") for k in (0, 1)]
    return listing.read_listing([(h.select("page_no").distinct(), h) for h in halves]).select("source_index", "url")


@query(f"WITH {_FOLD} SELECT s AS source_index, url FROM kept ORDER BY s, ord LIMIT 100")
def listing_limit(spark, sf):
    rows = items(spark, sf)
    halves = [rows.where(F.col("ord") % 2 == k).select(F.lit(0).alias("page_no"), F.col("ord").alias("pos"), "url", "title") for k in (0, 1)]
    return listing.read_listing([(h.select("page_no").distinct(), h) for h in halves], limit=100).select("source_index", "url")


@query(f"WITH {KEYED} SELECT count(DISTINCT url_key) FILTER (ord % 2 = 0) AS page_1_count, count(DISTINCT url_key) FILTER (ord % 2 = 1) AS page_2_count, (SELECT count(*) FROM (SELECT url_key FROM keyed WHERE ord % 2 = 1 EXCEPT SELECT url_key FROM keyed WHERE ord % 2 = 0)) AS new_on_page_2, (SELECT count(*) FROM (SELECT url_key FROM keyed WHERE ord % 2 = 1 EXCEPT SELECT url_key FROM keyed WHERE ord % 2 = 0)) > 0 AS paginates FROM keyed")
def new_on_page_2(spark, sf):
    keyed = pages(spark, sf).select("page_id", text.canonical_url("url").alias("href"))
    return probe.paginates(keyed.where("page_id % 2 = 0"), keyed.where("page_id % 2 = 1"))


@query(f"SELECT DISTINCT {canon_sql()} AS canonical FROM pages WHERE page_id % 2 = 1 EXCEPT SELECT {canon_sql()} FROM pages WHERE page_id % 5 = 0")
def set_difference(spark, sf):
    return pages(spark, sf).where("page_id % 2 = 1").select(text.canonical_url("url").alias("canonical")).subtract(known(spark, sf))


@query("WITH RECURSIVE w(step, node) AS (SELECT 0, CAST(0 AS BIGINT) UNION ALL SELECT step + 1, node + 1 FROM w WHERE step + 1 < 40 AND node + 1 < (SELECT count(*) FROM pages)) SELECT step, node FROM w")
def next_link_walk(spark, sf):
    p = pages(spark, sf)
    ids = p.select(F.col("page_id").alias("node"))
    edges = ids.join(ids.select((F.col("node") - 1).alias("node"), F.col("node").alias("next_node")), "node", "left")
    return listing.reachable(edges, 0, 40)


@query("WITH RECURSIVE edges AS (SELECT p.page_id AS a, (p.page_id + length(p.url) + length(p.html)) % (SELECT count(*) FROM pages) AS b FROM pages p), w(s, step, node, seen) AS (SELECT CAST(i AS INTEGER), 0, CAST(i AS BIGINT), [CAST(i AS BIGINT)] FROM range(3) t(i) UNION ALL SELECT s, step + 1, b, list_append(seen, b) FROM w JOIN edges ON a = node WHERE step + 1 < 100 AND NOT list_contains(seen, b)) SELECT s AS source_index, step, CAST(node AS VARCHAR) AS url FROM w")
def listing_walks(spark, sf):
    """Three walks at once, each page leading to another by the lengths of its address and markup, until one comes again."""
    p = pages(spark, sf).withColumn("n", F.lit(pages(spark, sf).count()))
    edges = p.select(F.explode(F.array(*map(F.lit, range(3)))).alias("source_index"), F.col("page_id").cast("string").alias("url"), F.pmod(F.col("page_id") + F.length("url") + F.length("html"), "n").cast("string").alias("next_url"))
    starts = p.where("page_id < 3").select(F.col("page_id").cast("int").alias("source_index"), F.col("page_id").cast("string").alias("url"))
    return listing.walked(edges, starts, 100)


@query(f"SELECT url_key, n FROM (SELECT {canon_sql()} AS url_key, count(*) AS n FROM pages GROUP BY 1) WHERE n > 1")
def duplicate_urls(spark, sf):
    return pages(spark, sf).groupBy(text.canonical_url("url").alias("url_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# --- linkage ---


@query(f"WITH {INDEX} SELECT key, message_id FROM idx")
def first_writer_index(spark, sf):
    return linkage.corpus_index(held(spark, sf)).select("key", "message_id")


@query(f"WITH {REFS} SELECT ord, url FROM refs WHERE canonical IN (SELECT canonical FROM known)")
def known_url_semi(spark, sf):
    return linkage.known_urls(linkage.keyed_refs(items(spark, sf)), known(spark, sf)).select("ord", "url")


@query(f"WITH {REFS} SELECT ord, key, message_id FROM refs JOIN idx ON key = probe_title")
def exact_title_match(spark, sf):
    return linkage.exact_matches(linkage.keyed_refs(items(spark, sf)), linkage.corpus_index(held(spark, sf)))


@query(f"WITH {REFS}, {PREFIX} SELECT ord, probe, key, message_id FROM prefixes")
def prefix_match(spark, sf):
    return linkage.prefix_matches(linkage.keyed_refs(items(spark, sf)), linkage.corpus_index(held(spark, sf)))


@query()
def fuzzy_match(spark, sf):
    """The ratio's order of arguments and its handling of frequent characters have no SQL; tested against the standard library."""
    found = linkage.fuzzy_matches(durable(linkage.keyed_refs(items(spark, sf))), durable(linkage.corpus_index(held(spark, sf))))
    return found.select("ord", "key", "message_id", F.round("ratio", 9).alias("ratio"))


@query(f"WITH {CLASSIFIED} SELECT ord, CASE WHEN match_reason LIKE 'already%' THEN 'known' WHEN match_reason LIKE 'exact%' THEN 'exact' WHEN match_reason LIKE 'prefix%' THEN 'prefix' ELSE 'none' END AS rule FROM entries")
def rule_precedence(spark, sf):
    rule = F.when(F.col("match_reason") == "", "none").when(F.startswith("match_reason", F.lit("already")), "known").otherwise(F.substring_index("match_reason", " ", 1))
    return classify_scan(spark, sf).select("ord", rule.alias("rule"))


@query(f"WITH {CLASSIFIED} SELECT ord, url, title, article_id, CASE WHEN match_reason = '' THEN 'discovered' ELSE 'have' END AS status, match_reason FROM entries")
def classify_scan(spark, sf):
    return linkage.classify(items(spark, sf), linkage.corpus_index(held(spark, sf)), known(spark, sf), fuzzy=False)


@query()
def classify_fuzzy(spark, sf):
    """The whole chain, with the similarity rule at its end."""
    return linkage.classify(items(spark, sf), linkage.corpus_index(held(spark, sf)), known(spark, sf))


@query(f"WITH {CLASSIFIED} SELECT count(*) AS listed, count(*) FILTER (match_reason <> '') AS held, count(*) FILTER (match_reason = '') AS missing FROM entries")
def scan_summary(spark, sf):
    return linkage.summary(classify_scan(spark, sf))


@query(f"WITH {CLASSIFIED} SELECT ord, url FROM entries WHERE match_reason = ''")
def missing_anti(spark, sf):
    return classify_scan(spark, sf).where("status = 'discovered'").select("ord", "url")


@query(f"WITH {CLASSIFIED} SELECT ord, url FROM entries WHERE match_reason = '' ORDER BY ord LIMIT 10")
def write_limit(spark, sf):
    return missing_anti(spark, sf).orderBy("ord").limit(10)


_DAY = "CASE WHEN ord % 7 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(length(url) % 28 AS INTEGER) END"


@query(f"WITH {CLASSIFIED} SELECT ord, title, row_number() OVER (ORDER BY match_reason <> '', {_DAY} NULLS FIRST, ord) AS place FROM entries QUALIFY place <= 40")
def scan_display(spark, sf):
    """Dates by the addresses' lengths, every seventh item undated."""
    day = F.when(F.col("ord") % 7 != 0, F.date_add(F.to_date(F.lit("2024-01-01")), (F.length("url") % 28).cast("int")).cast("timestamp"))
    first = linkage.display_order(classify_scan(spark, sf).withColumn("published_at", day)).limit(40)
    keys = [k.alias(f"k{i}") for i, k in enumerate(linkage.display_keys())]
    rows = first.agg(F.array_sort(F.collect_list(F.struct(*keys, "ord", "title"))).alias("r"))
    return rows.select(F.posexplode("r").alias("p", "r")).select("r.ord", "r.title", (F.col("p") + 1).cast("bigint").alias("place"))


# --- state ---

_OLD = "old AS (SELECT 'a' || event_id AS article_id, event_type AS label_name, 'https://x.test/' || event_id AS url, 't' || event_id AS title, CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'have' ELSE 'discovered' END AS status FROM events WHERE event_id % 3 <> 0)"
_NEW = "new AS (SELECT 'a' || event_id AS article_id, 'L' AS label_name, 'https://y.test/' || event_id AS url, 'n' || event_id AS title, CASE event_id % 2 WHEN 0 THEN 'have' ELSE 'discovered' END AS status FROM events WHERE event_id % 2 = 0)"


def state_rows(spark, sf):
    """Articles made of events, of all columns."""
    e = events(spark, sf).where("event_id % 3 <> 0")
    s = F.element_at(F.array(*map(F.lit, ("done", "failed", "have", "discovered"))), (F.col("event_id") % 4 + 1).cast("int"))
    blank = [F.lit("").alias(c) for c in ("label_id", "published_at", "match_reason", "raw_html_path", "markdown_path", "error_message", "created_at", "updated_at")]
    return e.select(F.concat(F.lit("a"), "event_id").alias("article_id"), F.col("event_type").alias("label_name"), F.concat(F.lit("https://x.test/"), "event_id").alias("url"), F.concat(F.lit("t"), "event_id").alias("title"), s.alias("status"), *blank)


def state_updates(spark, sf):
    e = events(spark, sf).where("event_id % 2 = 0")
    return e.select(F.concat(F.lit("a"), "event_id").alias("article_id"), F.lit("L").alias("label_name"), F.concat(F.lit("https://y.test/"), "event_id").alias("url"), F.concat(F.lit("n"), "event_id").alias("title"), F.lit("have").alias("status"), *[F.lit("").alias(c) for c in ("label_id", "published_at", "match_reason")])


@query(f"WITH {_OLD}, {_NEW} SELECT coalesce(o.article_id, n.article_id) AS article_id, coalesce(n.label_name, o.label_name) AS label_name, coalesce(o.url, n.url) AS url, coalesce(n.title, o.title) AS title, CASE WHEN o.status = 'done' OR n.status IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN n.article_id IS NULL THEN '' ELSE '{NOW}' END AS updated_at FROM old o FULL JOIN new n USING (article_id)")
def upsert_sticky_done(spark, sf):
    return state.upserted(state_rows(spark, sf), state_updates(spark, sf), F.lit(NOW)).select("article_id", "label_name", "url", "title", "status", "updated_at")


@query(f"WITH {_OLD}, {_NEW} SELECT article_id, 'done' AS status, '/raw/' || article_id AS raw_html_path FROM old WHERE article_id IN (SELECT article_id FROM new) UNION ALL SELECT article_id, status, '' FROM old WHERE article_id NOT IN (SELECT article_id FROM new)")
def mark_done(spark, sf):
    done = state_updates(spark, sf).select("article_id", F.concat(F.lit("/raw/"), "article_id").alias("raw_html_path"), F.concat(F.lit("/md/"), "article_id").alias("markdown_path"))
    return state.marked_done(state_rows(spark, sf), done, F.lit(NOW)).select("article_id", "status", "raw_html_path")


@query(f"WITH {_OLD}, {_NEW} SELECT article_id, 'failed' AS status, 1000 AS length FROM old WHERE article_id IN (SELECT article_id FROM new) UNION ALL SELECT article_id, status, 0 FROM old WHERE article_id NOT IN (SELECT article_id FROM new)")
def mark_failed(spark, sf):
    failed = state_updates(spark, sf).select("article_id", F.repeat(F.lit("x"), F.lit(1500)).alias("error_message"))
    return state.marked_failed(state_rows(spark, sf), failed, F.lit(NOW)).select("article_id", "status", F.length("error_message").alias("length"))


@query(f"WITH {_OLD}, {_NEW} SELECT article_id, status FROM old WHERE article_id NOT IN (SELECT article_id FROM new)")
def delete_by_ids(spark, sf):
    return state.without_ids(state_rows(spark, sf), state_updates(spark, sf)).select("article_id", "status")


@query(f"WITH {_OLD} SELECT article_id, CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status FROM old")
def retry_failed(spark, sf):
    return state.retried(state_rows(spark, sf)).select("article_id", "status")


@query(f"WITH {_OLD} SELECT url FROM old WHERE status = 'done' AND label_name = 'view'")
def completed_urls(spark, sf):
    return state.completed_urls(state_rows(spark, sf), "view")


@query(f"WITH {_OLD}, m AS (SELECT DISTINCT event_type AS label_name FROM events UNION ALL SELECT 'unused'), c AS (SELECT label_name, status || '=' || count(*) AS p FROM old GROUP BY label_name, status) SELECT m.label_name, coalesce(string_agg(p, ', ' ORDER BY p), 'no runs yet') AS summary FROM m LEFT JOIN c USING (label_name) GROUP BY 1")
def mapping_states(spark, sf):
    labels = events(spark, sf).select(F.col("event_type").alias("label_name")).distinct().unionByName(spark.range(1).select(F.lit("unused").alias("label_name")))
    return status.mapping_states(labels, state_rows(spark, sf))


@query(f"WITH {_OLD} SELECT article_id FROM old WHERE label_name = 'click'")
def articles_for_label(spark, sf):
    return state.articles_for_label(state_rows(spark, sf), "click").select("article_id")


# --- prune ---

_PRUNE = f"""art AS (SELECT page_id, 'web-' || left(sha256({canon_sql()}), 16) AS article_id, 't' || page_id AS title, '2024-01-01' AS published_at, CASE page_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'have' ELSE 'discovered' END AS status FROM pages QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY page_id) = 1),
targets AS (SELECT article_id, title, published_at, status, CASE WHEN page_id % 3 = 0 THEN 'md/t' || page_id || '_' || article_id || '.md|raw/' || article_id || '.html' ELSE '' END AS files, CASE WHEN page_id % 6 = 0 THEN 'L/' || article_id ELSE '' END AS directories FROM art WHERE status <> 'have' OR page_id % 3 = 0)"""


def prune_targets(spark, sf):
    rows = pages(spark, sf).select("page_id", text.article_id("url").alias("article_id")).groupBy("article_id").agg(F.min("page_id").alias("page_id"))
    s = F.element_at(F.array(*map(F.lit, ("done", "failed", "have", "discovered"))), (F.col("page_id") % 4 + 1).cast("int"))
    art = rows.select("article_id", F.concat(F.lit("t"), "page_id").alias("title"), F.lit("2024-01-01 10:00:00").alias("published_at"), s.alias("status"))
    there, folders = rows.where("page_id % 3 = 0"), rows.where("page_id % 6 = 0")
    path = lambda df, *parts, d=False: df.select(F.concat(*parts).alias("path"), F.lit(d).alias("is_dir"))
    paths = path(there, F.lit("md/t"), "page_id", F.lit("_"), "article_id", F.lit(".md")).unionByName(path(there, F.lit("raw/"), "article_id", F.lit(".html"))).unionByName(path(folders, F.lit("L/"), "article_id", d=True))
    return prune.plan(art, paths)


@query(f"WITH {_PRUNE} SELECT * FROM targets")
def prune_plan(spark, sf):
    return prune_targets(spark, sf).withColumn("files", F.array_join("files", "|")).withColumn("directories", F.array_join("directories", "|"))


@query(f"WITH {_PRUNE} SELECT CAST(2 * count(*) FILTER (files <> '') AS BIGINT) AS files_removed, CAST(count(*) FILTER (directories <> '') AS BIGINT) AS directories_removed, count(*) AS rows_removed FROM targets")
def prune_totals(spark, sf):
    return prune.totals(prune_targets(spark, sf))


# --- probe ---

_HREFS = """hrefs AS (SELECT page_id, pos, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="/([^"/?#]*)"', 1) AS h FROM pages)))"""


@query(f"WITH {_HREFS} SELECT '/{{slug}}' AS pattern, count(*) AS n FROM hrefs WHERE href <> '' AND href NOT IN ({', '.join(map(repr, probe.NAVIGATION))}) HAVING count(*) > 0")
def url_patterns_top10(spark, sf):
    """Shapes of the pages' links; here all lead to the root, so there is one."""
    found = probe.links(pages(spark, sf)).where(F.rlike("href", F.lit(r"^https?://[^/]*/[^/?#]*$")))
    return probe.pattern_histogram(found, [])


@query("SELECT CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(html), '{s.lower()}')" for s in signs) + f" THEN '{name}'" for name, signs in probe.PLATFORMS) + " ELSE 'unknown' END AS platform, count(*) AS n FROM pages GROUP BY 1")
def platform_fingerprint(spark, sf):
    return pages(spark, sf).groupBy(probe.platform(F.col("html")).alias("platform")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'https://' || page_id || '.test' AS url, p AS platform, 'https://' || page_id || '.test' || t AS url_template FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ghost' WHEN 1 THEN 'wordpress' ELSE 'medium' END AS p FROM pages) JOIN (VALUES ('ghost', '/ghost/api/content/posts/?limit={limit}&page={page}'), ('wordpress', '/wp-json/wp/v2/posts?per_page={limit}&page={page}')) AS v(p, t) USING (p)")
def endpoint_templates(spark, sf):
    sign = F.element_at(F.array(*map(F.lit, ("x gh-head y", "WP-Content", "medium.com/_/graphql"))), (F.col("page_id") % 3 + 1).cast("int"))
    return probe.endpoints(pages(spark, sf).select(F.concat(F.lit("https://"), "page_id", F.lit(".test")).alias("url"), sign.alias("html")))


@query()
def link_histogram(spark, sf):
    """Distinct article addresses of each page."""
    return probe.articles_seen(probe.links(pages(spark, sf))).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query()
def container_histogram(spark, sf):
    return probe.container_histogram(probe.containers(pages(spark, sf)), [])


# --- articles and files ---


@query()
def extract_content(spark, sf):
    """Titles, content and errors of all pages."""
    return articles.extracted(pages(spark, sf)).select("page_id", "page_title", "content", "preview", "error")


@query()
def wrap_document(spark, sf):
    got = articles.extracted(pages(spark, sf))
    return got.select("page_id", articles.wrapped(F.col("content"), F.col("url"), F.col("page_title"), F.col("preview")).alias("document"))


@query()
def markdown_documents(spark, sf):
    from docweir.functions.markdown import markdown

    return articles.extracted(pages(spark, sf)).select("page_id", markdown("content").alias("markdown"))


def _rendered(spark, sf):
    d = documents(spark, sf)
    date = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    head = render.front_matter(F.concat(F.lit("m"), "doc_id"), F.left("text", F.lit(SUBJECT)), F.concat(F.lit('"'), "source", F.lit('" <a@b.test>')), date, F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return d.select("doc_id", "source", F.concat(F.lit("dir/some-slug_m"), "doc_id", F.lit(".md")).alias("path"), render.with_keys(F.concat(head, F.lit("\nBody\n")), {"source_url": F.concat(F.lit("https://x.test/"), "doc_id"), "origin": F.lit(render.ORIGIN)}).alias("value"))


_ESC = "replace(replace({}, '\\', '\\\\'), '\"', '\\\"')"


@query(
    f"""SELECT doc_id, '---' || chr(10) || 'id: "m' || doc_id || '"' || chr(10) || 'subject: "' || {_ESC.format(f'left(text, {SUBJECT})')} || '"' || chr(10) || 'from: "\\"' || source || '\\" <a@b.test>"' || chr(10) || 'to: ""' || chr(10)
|| 'date: ' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y-%m-%d %H:%M:%S') || chr(10) || 'labels: ["' || source || '"]' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'label_ids: ["' || lang || '"]' || chr(10) ELSE '' END
|| 'source_url: "https://x.test/' || doc_id || '"' || chr(10) || 'origin: "backfill"' || chr(10) || '---' || chr(10) || chr(10) || 'Body' || chr(10) AS value FROM documents"""
)
def front_matter_render(spark, sf):
    return _rendered(spark, sf).select("doc_id", "value")


#: A subject with a line break loses what follows, and with it the closing quote, so what is left stays as written.
_READ = f"CASE WHEN contains(left(text, {SUBJECT}), chr(10)) THEN trim('\"' || {_ESC.format(f'split_part(left(text, {SUBJECT}), chr(10), 1)')}, ' ') ELSE left(text, {SUBJECT}) END"
_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id)"


@query(f"SELECT 'm' || doc_id AS message_id, {_READ} AS subject, strftime({_AT}, '%Y-%m-%d %H:%M:%S') AS date FROM documents WHERE source = 'src3' AND text <> ''")
def front_matter_parse(spark, sf):
    """Rendered headers read back."""
    return render.held_from_markdown(_rendered(spark, sf), "src3")


@query(
    f"""SELECT 'by id' AS held, key, 'm' || min(doc_id) AS message_id FROM (SELECT doc_id, {key_sql(f'left(text, {SUBJECT})')} AS key FROM documents WHERE source = 'src3') WHERE key <> '' GROUP BY key
UNION ALL SELECT 'by files', key, 'm' || max(doc_id) FROM (SELECT doc_id, {key_sql(_READ)} AS key FROM documents WHERE source = 'src5' AND text <> '') WHERE key <> '' GROUP BY key"""
)
def corpus_index_by_label(spark, sf):
    """The held index of a label whose messages were all found under other labels, and of one whose id is stale, so that its Markdown files count."""
    from docweir.plans import pipeline

    d, files = documents(spark, sf), _rendered(spark, sf).select("path", "value")
    day = F.date_format(F.timestamp_seconds(F.lit(1704067200) - F.col("doc_id") * 86400), "yyyy-MM-dd")
    messages = d.select(F.concat(F.lit("m"), "doc_id").alias("message_id"), F.left("text", F.lit(SUBJECT)).alias("subject"), day.alias("date"), F.col("lang").alias("label_id"))
    bridge = d.select(F.concat(F.lit("m"), "doc_id").alias("message_id"), F.explode(F.array("lang", "source")).alias("label_id"))
    index = lambda label_id, label: pipeline.corpus(pipeline.held_messages(messages, bridge, label_id), files, label).select("key", "message_id")
    by_id, by_files = index("src3", "src3"), index("gone", "src5")
    return by_id.select(F.lit("by id").alias("held"), "*").unionByName(by_files.select(F.lit("by files").alias("held"), "*"))


@query("SELECT p.page_id, p.url, q.html IS NULL AS missing FROM pages p LEFT JOIN (SELECT url, max(html) AS html FROM pages WHERE page_id % 2 = 0 GROUP BY url) q USING (url)")
def page_store_lookup(spark, sf):
    """Pages looked up by address in a store that has every other one."""
    found = articles.with_pages(pages(spark, sf).select("page_id", "url"), pages(spark, sf).where("page_id % 2 = 0"))
    return found.select("page_id", "url", F.col("html").isNull().alias("missing"))


@query("SELECT page_id, coalesce(s.name, p.name) AS name FROM (SELECT page_id, CAST(page_id % 4 - 1 AS INTEGER) AS i FROM pages) LEFT JOIN (VALUES (0, 'primary'), (1, 'second')) AS s(i, name) USING (i), (SELECT 'primary' AS name) p")
def source_lookup(spark, sf):
    """A source by its number; numbers out of range mean the first source."""
    rows = pages(spark, sf).select("page_id", (F.col("page_id") % 4 - 1).cast("int").alias("source_index"))
    sources = pages(spark, sf).where("page_id < 2").select(F.col("page_id").cast("int").alias("source_index"), F.when(F.col("page_id") == 0, "primary").otherwise("second").alias("name"))
    return listing.with_source(rows, sources).select("page_id", "name")


@query(f"WITH {REFS}, {PREFIX}, first AS (SELECT r.*, k.title_key FROM refs r JOIN (SELECT ord, title_key FROM (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY ord) = 1)) k USING (ord)), kept AS (SELECT * FROM first WHERE title_key = '' UNION ALL SELECT * FROM (SELECT * FROM first WHERE title_key <> '' QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY ord) = 1)) SELECT 'web-' || left(sha256(canonical), 16) AS article_id, url, CASE WHEN e.key IS NOT NULL OR p.key IS NOT NULL THEN 'held' ELSE 'open' END AS verdict FROM kept r LEFT JOIN idx e ON e.key = r.probe_title LEFT JOIN prefixes p ON p.ord = r.ord")
def stream_backfill(spark, sf):
    """Pages as a file stream, merged into a state store by :mod:`docweir.streaming.stream`; similar titles count as open here."""
    from docweir.streaming import stream

    folder = scratch(spark, "stream")
    store = state.StateStore(spark, f"{folder}/state")
    arriving = stream.page_stream(spark, f"{sf}/[p]ages.parquet", pages(spark, sf).schema.simpleString()[7:-1].replace(":", " "))
    title = text.collapsed(text.html_unescaped(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)))
    refs = lambda b: b.select(F.col("page_id").alias("ord"), "url", title.alias("title"))
    stream.run(arriving, refs, linkage.corpus_index(held(spark, sf)), store, f"{folder}/checkpoint", "L", lambda: NOW).awaitTermination()
    rule = F.when(F.rlike("match_reason", F.lit("^(exact|prefix)")), "held").otherwise("open")
    return store.read("articles").select("article_id", "url", rule.alias("verdict"))


_H1 = _UNESCAPED.replace("<title>", "<h1>").replace("</title>", "</h1>")


@query(rf"SELECT page_id, trim(regexp_replace({_H1}, '\s+', ' ', 'g')) AS page_title FROM pages")
def page_titles(spark, sf):
    """The title that each page itself gives."""
    return articles.extracted(pages(spark, sf)).select("page_id", "page_title")


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    f"""SELECT doc_id, replace('<!DOCTYPE html>~<html lang="en">~<head>~<meta charset="utf-8">~<meta name="viewport" content="width=device-width, initial-scale=1.0">~<title>', '~', chr(10)) || {_ESCAPED.format(f'left(text, {SUBJECT})')} || replace('</title>~<link rel="canonical" href="https://x.test/?d=', '~', chr(10)) || doc_id
|| replace('">~<style>~{articles.STYLE.replace(chr(10), '~')}</style>~</head>~<body>~<div class="email-body">~<p>', '~', chr(10)) || lang || replace('</p>~', '~', chr(10))
|| CASE WHEN doc_id % 2 = 0 THEN '<p class="backfill-note">Subscriber-only post — this is the public preview. The full text is at <a href="https://x.test/?d=' || doc_id || '">https://x.test/?d=' || doc_id || '</a>.</p>' || chr(10) ELSE '' END || replace('</div>~</body>~</html>~', '~', chr(10)) AS document FROM documents"""
)
def wrapped_documents(spark, sf):
    """The stored document around given content."""
    url = F.concat(F.lit("https://x.test/?d="), "doc_id")
    content = F.concat(F.lit("<p>"), "lang", F.lit("</p>"))
    return documents(spark, sf).select("doc_id", articles.wrapped(content, url, F.left("text", F.lit(SUBJECT)), F.col("doc_id") % 2 == 0).alias("document"))


SQL["link_histogram"] = f"""SELECT url, count(DISTINCT href) AS n
FROM (SELECT url, regexp_replace(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '[?#].*$', '') AS href FROM pages)
WHERE regexp_extract(href, '[^/]*$') NOT IN ('', {', '.join(map(repr, probe.NAVIGATION))}) GROUP BY 1"""


@query("SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 30 OFFSET 70")
def page_of_rows(spark, sf):
    return status.page_of(events(spark, sf), [F.col("ts"), F.col("event_id")], 30, 70).select("event_id", "event_type")


@query("SELECT 'L' || user_id AS label_id, 'h' || max(event_id) AS history_id, lpad(CAST(max(event_id) AS VARCHAR), 12, '0') AS updated_at FROM events GROUP BY 1")
def sync_cursors(spark, sf):
    """Cursors of even events advanced by those of odd ones."""
    rows = events(spark, sf).select("event_id", F.concat(F.lit("L"), "user_id").alias("label_id"), F.concat(F.lit("h"), "event_id").alias("history_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("updated_at"))
    return status.advanced(rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id"))


@query("SELECT 'https://' || page_id || '.test/wp-json/wp/v2/posts?per_page={limit}&page={page}' AS url_template, 'posts' AS items_path, 2 AS item_count, 'link,n,title' AS available_fields FROM pages WHERE page_id % 2 = 0")
def endpoint_listing(spark, sf):
    """Known listings asked in a page table; those of odd pages hold nothing that is a list."""
    site = F.concat(F.lit("https://"), "page_id", F.lit(".test"))
    asked = probe.endpoints(pages(spark, sf).select(site.alias("url"), F.lit("<link href='/wp-content/x.css'>").alias("html")))
    payload = F.when(F.col("page_id") % 2 == 0, '{"total": 2, "posts": [{"title": "a", "link": "b", "n": 1}, {}]}').otherwise('{"posts": 3}')
    store = pages(spark, sf).select(F.concat(site, F.lit("/wp-json/wp/v2/posts?per_page=5&page=1")).alias("url"), payload.alias("payload"))
    return probe.endpoint_items(asked, store).select("url_template", "items_path", "item_count", F.array_join("available_fields", ",").alias("available_fields"))


from . import fixtures  # noqa: E402, F401  registers its queries
