import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweir.functions import dom, embeds, slices
from docweir.functions.markdown import converted, to_markdown
from docweir.operators import articles, probe
from docweir.operators.articles import ArticleConfig

PAGE = """<!DOCTYPE html><html><head><title>Page  title</title><meta property="og:title" content="Open title"><meta property="article:published_time" content="2026-05-01T10:00:00Z"></head>
<body><nav><a href="/home">home</a></nav><div class="content"><p>One <button>Share</button>two <a href="../q?x=1">link</a><br>three<p>four <b>bold
<div class="wrap"><div><span> </span></div></div><figure><img src="/i.png"></figure><script>var a = "</p>";</script><form><input></form>tail</div><div class="paywall">pay</div></body></html>"""


def test_tree():
    t = dom.parse(PAGE, "https://x.test/p/a/b")
    assert t.first("title").line() == "Page title" and t.first("img").attrs["src"] == "https://x.test/i.png"
    assert t.first("div.content a").attrs["href"] == "https://x.test/p/q?x=1"
    assert len(t.select("p")) == 2 and t.first("nav > a") is not None and t.first("body > a") is None
    assert [n.tag for n in t.select("title, img")] == ["title", "img"]
    assert dom.parse('<base href="https://b.test/x/"><a href="y">z</a>', "https://a.test/").first("a").attrs["href"] == "https://b.test/x/y"
    for s, n in (('[class*="wr"]', 1), ("#none", 0), ("div[class]", 3), ("*", len(list(t.walk())))):
        assert len(t.select(s)) == n, s
    for bad in ("a:hover", "", ",", "a >"):
        with pytest.raises(ValueError):
            dom.compiled(bad)
    deep = dom.parse("<div>" * 3000 + "x")
    assert deep.text() == "x" and deep.html().count("</div>") == 3000
    assert dom.parse("<p>a<!-- c -->b &amp; c").first("p").html() == "<p>a<!-- c -->b &amp; c</p>"


def test_fields():
    item = dom.parse('<article><a class="t" href="/p/1"> A  title </a><time datetime="2026-01-01">Jan</time></article>').first("article")
    assert dom.field(item, "a.t") == "A title" and dom.field(item, {"selector": "a", "attr": "href"}, "https://x.test/all") == "https://x.test/p/1"
    assert dom.field(item, {"selector": "time", "attr": "datetime"}) == "2026-01-01" and dom.field(item, "h1") == "" and dom.field(item, None) == "" and dom.field(item, "") == "A title Jan"


def test_extraction(spark):
    rows = [("https://x.test/p/a", PAGE), ("https://x.test/none", None), ("https://x.test/empty", ""), ("https://x.test/plain", "just text")]
    got = {r.url: r for r in articles.extracted(spark.createDataFrame(rows, "url string, html string"), ArticleConfig(content_selector="div.content")).collect()}
    a = got["https://x.test/p/a"]
    assert a.page_title == "Open title" and a.preview and a.page_dates[0] == "2026-05-01T10:00:00Z"
    assert "two" in a.content and "tail" in a.content and "Share" not in a.content and "script" not in a.content and "wrap" not in a.content and "<figure><img" in a.content
    assert got["https://x.test/none"].error_class == "FetchError" and got["https://x.test/empty"].error_class == "ExtractionError" and "just text" in got["https://x.test/plain"].content


def test_articles_and_documents(spark):
    refs = spark.createDataFrame([(0, "https://x.test/p/a", "", None), (1, "https://x.test/p/a", "Listed", "2020-01-01"), (2, "https://x.test/zz", "T", "2020-01-01")], "ord int, url string, title string, d string").withColumn("published_at", F.to_timestamp("d")).drop("d")
    pages = spark.createDataFrame([("https://x.test/p/a", PAGE)] * 2, "url string, html string")
    got = {r.ord: r for r in articles.articles(refs, pages).collect()}
    assert len(got) == 3 and got[0].title == "Open title" and got[0].published_at.year == 2026 and got[0].error == ""
    assert got[1].title == "Listed" and got[1].published_at.year == 2020 and got[2].error_class == "FetchError"
    page = spark.createDataFrame([("<p>x</p>", 'https://x.test/?a=1&b="', "A <b>", True)], "c string, u string, t string, p boolean")
    doc = page.select(articles.wrapped(F.col("c"), F.col("u"), F.col("t"), F.col("p")).alias("d")).first().d
    assert "<title>A &lt;b&gt;</title>" in doc and "a=1&amp;b=&quot;" in doc and "backfill-note" in doc and "<h1" not in doc


def test_titles_and_dates():
    t = dom.parse('<h1> </h1><title>T</title><time>May 1, 2026</time><div class="x"></div>')
    assert articles.page_title(t, ArticleConfig()) == "T" and articles.page_title(t, ArticleConfig(title_selector="div.x")) == ""
    assert articles.page_dates(t, ArticleConfig(date_selector=".none")) == ["May 1, 2026"]


def card(name, data=None, inner=""):
    attrs = f" data-attrs='{json.dumps(data)}'" if data is not None else ""
    return f'<p>before</p><div data-component-name="{name}"{attrs}>{inner}</div>after'


@pytest.mark.parametrize(
    ("markup", "want", "n"),
    [
        (card("EmbeddedPostToDOM", {"url": "https://a.b/p?utm_source=x", "title": "T", "bylines": [{"name": "A"}, {"name": "B"}, {"name": "C"}], "publication_name": "Pub", "truncated_body_text": "Q  q"}), '<p data-backfill-embed="EmbeddedPostToDOM">Embedded post: <a href="https://a.b/p">T</a> — A, B and C · Pub</p><blockquote data-backfill-embed="EmbeddedPostToDOM"><p>Q q</p></blockquote>after', 1),
        (card("DigestPostEmbed", None, '<a href="https://a.b/x"><h4>Title</h4><div><span>Ann</span><span>·</span><span>May 1</span></div></a>'), 'Embedded post: <a href="https://a.b/x">Title</a> — Ann · May 1</p>after', 1),
        (card("DigestPostEmbed", None, '<a href="https://a.b/x"><img alt="From image"></a>'), 'Embedded post: <a href="https://a.b/x">From image</a></p>after', 1),
        (card("EmbeddedPublicationToDOMWithSubscribe", {"base_url": "https://p.q", "name": "N", "author_name": "Au", "hero_text": "H"}), 'Embedded publication: <a href="https://p.q">N</a> — H · by Au</p>after', 1),
        (card("Youtube2ToDOM", {"videoId": "abcDEF123", "startTime": "12s"}, "<iframe></iframe>"), '<iframe></iframe></div><p data-backfill-embed="Youtube2ToDOM">Embedded media: <a href="https://www.youtube.com/watch?v=abcDEF123&amp;t=12s">Watch on YouTube</a></p>after', 1),
        ('<iframe src="data:text/html,%3Cblockquote%20data-instgrm-permalink%3D%22https%3A%2F%2Fi.g%2Fp%3Futm_a%3D1%22%3E"></iframe>tail', '</iframe><p data-backfill-embed="instagram">Embedded media: <a href="https://i.g/p">View on Instagram</a></p>tail', 1),
        (card("EmbeddedPostToDOM", {"url": "javascript:x", "title": "T"}), 'data-component-name="EmbeddedPostToDOM"', 0),
        ('<div data-component-name="EmbeddedPostToDOM" data-attrs="{bad">x</div>', 'data-attrs="{bad"', 0),
        (card("Other", {}), 'data-component-name="Other"', 0),
    ],
)
def test_embeds(markup, want, n):
    tree = dom.parse(f"<div>{markup}</div>").first("div")
    assert embeds.rewrite(tree) == n
    assert want in tree.html()


def test_listing_pages(spark):
    html = '<article class="post"><a href="/p/1">One</a><time datetime="2026-01-02">x</time></article><article class="post"><a href="https://y.test/2">Two</a></article><a class="next" href="?page=2">more</a>'
    pages = spark.createDataFrame([(0, 0, "https://x.test/all", html), (0, 1, "https://x.test/b", "<p>none</p>"), (0, 2, "https://x.test/c", None)], "source_index int, page_no int, url string, payload string")
    fields = {"url": {"selector": "a", "attr": "href"}, "title": "a", "date": {"selector": "time", "attr": "datetime"}}
    got = articles.html_items(pages, "article.post", fields).orderBy("pos").collect()
    assert [(r.url, r.title, r.date_raw) for r in got] == [("https://x.test/p/1", "One", "2026-01-02"), ("https://y.test/2", "Two", "")]
    nxt = {r.url: r.next_url for r in articles.next_links(pages.withColumnRenamed("payload", "html"), "a.next").collect()}
    assert nxt["https://x.test/all"] == "https://x.test/all?page=2" and nxt["https://x.test/b"] is None


def test_probe(spark):
    html = '<link rel="alternate" type="application/rss+xml" href="/feed"><div class="a bb-long"><a href="/p/one?x#y">One</a></div><div class="a bb-long"><a href="/p/two">Two</a></div><a href="/about">n</a><a href="https://other.test/p/x">o</a><a href="/p/one">again</a><time datetime="d">t</time><script src="https://substackcdn.com/x"></script>'
    row = probe.report(spark.createDataFrame([("https://x.test/archive", html), ("https://y.test/", "<p>x</p>")], "url string, html string")).where("url = 'https://x.test/archive'").first()
    assert row.platform == "substack" and row.static_article_count == 2 and row.url_patterns == {"/p/{slug}": 3}
    assert row.sample_articles[0].text == "One" and row.container_candidates[0].selector == "div.bb-long" and json.loads(row.feeds[0])["href"] == "https://x.test/feed"
    assert row.endpoint == "https://x.test/api/v1/archive?sort=new&offset={offset}&limit={limit}" and len(row.warnings) == 2
    a, b = spark.createDataFrame([("u",), ("v",)], "href string"), spark.createDataFrame([("v",), ("w",)], "href string")
    assert probe.paginates(a, b).first().asDict() == {"page_1_count": 2, "page_2_count": 2, "new_on_page_2": 1, "paginates": True}
    assert not probe.paginates(a, a).first().paginates


def test_embeds_without_what_they_need():
    for markup in (
        card("EmbeddedPostToDOM", {"url": "https://a.b/p", "title": " "}), card("EmbeddedPostToDOM", {"title": "T"}), card("EmbeddedPostToDOM", {"url": 3, "title": ["T"]}), card("DigestPostEmbed", None, "<a href='https://a.b/x'></a>"), card("DigestPostEmbed", None, "<h4>T</h4>"),
        card("EmbeddedPublicationToDOMWithSubscribe", {"name": "N"}), card("Youtube2ToDOM", {"videoId": "a b"}), card("Youtube2ToDOM", {"videoId": 7}), card("Youtube2ToDOM"), '<iframe src="data:text/html,none"></iframe>', card("instagram", {"url": "https://a.b/p", "title": "T"}),
    ):
        tree = dom.parse(f"<div>{markup}</div>").first("div")
        before = tree.html()
        assert embeds.rewrite(tree) == 0 and tree.html() == before
    odd = dom.parse(card("EmbeddedPostToDOM", {"url": "https://a.b/p", "title": "T", "bylines": [3, {"name": None}, {"name": "A"}, {}]}) + card("Youtube2ToDOM", {"videoId": "abcDEF123", "startTime": None}))
    assert embeds.rewrite(odd) == 2 and "T</a> — A</p>" in odd.html() and "v=abcDEF123\"" in odd.html()


def test_any_depth_and_empty_containers(spark):
    """Ten thousand nested elements take as long as ten thousand beside each other."""
    for tag in ("div", "b", "blockquote", "span"):
        page = f"<{tag}>" * 10_000 + "text" + f"</{tag}>" * 10_000 + "<div><span> </span><!-- c --></div>" * 3000
        tree = dom.parse(f"<body>{page}</body>")
        articles.without_empty(tree)
        assert "c --" not in tree.html() and tree.line() == "text"
        assert "text" in to_markdown(tree.html())
    kept = dom.parse("<div><div><p> </p></div><span><img></span><section><!-- c --></section><figure>x</figure></div>")
    articles.without_empty(kept)
    assert kept.html().replace("</!document>", "").replace("<!document>", "") == "<div><div><p> </p></div><span><img></span><figure>x</figure></div>".replace("<div><p> </p></div>", "")


def test_a_fault_of_one_document_is_its_own(spark, monkeypatch):
    df = spark.createDataFrame([(0, "<p>a</p>"), (1, None), (2, "<b>" * 5000 + "x")], "k int, html string")
    got = {r.k: r.c for r in df.select("k", converted("html").alias("c")).collect()}
    assert got[0].body == "a" and got[0].error == "" and got[1].body is None and got[1].error == "" and got[2].body.startswith("**")
    from docweir.functions import markdown as m

    monkeypatch.setattr(m, "to_markdown", lambda h: 1 / 0)
    assert m._converted("<p>") == (None, "ZeroDivisionError: division by zero")


def test_a_report_parses_each_page_once(spark):
    """The containers' links are counted as a search below each element would, and the report's plan reads markup in one place."""
    rng = __import__("random").Random(4)

    def markup(depth=0):
        out = ""
        for _ in range(rng.randint(0, 3)):
            tag = rng.choice(["div", "li", "article", "a", "p", "ul"])
            attrs = ' href="/x"' if tag == "a" and rng.random() < 0.8 else f' class="{rng.choice(["c", "long-one b", ""])}"'
            out += f"<{tag}{attrs}>{markup(depth + 1) if depth < 5 else ''}</{tag}>"
        return out

    for _ in range(300):
        tree = dom.parse(markup())
        want = [{"pos": i, "selector": f"{n.tag}.{max(n.attrs['class'].split(), key=len)}"} for i, n in enumerate(tree.select("article, li, div")) if n.attrs.get("class", "").split() and 1 <= len(n.select("a[href]")) <= probe.MOST_LINKS]
        assert probe._containers(tree) == want
    plan = probe.report(spark.createDataFrame([("https://x.test/", "<p>"), (None, None)], "url string, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan  # it was kept when the report was asked for


def test_named_references_end_with_a_semicolon():
    """One that is cut off or unknown stays as written, in text and attributes; markup that is not decoded stays as it is."""
    tree = dom.parse('<h1 title="a&amp b&amp;c">x &amp;&amp</h1><a href="/q?a=1&copy=2&amp;b=3">&notice; &#65; &eacute;</a><script>a && b &amp c</script><!-- &lt -->')
    assert tree.first("h1").line() == "x &&amp" and tree.first("h1").attrs["title"] == "a&amp b&c"
    assert tree.first("a").attrs["href"] == "/q?a=1&copy=2&b=3" and tree.first("a").line() == "&notice; A é"
    assert tree.first("script").html() == "<script>a && b &amp c</script>" and "<!-- &lt -->" in tree.html()
    assert dom.parse("<p>\ufdd0 &amp\ufdd1</p>").first("p").line() == "\ufdd0 &amp\ufdd1"


def test_title_cut_within_a_reference(spark):
    pages = spark.createDataFrame([("https://x.test/", "<title>t</title><h1>A &amp;&amp</h1>")], "url string, html string")
    assert articles.extracted(pages).first().page_title == "A &&amp"


def test_pages_are_read_in_small_parts():
    """No part is longer than the limit and a row, rows keep their order, and nulls, empty and very long texts are rows too."""
    texts = ["x" * 300_000] * 9 + [None, "", "y" * 3_000_000, "z"] + ["w"] * 2500
    got = list(slices.parts(pa.array(texts), pa.array(range(len(texts)))))
    assert [t for part, _ in got for t in part] == texts and [i for _, ids in got for i in ids] == list(range(len(texts)))
    assert all(len(part) <= 1000 and sum(len(t or "") for t in part[:-1]) <= slices.PART_BYTES for part, _ in got) and len(got) > 4
    assert list(slices.parts(pa.array([], pa.string()))) == []
