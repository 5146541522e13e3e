import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweir.operators import listing

ITEM = "page_no int, pos int, url string, title string"


def sequential(sources, limit=None):
    """What a reader that goes page by page would keep; sources: lists of pages of (url, title)."""
    urls, titles, kept = set(), set(), []
    for s, pages in enumerate(sources):
        for page in pages:
            new = 0
            for url, title in page:
                if not url or url in urls:
                    continue
                urls.add(url)
                new += 1
                if title and title in titles:
                    continue
                if title:
                    titles.add(title)
                kept.append((s, url))
            if not new:
                break
    return kept if limit is None else kept[:limit]


def frames(spark, sources):
    out = []
    for pages in sources:
        rows = [(p, i, f"https://x.test/{u}" if u else "", t) for p, page in enumerate(pages) for i, (u, t) in enumerate(page)]
        out.append((spark.createDataFrame([(p,) for p in range(len(pages))], "page_no int"), spark.createDataFrame(rows, ITEM)))
    return out


def test_fold_against_a_sequential_reader(spark):
    rng = random.Random(7)
    for case in range(6):
        sources = [[[(rng.choice(["", *"abcdefghijklm"]), rng.choice(["", "t1", "t2", "t3", "t4", "t5"])) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 3))]
        for limit in (None, rng.randint(1, 6)):
            got = listing.read_listing(frames(spark, sources), limit).orderBy("ord").select("source_index", "url").collect()
            want = [(s, f"https://x.test/{u}") for s, u in sequential(sources, limit)]
            assert [tuple(r) for r in got] == want, (sources, limit)


def test_limit_counts_over_all_sources(spark):
    sources = [[[(c, "") for c in "abcd"]], [[(c, "") for c in "efghijklmn"]]]
    assert listing.read_listing(frames(spark, sources), 10).count() == 10


def test_json_items(spark):
    payload = '{"data": {"posts": [{"u": " https://a.b/1 ", "t": "One", "d": "2026-05-01"}, {"u": "https://a.b/2", "d": 20260501}, {"t": "no url"}, 7]}}'
    pages = spark.createDataFrame([(0, 0, payload), (0, 1, "{}"), (0, 2, '{"data": {"posts": 3}}'), (0, 3, "bad"), (0, 4, None)], "source_index int, page_no int, payload string")
    rows = listing.json_items(pages, "data.posts", {"url": "u", "title": "t", "date": "d"}).orderBy("pos").collect()
    assert [(r.url, r.title, r.date_raw) for r in rows] == [("https://a.b/1", "One", "2026-05-01"), ("https://a.b/2", "", None), ("", "no url", None), ("", "", None)]
    root = listing.json_items(spark.createDataFrame([(0, 0, '[{"u": "x"}]')], "source_index int, page_no int, payload string"), "", {"url": "u", "title": "t"})
    assert [r.url for r in root.collect()] == ["x"]


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "url string, next_url string")
    assert [r.url for r in listing.next_link_walk(edges, "a", 10).orderBy("step").collect()] == ["a", "b", "c"]
    assert [r.url for r in listing.next_link_walk(edges, "a", 2).orderBy("step").collect()] == ["a", "b"]
    assert [r.url for r in listing.next_link_walk(edges, "d", 5).collect()] == ["d"]


def test_running_offsets(spark):
    pages = spark.createDataFrame([(0, 0, 23), (0, 1, 50), (0, 2, 12), (1, 0, 5)], "source_index int, page_no int, n_items int")
    assert [r.offset for r in listing.running_offsets(pages, 0).orderBy("source_index", "page_no").collect()] == [0, 23, 73, 0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["", "t", "s"])), max_size=8))
def test_first_occurrences(rows):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    items = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(rows)], "ord int, url_key string, title_key string")
    want = [rows.index(next(r for r in rows if r[0] == u)) for u in dict(rows)]
    assert sorted(r.ord for r in listing.first_urls(items).collect()) == sorted(next(i for i, r in enumerate(rows) if r[0] == u) for u in {r[0] for r in rows})
    assert len(want) == len({r[0] for r in rows})


def plain_walk(edges, start, most):
    walk = []
    while start is not None and start not in walk and len(walk) < most:
        walk.append(start)
        start = edges.get(start)
    return walk


def test_many_walks_at_once(spark):
    rng = random.Random(13)
    nodes = [f"n{k}" for k in range(60)]
    graphs = [{n: rng.choice([None, *nodes]) if rng.random() < 0.3 else nodes[(k + 1) % 60] for k, n in enumerate(nodes)} for _ in range(4)]
    edges = spark.createDataFrame([(i, a, b) for i, g in enumerate(graphs) for a, b in g.items()], "source_index int, url string, next_url string")
    starts = spark.createDataFrame([(i, rng.choice(nodes)) for i in range(4)] + [(9, "nowhere")], "source_index int, url string")
    for most in (1, 2, 3, 8, 33, 64, 200):
        got = {}
        for r in listing.walked(edges, starts, most).orderBy("step").collect():
            got.setdefault(r.source_index, []).append(r.url)
        assert got == {r.source_index: plain_walk(graphs[r.source_index] if r.source_index < 4 else {}, r.url, most) for r in starts.collect()}, most


def test_a_walk_takes_few_jobs_whatever_the_pages(spark):
    def jobs(n):
        edges = spark.createDataFrame([(0, str(k), str(k + 1)) for k in range(n)], "source_index int, url string, next_url string")
        spark.sparkContext.setJobGroup(f"walk-{n}", "")
        listing.walked(edges, spark.createDataFrame([(0, "0")], "source_index int, url string"), 64).count()
        out = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walk-{n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out

    assert jobs(3) <= jobs(80) == jobs(300)


def test_offset_edges(spark):
    store = [("https://x.test/a?o=0&l=5&again=0", '{"p": [1, 2, 3]}'), ("https://x.test/a?o=3&l=5&again=3", '{"p": [1]}'), ("https://x.test/a?o=4&l=5&again=4", '{"p": []}'), ("https://x.test/a?o=4&l=6&again=4", '{"p": [1]}'), ("https://x.test/a?o=1&l=5&again=2", '{"p": [1]}'), ("https://xytest/a?o=0&l=5&again=0", '{"p": [1]}'), ("https://x.test/a?o=9&l=5&again=9", None)]
    got = listing.offset_edges(spark.createDataFrame(store, "url string, html string"), 2, "https://x.test/a?o={offset}&l={limit}&again={offset}", 5, "p")
    assert {r.url[-1]: r.next_url for r in got.collect()} == {"0": "https://x.test/a?o=3&l=5&again=3", "3": "https://x.test/a?o=4&l=5&again=4", "4": None, "9": None}


def test_pages_that_are_no_listing(spark):
    said = {'{"p": [1]}': None, '{"p": []}': None, '{"p": null}': None, "{}": None, '{"p": 3}': "leads to bigint", '{"p": {"a": 1}}': "leads to object", '{"p": "x"}': "leads to string", "<html>": "no JSON", None: "no JSON"}
    df = spark.createDataFrame([(x,) for x in said], "payload string")
    got = {r.payload: r.why for r in df.select("payload", listing.json_problem("payload", "p").alias("why")).collect()}
    assert all(got[k] is None if want is None else want in got[k] for k, want in said.items()), got


def test_contributions(spark):
    rows = spark.createDataFrame([(0,), (0,), (1,)], "source_index int")
    assert {r.source_index: r.n for r in listing.contributions(rows).collect()} == {0: 2, 1: 1}
