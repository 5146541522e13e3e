import json
import re
import sqlite3
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docweir.operators import render, state
from docweir.plans import cli, pipeline, queries
from docweir.plans.control import Control
from docweir.sources import config, fetch, sinks, sqlite
from docweir.streaming import stream

JSON = {"archive_url": "https://x.test/archive", "label_id": "L1", "sender": 'Ann "A" <a@x.test>', "listing": {"mode": "json", "url_template": "https://x.test/api?o={offset}&n={limit}", "pagination": {"type": "offset", "page_size": 3, "max_pages": 9}, "items_path": "posts", "fields": {"url": "u", "title": "t", "date": "d"}}, "article": {"content_selector": "div.content"}}
HTML = {"archive_url": "https://y.test/", "sender": "b@y.test", "listing": {"mode": "html", "url_template": "https://y.test/all", "next_page_selector": "a.next", "pagination": {"max_pages": 5}, "item_selector": "article", "fields": {"url": {"selector": "a", "attr": "href"}, "title": "a"}}}


TITLES = ("", "On rivers", "Cities at night", "Three letters", "A long walk", "Bread")


def post(k):
    return {"u": f"https://x.test/p/{k}?utm_source=l", "t": TITLES[k], "d": f"2026-05-0{k}T00:00:00Z"}


@pytest.fixture
def world(spark):
    """A JSON archive whose first page is short, and an HTML archive of two pages that repeats one post."""
    pages = [
        ("https://x.test/api?o=0&n=3", json.dumps({"posts": [post(1), post(2)]})),
        ("https://x.test/api?o=2&n=3", json.dumps({"posts": [post(3), post(4), post(5)]})),
        ("https://x.test/api?o=5&n=3", json.dumps({"posts": []})),
        ("https://y.test/all", '<article><a href="/p/o1">Old one</a></article><a class="next" href="?p=2">n</a>'),
        ("https://y.test/all?p=2", '<article><a href="/p/o2">Old two</a></article><article><a href="/p/again">On rivers</a></article><a class="next" href="https://y.test/all">n</a>'),
        *[(f"https://x.test/p/{k}?utm_source=l", f"<div class='content'><p>Body of {k}</p></div>") for k in (2, 3)],
        ("https://x.test/p/4?utm_source=l", "<div class='content'> </div><h1>x</h1>"),
        ("https://y.test/p/o1", '<meta property="article:published_time" content="2020-01-01"><article>Old body</article>'),
        ("https://y.test/p/o2", "<article>No date</article>"),
    ]
    return spark.createDataFrame(pages, "url string, html string")


MAPPING = config.mapping("News", {"label_id": "L1", "sender": "s@x.test", "sources": [{k: v for k, v in JSON.items() if k != "label_id"}, HTML]})


def held(spark):
    return spark.createDataFrame([("m1", "Re: On rivers", "2026-05-01")], "message_id string, subject string, date string")


def test_listing(spark, world):
    got = pipeline.read_listing(spark, MAPPING, world).orderBy("ord").collect()
    assert [(r.source_index, r.title) for r in got] == [(0, t) for t in TITLES[1:]] + [(1, "Old one"), (1, "Old two")]
    assert got[0].published_at.day == 1 and got[5].published_at is None
    assert pipeline.read_listing(spark, MAPPING, world, 6).count() == 6
    with pytest.raises(pipeline.ListingError):
        pipeline.read_listing(spark, MAPPING, world.limit(0))


def test_a_path_that_leads_to_no_list_is_an_error(spark, world):
    first = json.dumps({"posts": [post(1), post(2)]})
    store = spark.createDataFrame([("https://x.test/api?o=0&n=3", first), ("https://x.test/api?o=2&n=3", '{"posts": {"error": "slow down"}}')], "url string, html string")
    alone = config.mapping("News", JSON)
    with pytest.raises(pipeline.ListingError, match="leads to object.*not to a list at https://x.test/api.o=2"):
        pipeline.read_listing(spark, alone, store)
    with pytest.raises(pipeline.ListingError, match="no JSON"):
        pipeline.read_listing(spark, alone, store.where("url like '%o=0%'").withColumn("html", F.lit("<html>")))
    # with other archives the source ends there, and what it has stays
    other = world.where("url like 'https://y.test%'")
    assert {r.title for r in pipeline.read_listing(spark, MAPPING, store.unionByName(other)).collect()} == {"On rivers", "Cities at night", "Old one", "Old two"}
    # nothing at the path, and a page that repeats the one before, end a listing without an error
    assert pipeline.read_listing(spark, alone, store.withColumn("html", F.when(F.col("url").contains("o=2"), "{}").otherwise(F.col("html")))).count() == 2
    again = spark.createDataFrame([("https://x.test/api?o=0&n=3", first), ("https://x.test/api?o=2&n=3", first), ("https://x.test/api?o=4&n=3", "3")], "url string, html string")
    assert pipeline.read_listing(spark, alone, again).count() == 2


def test_run_again_and_prune(spark, world, tmp_path):
    store = state.StateStore(spark, f"file://{tmp_path}/state", buckets=2)
    folders = pipeline.Folders(f"{tmp_path}/raw", f"{tmp_path}/md", f"{tmp_path}/pub")
    index = pipeline.corpus(held(spark), None, "News")
    dry = pipeline.run(spark, MAPPING, world, index, store, folders, dry_run=True)
    assert (dry.listed, dry.held, dry.missing, dry.selected, dry.written) == (7, 1, 6, 6, 0) and store.read("articles").count() == 0
    got = pipeline.run(spark, MAPPING, world, index, store, folders, limit=5)
    assert (got.selected, got.written, got.failed) == (5, 3, 2)  # 4 is empty, 5 has no page
    files = sorted(p.name for p in (tmp_path / "md").iterdir())
    assert len(files) == 3 and files[1].startswith("old-one_web-") and len(list((tmp_path / "raw").iterdir())) == 3
    text = next((tmp_path / "md").glob("cities-at-night_*.md")).read_text()
    assert 'from: "Ann \\"A\\" <a@x.test>"' in text and 'label_ids: ["L1"]' in text and 'origin: "backfill"' in text and text.endswith("\nBody of 2\n") and "date: 2026-05-02 00:00:00" in text
    rows = {r.status: r.n for r in state.counts(store.read("articles"), "News").collect()}
    assert rows == {"have": 1, "done": 3, "failed": 2}
    again = pipeline.run(spark, MAPPING, world, index, store, folders)
    assert (again.held, again.written, again.failed) == (4, 0, 3)
    assert store.last_run("News").first().articles_failed == 3
    from docweir.operators.render import held_from_markdown, read_headers

    back = held_from_markdown(read_headers(spark, f"{tmp_path}/md"), "News").collect()
    assert {r.subject for r in back} == {"Cities at night", "Three letters", "Old one"}
    assert pipeline.corpus(held(spark).limit(0), read_headers(spark, f"{tmp_path}/md"), "News").count() == 3
    plan = pipeline.prune_label(spark, "News", store, folders)
    done = pipeline.prune_label(spark, "News", store, folders, dry_run=False)
    assert {k: plan[k] for k in ("files_removed", "directories_removed", "rows_removed")} == {k: done[k] for k in ("files_removed", "directories_removed", "rows_removed")}
    assert done["files_removed"] == 6 and not list((tmp_path / "md").glob("*.md")) and store.read("articles").count() == 1


def test_validate(spark):
    m = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "3")], "label_name string, label_id string")
    h = spark.createDataFrame([("1",), ("1",)], "label_id string")
    assert {r.label_name: (r.problem, r.n_held) for r in pipeline.validate(m, h).collect()} == {"a": ("", 2), "b": ("no label id", 0), "c": ("no messages held", 0)}


@pytest.mark.parametrize(
    ("change", "says"),
    [
        ({"archive_url": ""}, "archive_url is missing"), ({"archive_url": "ftp://x"}, "http"), ({"listing": None}, "listing section"), ({"listing": {**JSON["listing"], "mode": "odd"}}, "mode"), ({"listing": {**JSON["listing"], "url_template": ""}}, "url_template"),
        ({"listing": {**JSON["listing"], "fields": {"url": "u"}}}, "title"), ({"listing": {**JSON["listing"], "fields": [1]}}, "object"), ({"listing": {**JSON["listing"], "mode": "html"}}, "item_selector"), ({"listing": {**JSON["listing"], "url_template": "https://x"}}, "{offset}"),
        ({"listing": {**JSON["listing"], "pagination": {"type": "odd"}}}, "pagination.type"), ({"article": {"strip_selectors": "a"}}, "list"), ({"sources": [JSON]}, "both"), ({"archive_url": "", "sources": []}, "not empty"), ({"archive_url": "", "sources": [JSON, {**JSON, "archive_url": "https://X.test/archive/"}]}, "repeated"), ({"archive_url": "", "sources": [3]}, "source[0]"),
    ],
)
def test_bad_mappings(change, says):
    with pytest.raises(config.ConfigError, match=says.replace("{", r"\{").replace("[", r"\[")):
        config.mapping("News", {**JSON, **change})


def test_config_files(spark, tmp_path):
    m = config.Mappings(tmp_path / "m.json")
    assert m.all() == [] and m.get("x") is None
    m.save("Zé", JSON)
    m.save("A", {"sources": [JSON, HTML], "label_id": "9", "sender": "s"})
    assert [x.label_name for x in m.all()] == ["A", "Zé"] and "Zé" in m.path.read_text() and m.path.read_text().endswith("\n")
    assert m.get("A").source(5).archive_url == JSON["archive_url"] and m.get("A").source(1).display_name == "y.test"
    assert m.frame(spark).count() == 3
    m.delete("A")
    m.delete("none")
    assert [x.label_name for x in m.all()] == ["Zé"]
    with pytest.raises(config.ConfigError):
        m.save("bad", {})
    m.path.write_text("{bad")
    with pytest.raises(config.ConfigError):
        m.all()
    p = config.Presets(tmp_path / "p.json")
    p.save("b", "1, 2")
    p.save("a", "3")
    p.save("b", "4")
    p.delete("zz")
    assert p.all() == ["a", "b"] and p.get("b") == "4" and p.get("zz") is None
    p.delete("a")
    assert p.all() == ["b"]


def test_command_lines(tmp_path):
    assert cli.command_line("docweir", "run", {"label": "a, b", "limit": 5, "dry_run": True, "yes": False}) == 'docweir run --label "a, b" --limit 5 --dry-run'
    assert cli.command_line("docweir", "fetch-pending", {"label": None, "limit": None, "offset": 0}) == "docweir fetch-pending"
    bad = tmp_path / "m.json"
    bad.write_text('{"mappings": {"x": {}}}')
    assert cli.main(["--mappings", str(bad), "list"]) == 2


def test_cli(spark, world, tmp_path, capsys):
    config.Mappings(tmp_path / "m.json").save("News", JSON)
    world.write.parquet(f"{tmp_path}/pages")
    base = ["--mappings", f"{tmp_path}/m.json", "--state", f"{tmp_path}/s", "--buckets", "2", "--messages", f"{tmp_path}/none", "--pages", f"{tmp_path}/pages", "--raw", f"{tmp_path}/raw", "--markdown", f"{tmp_path}/md"]
    assert cli.main([*base, "scan", "--label", "News"]) == 0
    assert cli.main([*base, "run", "--label", "News", "--limit", "2", "--dry-run"]) == 0 and "selected=2" in capsys.readouterr().out
    assert cli.main([*base, "validate"]) == 1 and cli.main([*base, "list"]) == 0
    assert cli.main([*base, "prune", "--label", "News", "--dry-run"]) == 0 and cli.main([*base, "run", "--label", "Other"]) == 2
    assert cli.main([*base, "probe", "https://y.test/all"]) == 0


def test_list_and_probe_are_readable(spark, tmp_path, capsys):
    config.Mappings(tmp_path / "m.json").save("News", {"label_id": "L1", "sender": "s@x.test", "sources": [{k: v for k, v in JSON.items() if k != "label_id"}, HTML]})
    page = lambda *ids: "".join(f'<div class="card"><a href="/p/{i}">Article {i}</a></div>' for i in ids)
    spark.createDataFrame([("https://x.test/a", page(1, 2)), ("https://x.test/a?p=2", page(2, 3)), ("https://x.test/same", page(1, 2))], "url string, html string").write.parquet(f"{tmp_path}/pages")
    base = ["--mappings", f"{tmp_path}/m.json", "--state", f"{tmp_path}/s", "--pages", f"{tmp_path}/pages"]
    assert cli.main([*base, "list"]) == 0
    said = capsys.readouterr().out
    assert "https://y.test/" in said and "html" in said and "json" in said and "no runs yet" in said and JSON["sender"] in said
    assert cli.main([*base, "probe", "https://x.test/a", "--second", "https://x.test/a?p=2"]) == 0
    said = capsys.readouterr().out
    assert "container div.card: 2 times" in said and "second page: 1 of 2 new" in said and "articles on the static page: 2" in said
    assert cli.main([*base, "probe", "https://x.test/a", "--second", "https://x.test/same", "--json"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert json.loads(found["second_page"])["paginates"] is False and found["static_article_count"] == 2
    assert cli.main([*base, "probe", "https://x.test/none"]) == 1


def test_held_messages_in_the_command_line(spark, world, tmp_path, capsys):
    """A message found under another label counts; with a stale label id the Markdown files do."""
    world.write.parquet(f"{tmp_path}/pages")
    messages = [("m1", "OTHER", "Re: On rivers", "2026-05-01"), ("m2", "OTHER", "Bread", "2026-05-01"), ("m3", "L1", "Cities at night", "2026-05-01")]
    spark.createDataFrame(messages, "message_id string, label_id string, subject string, date string").write.parquet(f"{tmp_path}/messages")
    spark.createDataFrame([("m1", "L1"), ("m1", "OTHER"), ("m2", "OTHER")], "message_id string, label_id string").write.parquet(f"{tmp_path}/bridge")
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "three-letters_x9.md").write_text('---\nid: "x9"\nsubject: "Three letters"\nlabels: ["News"]\n---\nb\n')

    def selected(label_id):
        config.Mappings(tmp_path / "m.json").save("News", {**JSON, "label_id": label_id})
        base = ["--mappings", f"{tmp_path}/m.json", "--state", f"{tmp_path}/s", "--buckets", "2", "--messages", f"{tmp_path}/messages", "--message-labels", f"{tmp_path}/bridge", "--pages", f"{tmp_path}/pages", "--raw", f"{tmp_path}/raw", "--markdown", f"{tmp_path}/md"]
        code, _ = cli.main([*base, "validate"]), capsys.readouterr()
        assert cli.main([*base, "scan", "--label", "News"]) == 0
        held = {line.split("|")[3].strip() for line in capsys.readouterr().out.split("\n") if "|" in line and line.split("|")[1].strip() == "have"}
        assert cli.main([*base, "run", "--label", "News", "--dry-run"]) == 0
        assert f"held={len(held)}" in capsys.readouterr().out
        return code, held

    assert selected("L1") == (0, {"On rivers"})
    assert selected("STALE") == (1, {"Three letters"}) == selected("")


def agree(store, folders, label="News"):
    """Files, rows and the audit say the same; how many were written."""
    rows = {r.article_id: r for r in store.read("articles").collect()}
    raw, md = ({p.name for p in Path(d).iterdir()} if Path(d).exists() else set() for d in (folders.raw, folders.markdown))
    done = [r for r in rows.values() if r.status == "done"]
    assert raw == {f"{r.article_id}.html" for r in done} and md == {Path(r.markdown_path).name for r in done}
    return len(done)


def test_stop_leaves_the_other_batches(spark, world, tmp_path):
    store, folders = state.StateStore(spark, f"file://{tmp_path}/state", buckets=2), pipeline.Folders(f"{tmp_path}/raw", f"{tmp_path}/md")
    index, heard = pipeline.corpus(held(spark), None, "News"), []

    def listen(p):
        heard.append(p.stage)
        if p.stage == "written":
            control.stop()

    control = Control(spark, listen)
    got = control.run("run", lambda c: pipeline.run(spark, MAPPING, world, index, store, folders, control=c))
    rows = {r.url: r.status for r in store.read("articles").collect()}
    assert heard == ["started", "listed", "written", "stopped"] and got.written == 2
    assert {s for u, s in rows.items() if "y.test" in u} == {"discovered"} and "done" in rows.values()
    assert agree(store, folders) == 2 == store.last_run("News").first().articles_written
    again = pipeline.run(spark, MAPPING, world, index, store, folders, batch=1)
    assert again.written == 1 and {r.status for r in store.read("articles").collect()} == {"have", "done", "failed"}
    assert agree(store, folders) == 3


def many(spark, n=28):
    """A listing of so many articles on one page."""
    posts = [{"u": f"https://x.test/p/{k}", "t": f"Article {k}", "d": "2026-05-01T00:00:00Z"} for k in range(n)]
    pages = [("https://x.test/api?o=0&n=3", json.dumps({"posts": posts}))] + [(p["u"], "<div class='content'><p>Body</p></div>") for p in posts]
    return config.mapping("News", JSON), spark.createDataFrame(pages, "url string, html string")


def test_cancel_inside_a_job_loses_nothing(spark, tmp_path):
    """Cancelled when the first file is in its place, while a later batch is under way."""
    m, pages = many(spark)
    store, folders = state.StateStore(spark, f"{tmp_path}/state", buckets=2), pipeline.Folders(f"{tmp_path}/raw", f"{tmp_path}/md")
    control, over = Control(spark), threading.Event()

    def watch():
        while not over.wait(0.01):
            if Path(folders.raw).exists() and any(Path(folders.raw).iterdir()):
                time.sleep(0.3)
                return control.cancel()

    t = threading.Thread(target=watch)
    t.start()
    got = control.run("run", lambda c: pipeline.run(spark, m, pages, pipeline.corpus(held(spark), None, "News"), store, folders, control=c, batch=4))
    over.set()
    t.join()
    last = store.last_run("News").first()
    assert control.stopped and 0 < got.written < 28 and agree(store, folders) == got.written == last.articles_written and last.completed_at
    assert {r.status: r.n for r in state.counts(store.read("articles"), "News").collect()} == {"done": got.written, "discovered": 28 - got.written}
    rest = pipeline.run(spark, m, pages, pipeline.corpus(held(spark), None, "News"), store, folders)
    assert rest.written == 28 - got.written and agree(store, folders) == 28 and sinks.staged(spark, folders.markdown) == []


def test_what_a_killed_driver_left_is_finished(spark, tmp_path, monkeypatch):
    m, pages = many(spark, 6)
    store, folders = state.StateStore(spark, f"{tmp_path}/state", buckets=2), pipeline.Folders(f"{tmp_path}/raw", f"{tmp_path}/md")
    index = pipeline.corpus(held(spark), None, "News")

    class Killed(BaseException):
        pass

    def killed(*a):
        raise Killed

    for at in ("settle", "let_go"):  # once with the files staged, once with them moved and the state told
        with monkeypatch.context() as p:
            p.setattr(sinks, at, killed)
            with pytest.raises(Killed):
                pipeline.run(spark, m, pages, index, store, folders, limit=3)
        assert len(sinks.staged(spark, folders.markdown)) == 1
    (tmp_path / "md" / ".batch-cut-off" / "x").mkdir(parents=True)  # tasks wrote, and nothing was committed
    got = pipeline.run(spark, m, pages, index, store, folders)
    assert got.written == 3 and agree(store, folders) == 6 and sinks.staged(spark, folders.markdown) == []


def test_scan_shows_undated_first_and_then_the_oldest(spark, tmp_path, capsys):
    posts = [{"u": f"https://x.test/p/{k}", "t": f"Title {k}", **({"d": d} if d else {})} for k, d in enumerate(["2026-05-03T00:00:00Z", None, "2026-05-01T00:00:00Z", "2026-05-02T00:00:00Z"])]
    spark.createDataFrame([("https://x.test/api?o=0&n=3", json.dumps({"posts": posts}))], "url string, html string").write.parquet(f"{tmp_path}/pages")
    config.Mappings(tmp_path / "m.json").save("News", JSON)
    assert cli.main(["--mappings", f"{tmp_path}/m.json", "--state", f"{tmp_path}/s", "--buckets", "2", "--messages", f"{tmp_path}/none", "--pages", f"{tmp_path}/pages", "--raw", f"{tmp_path}/raw", "--markdown", f"{tmp_path}/md", "scan", "--label", "News"]) == 0
    assert re.findall(r"Title \d", capsys.readouterr().out) == ["Title 1", "Title 2", "Title 3", "Title 0"]


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/store.db"
    assert sqlite.sqlite_table(spark, path, "messages").count() == 0
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE messages (message_id TEXT PRIMARY KEY, status TEXT, subject TEXT)")
    con.executemany("INSERT INTO messages VALUES (?, ?, ?)", [(f"m{i}", "pending", "s") for i in range(50)])
    con.commit()
    con.close()
    got = sqlite.sqlite_table(spark, path, "messages", partitions=3)
    assert got.count() == 50 and got.where("status = 'pending'").count() == 50 and got.first().sender is None
    assert sqlite.sqlite_table(spark, path, "labels").count() == 0


def message_store(path, rows):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE IF NOT EXISTS messages (message_id TEXT PRIMARY KEY, label_id TEXT, status, subject TEXT, updated_at TEXT)")
    con.executemany("INSERT OR REPLACE INTO messages VALUES (?, ?, ?, ?, ?)", rows)
    con.commit()
    con.close()


def test_sqlite_reads_the_wanted_rows_alone(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store.db"
    message_store(path, [(f"m{i}", f"L{i % 5}" if i % 7 else None, ["pending", "done", 3, None][i % 4], f"s{i}", "2026") for i in range(100)])
    messages = sqlite.sqlite_table(spark, path, "messages", partitions=3)
    rows = messages.collect()
    for condition in ("label_id = 'L2'", "label_id IN ('L1', 'L3')", "label_id IS NULL", "status = '3'", "status > 'a'", "label_id <= 'L1' AND status = 'done'", "NOT label_id = 'L2'", "subject LIKE 's1%' AND label_id = 'L1'", "label_id = status", "thread_id IS NULL AND label_id = 'L4'"):
        local = spark.createDataFrame(rows, messages.schema).where(condition)
        assert sorted(r.message_id for r in messages.where(condition).collect()) == sorted(r.message_id for r in local.collect()), condition
    # what the file gives is what was asked for, as far as SQLite can say so
    reader = sqlite._Reader(messages.schema, {"path": path, "table": "messages"})
    left = list(reader.pushFilters([sqlite.ds.EqualTo(("label_id",), "L2"), sqlite.ds.IsNotNull(("label_id",)), sqlite.ds.EqualTo(("thread_id",), "t"), sqlite.ds.EqualTo(("label_id",), 2)]))
    assert len(left) == 4 and len(reader.conditions) == 2
    assert {r[2] for p in reader.partitions() for r in reader.read(p)} == {"L2"}
    bridge = sqlite.sqlite_table(spark, path, "messages", columns=["message_id", "label_id"]).where("label_id = 'L2'")
    assert bridge.columns == ["message_id", "label_id"] and bridge.count() == sum(r.label_id == "L2" for r in rows)
    assert "label_id" in bridge._jdf.queryExecution().executedPlan().toString()


def test_sqlite_stream_reads_what_is_new(spark, tmp_path):
    path, out = f"{tmp_path}/store.db", f"{tmp_path}/out"

    def sync(checkpoint, cursor):
        sqlite.sqlite_stream(spark, path, "messages", cursor, partitions=2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start(f"{out}-{checkpoint}").awaitTermination()
        return sorted(r.message_id for r in spark.read.schema("message_id string").parquet(f"{out}-{checkpoint}").collect())

    message_store(path, [(f"m{i}", "L", "x", "s", "2026-01-01") for i in range(5)])
    assert sync("a", "updated_at") == ["m0", "m1", "m2", "m3", "m4"]
    message_store(path, [("m5", "L", "x", "s", "2026-01-01"), ("m6", "L", "x", "s", "2026-01-02"), ("m1", "L", "y", "s", "2026-01-03")])
    assert sync("a", "updated_at") == ["m0", "m1", "m1", "m2", "m3", "m4", "m5", "m6"]  # what is there already is not read again
    assert sync("a", "updated_at") == ["m0", "m1", "m1", "m2", "m3", "m4", "m5", "m6"]
    assert sync("full", "rowid") == [f"m{i}" for i in range(7)]  # a full one begins anew


def test_fetch(spark):
    def get(url):
        if url.endswith("robots.txt"):
            return (200, "User-agent: *\nDisallow: /private") if "x.test" in url else (404, "")
        if "boom" in url:
            raise OSError("down")
        return (404, "") if "gone" in url else (200, "page " + url)

    urls = spark.createDataFrame([(f"https://x.test/{p}",) for p in ("a", "gone", "private/1", "boom", "a")] + [("https://y.test/private/1",)], "url string")
    got = {r.url: r for r in fetch.fetched(urls, get, delay=0.0).collect()}
    assert len(got) == 5 and got["https://x.test/a"].html == "page https://x.test/a" and got["https://x.test/gone"].error == "HTTP 404 for https://x.test/gone"
    assert got["https://x.test/private/1"].error_class == "RobotsError" and "down" in got["https://x.test/boom"].error and got["https://y.test/private/1"].error == ""
    store = spark.createDataFrame([("https://x.test/a", "h")], "url string, html string")
    assert {r.url: r.error_class for r in fetch.from_store(urls, store).collect()}["https://x.test/gone"] == "FetchError"


def test_headers_without_bodies(spark, tmp_path):
    """What headers give is what whole files give; bodies are not read."""
    head = '---\nid: "%d"\nsubject: "S %d"\nlabels: ["L"]\n---\n'
    texts = ["", "---", "---\n", "no header\n---\n", " \t---\r\nsubject: \"x\"\nlabels: [\"L\"]\n", head % (1, 1) + "body\n" * 100, "---\n" + "k: v\n" * 38 + 'subject: "in"\nlabels: ["L"]\n', "---\n" + "k: v\n" * 39 + 'subject: "out"\nlabels: ["L"]\n---\n', head % (2, 2) + "x" * 3_000_000, "é---\n", "---\nsubject: \"ü\"\nlabels: [\"L\"]\n---"]
    for i, t in enumerate(texts):
        (tmp_path / f"a b_{i}.md").write_bytes(t.encode())
    (tmp_path / "other.txt").write_text(head)
    whole = spark.read.option("pathGlobFilter", "*.md").text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    heads = render.read_headers(spark, str(tmp_path))
    key = lambda df: sorted(map(tuple, render.held_from_markdown(df, "L").collect()))
    assert key(heads) == key(whole) and len(key(heads)) == 5
    assert heads.count() == len(texts) - 1 and heads.agg(F.max(F.length("value"))).first()[0] < 10_000
    assert render.read_headers(spark, f"{tmp_path}/none").count() == 0


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), sinks.PAIRS)


def test_sinks_are_whole_or_absent(spark, tmp_path):
    raw, md = f"{tmp_path}/r", f"{tmp_path}/m"
    sinks.stage(pairs(spark, ("i1", "a_i1.md", "<p>", "text", ""), ("i2", "b_i2.md", "<p>", None, ""), ("i3", "c_i3.md", "<p>", " ", ""), ("i4", "d_i4.md", None, None, "no page")), md)
    (folder,) = sinks.staged(spark, md)
    assert [p.name for p in (tmp_path / "m").iterdir() if not p.name.startswith(".")] == [] and not (tmp_path / "r").exists()
    got = {i: (a, b, e) for i, a, b, e in sinks.settle(spark, folder, raw, md)}
    assert got["i1"] == (f"{raw}/i1.html", f"{md}/a_i1.md", "") and got["i2"][2] and got["i3"][2] == "no text in the article" and got["i4"][2] == "no page"
    assert [p.name for p in (tmp_path / "r").iterdir()] == ["i1.html"] and (tmp_path / "m" / "a_i1.md").read_text() == "text"
    assert {i: (a, b, e) for i, a, b, e in sinks.settle(spark, folder, raw, md)} == got  # finished already
    sinks.let_go(spark, folder)
    assert sinks.staged(spark, md) == [] and sinks.staged(spark, f"{tmp_path}/none") == []
    assert sinks.files_in(spark, [f"{tmp_path}/r", f"{tmp_path}/none"]).count() == 1
    (tmp_path / "r" / "folder").mkdir()
    (tmp_path / "r" / "folder" / "x").write_text("x")
    assert {r.path: r.is_dir for r in sinks.files_in(spark, [f"{tmp_path}/r/"]).collect()} == {f"{tmp_path}/r/i1.html": False, f"{tmp_path}/r/folder": True}
    paths = spark.createDataFrame([(f"{tmp_path}/r/{x}",) for x in ("i1.html", "folder", "none")], "path string")
    assert {(r.path[-4:], r.gone, r.error) for r in sinks.delete_paths(paths).collect()} == {("html", True, ""), ("lder", True, ""), ("none", False, "")}
    assert {r.gone for r in sinks.delete_paths(paths).collect()} == {False} and sinks.files_in(spark, [f"{tmp_path}/r"]).count() == 0


def test_a_failed_job_leaves_no_file_and_a_task_that_runs_twice_one(spark, tmp_path):
    md = f"{tmp_path}/m"
    rows = pairs(spark, *[(f"i{k}", f"f_i{k}.md", "<p>", f"text {k}", "") for k in range(40)]).repartition(4)
    bad = rows.withColumn("markdown", F.when(F.col("article_id") == "i33", F.raise_error(F.lit("boom"))).otherwise(F.col("markdown")))
    with pytest.raises(Exception, match="boom"):
        sinks.stage(bad, md)
    # a killed task may still write, but nothing says that it counts
    assert all(sinks.settle(spark, folder, f"{tmp_path}/r", md) == [] for folder in sinks.staged(spark, md)) and not (tmp_path / "r").exists()
    writer = sinks.PairWriter(f"{md}/{sinks.STAGING}x")
    first, again = ([writer.write(iter(rows.collect())) for _ in range(2)])
    writer.commit([again, None])
    got = sinks.settle(spark, f"{md}/{sinks.STAGING}x", f"{tmp_path}/r", md)
    assert len(got) == 40 == len(list((tmp_path / "r").iterdir())) and first.pairs[0][1] != again.pairs[0][1]
    assert (tmp_path / "m" / "f_i7.md").read_text() == "text 7"


def test_stream_batches_are_idempotent(spark):
    from docweir.operators import linkage

    refs = spark.createDataFrame([(0, "https://x.test/a?u", "Held title"), (1, "https://x.test/a", "other"), (2, "https://x.test/b", "New")], "ord int, url string, title string")
    index = linkage.corpus_index(spark.createDataFrame([("m", "held title", 0)], "message_id string, subject string, corpus_ord int"))
    from docweir.sources.tables import empty

    once = stream.merged(empty(spark, "articles"), refs, index, "L", "t0")
    assert {r.url: r.status for r in once.collect()} == {"https://x.test/a?u": "have", "https://x.test/b": "discovered"}
    assert sorted(stream.merged(once, refs, index, "L", "t1").collect()) == sorted(once.collect())
    # another label takes its listing over, and what failed is tried again
    assert {r.label_name for r in stream.merged(once, refs, index, "M", "t1").collect()} == {"M"}
    failed = once.withColumn("status", F.lit("failed"))
    assert {r.url: r.status for r in stream.merged(failed, refs, index, "L", "t1").collect()} == {r.url: r.status for r in once.collect()}
    rows = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.lit("x").alias("status"))
    assert stream.status_stream(rows).isStreaming


def test_every_query_has_a_stable_schema(spark):
    for name, f in queries.QUERIES.items():
        if name != "stream_backfill":
            assert f(spark, "/root/testdata/sf0.001").columns, name
