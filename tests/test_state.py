import pytest
from pyspark.sql import functions as F

from docweir.operators import prune, state, status
from docweir.sources import tables

def now():
    return F.lit("now")


def article(i, status="discovered", **more):
    row = {"article_id": i, "label_name": "L", "label_id": "", "url": f"https://x.test/{i}", "title": "t", "published_at": "", "status": status, "match_reason": "", "raw_html_path": "", "markdown_path": "", "error_message": "", "created_at": "c", "updated_at": "u"}
    return row | more


def df(spark, rows):
    names = [f.split()[0] for f in tables.SCHEMAS["articles"].split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], tables.SCHEMAS["articles"])


def by_id(frame):
    return {r.article_id: r for r in frame.collect()}


def test_upsert_keeps_what_must_stay(spark):
    old = df(spark, [article("a", "done", raw_html_path="r"), article("b", "failed", error_message="e"), article("c")])
    new = df(spark, [article("a", "have", title="n", url="https://other"), article("b", "have"), article("d", "discovered")]).drop("raw_html_path", "markdown_path", "error_message", "created_at", "updated_at")
    got = by_id(state.upserted(old, new, now()))
    assert (got["a"].status, got["a"].title, got["a"].url, got["a"].raw_html_path, got["a"].created_at, got["a"].updated_at) == ("done", "n", "https://x.test/a", "r", "c", "now")
    assert (got["b"].status, got["b"].error_message) == ("have", "e")
    assert (got["c"].updated_at, got["d"].created_at, got["d"].raw_html_path) == ("u", "now", "")
    again = by_id(state.upserted(state.upserted(old, new, now()), new, now()))
    assert again == got
    assert state.upserted(old.limit(0), new, now()).count() == 3 and state.upserted(old, new.limit(0), now()).count() == 3


def test_marks(spark):
    old = df(spark, [article("a", "failed", error_message="e"), article("b", "done")])
    done = spark.createDataFrame([("a", "r", "m"), ("zz", "r", "m")], "article_id string, raw_html_path string, markdown_path string")
    got = by_id(state.marked_done(old, done, now()))
    assert (got["a"].status, got["a"].raw_html_path, got["a"].error_message) == ("done", "r", "") and len(got) == 2
    failed = spark.createDataFrame([("b", "x" * 1500)], "article_id string, error_message string")
    got = by_id(state.marked_failed(old, failed, now()))
    assert (got["b"].status, len(got["b"].error_message)) == ("failed", 1000)
    assert by_id(state.retried(old))["a"].status == "pending"
    ids = spark.createDataFrame([(f"x{i}",) for i in range(1200)] + [("a",)], "article_id string")
    assert state.number_of_ids(old, ids) == 1 and set(by_id(state.without_ids(old, ids))) == {"b"}
    assert [r.url for r in state.completed_urls(old, "L").collect()] == ["https://x.test/b"] and state.completed_urls(old, "M").count() == 0
    assert {r.status: r.n for r in state.counts(old).collect()} == {"failed": 1, "done": 1}
    assert state.invalid_statuses(df(spark, [article("q", "odd")])).count() == 1


def test_store(spark, tmp_path):
    store = state.StateStore(spark, f"file://{tmp_path}/state")
    assert store.read("articles").count() == 0 and store.last_run("L").count() == 0
    for i in range(5):
        store.write("articles", df(spark, [article(str(k)) for k in range(i + 1)]))
    assert store.read("articles").count() == 5 and len(store.versions("articles")) == 3
    run = store.start_run("L", "t0")
    assert store.last_run().first().completed_at is None
    store.complete_run(run, "t1", 7, 5, 1, 1)
    last = store.last_run("L").first()
    assert (last.run_id, last.completed_at, last.articles_written) == (1, "t1", 1)
    assert store.start_run("L", "t2", dry_run=True) == 2


def test_prune(spark):
    own = [f"web-{k:016x}" for k in range(5)]
    rows = df(spark, [article(own[0], "done"), article(own[1], "have"), article(own[2], "have"), article("18c0ffee", "done"), article(own[3], "failed", published_at="2026-05-01T00:00:00")])
    paths = spark.createDataFrame([(f"o/md/slug_x_{own[0]}.md", False), (f"o/raw/{own[0]}.html", False), (f"o/raw/{own[0]}.txt", False), (f"o/L/{own[0]}/", True), (f"o/raw/{own[1]}.html", False), (f"o/raw/{own[4]}.html", False), ("o/md/slug_18c0ffee.md", False)], "path string, is_dir boolean")
    got = by_id(prune.plan(rows, paths))
    assert set(got) == {own[0], own[1], own[3]} and len(got[own[0]].files) == 3 and got[own[3]].published_at == "2026-05-01"
    assert prune.totals(prune.plan(rows, paths)).first().asDict() == {"files_removed": 4, "directories_removed": 1, "rows_removed": 3}
    assert prune.totals(prune.plan(rows.limit(0), paths)).first().files_removed == 0


def test_status_queries(spark):
    m = spark.createDataFrame([(f"m{i}", s, f"2026-0{i + 1}-01") for i, s in enumerate(["pending", "pending", "fetched", "converted", "failed", "odd"])], "message_id string, status string, date string").withColumn("subject", F.lit("s"))
    assert {r.status: r.cnt for r in status.count_by_status(m).collect()}["pending"] == 2
    row = status.status_row(m, []).first()
    assert (row.pending, row.converted, row.total) == (2, 1, 5)
    bridge = spark.createDataFrame([("m0", "L1"), ("m3", "L1"), ("zz", "L1")], "message_id string, label_id string")
    assert [r.message_id for r in status.messages_for_label(m, bridge, F.col("label_id") == "L1").collect()] == ["m3", "m0"]
    sync = spark.createDataFrame([("L1", "h", "2"), ("L2", "h", "3")], "label_id string, history_id string, updated_at string")
    names = spark.createDataFrame([("L1", "News")], "label_id string, label_name string")
    assert [(r.label_id, r.label_name) for r in status.sync_states(sync, names).collect()] == [("L2", None), ("L1", "News")]
    assert status.label_filter(names, "NEW").count() == 1 and status.label_filter(names, "").count() == 1 and status.label_filter(names, "zz").count() == 0
    shown, more = status.preview(m, [F.col("date")], 4)
    assert shown.count() == 4 and more == 2
    assert status.timeline(m, "status", "date").first().first_date == "2026-01-01"


def test_missing_tables_are_empty(spark, tmp_path):
    assert tables.store_table(spark, f"{tmp_path}/none", "messages").count() == 0
    odd = spark.createDataFrame([("m", 3)], "message_id string, extra int")
    assert tables.conformed(odd, "messages").first().message_id == "m"


def test_a_merge_rewrites_the_buckets_that_it_touches(spark, tmp_path):
    store, ids = state.StateStore(spark, f"{tmp_path}/state", buckets=32), [f"a{k}" for k in range(500)]
    store.write("articles", df(spark, [article(i, "done" if k % 2 else "failed") for k, i in enumerate(ids)]))
    before = store.manifest("articles")["at"]
    assert len(before) == 32
    new = df(spark, [article(i, "have", title="n", url="https://other") for i in [*ids[:5], "b0", "b1", "b2", "b3", "b4"]]).drop("raw_html_path", "markdown_path", "error_message", "created_at", "updated_at")
    whole = state.upserted(store.read("articles"), new, now()).collect()
    touched = store.merge("articles", new, lambda old: state.upserted(old, new, now()))
    after = store.manifest("articles")["at"]
    assert 0 < len(touched) <= 10 and {k for k in after if after[k] != before.get(k)} == set(touched)
    assert sorted(store.read("articles").collect()) == sorted(whole) and len(whole) == 505
    assert len([p for p in (tmp_path / "state/articles/data/v=1").iterdir() if p.name.startswith("b=")]) == len(touched)
    # a bucket that is left empty is named no more; one that is never there costs nothing
    gone = spark.createDataFrame([(i,) for i in ids], "article_id string")
    store.merge("articles", gone, lambda old: state.without_ids(old, gone))
    assert {r.article_id for r in store.read("articles").collect()} == {"b0", "b1", "b2", "b3", "b4"}
    assert store.merge("articles", gone.limit(0), lambda old: old) == [] and len(store.manifest("articles")["at"]) <= 5
    # the number of buckets is the table's own
    assert state.StateStore(spark, f"{tmp_path}/state", buckets=7).manifest("articles")["buckets"] == 32


def test_old_versions_go_and_unfinished_ones_do_not_count(spark, tmp_path):
    store = state.StateStore(spark, f"{tmp_path}/state", buckets=8)
    for k in range(9):
        row = df(spark, [article(f"x{k}")])
        store.merge("articles", row, lambda old: old.unionByName(row))  # noqa: B023
    assert store.read("articles").count() == 9 and len(store.versions("articles")) == 3
    kept = {v for n in store.versions("articles") for v in store.manifest("articles", n)["at"].items()}
    there = {(int(b.name[2:]), int(v.name[2:])) for v in (tmp_path / "state/articles/data").iterdir() for b in v.iterdir() if b.name.startswith("b=")}
    assert kept <= there and len(there) <= len(kept) + 3
    (tmp_path / "state/articles/data/v=9/b=0").mkdir(parents=True)  # a version that was cut off before its manifest
    assert store.read("articles").count() == 9
    row = df(spark, [article("y")])
    store.merge("articles", row, lambda old: old.unionByName(row))
    assert store.read("articles").count() == 10
    with pytest.raises(Exception, match="outside the buckets"):
        store.merge("articles", row, lambda old: old.unionByName(df(spark, [article(str(k)) for k in range(50)])))
    assert store.read("articles").count() == 10
    (tmp_path / f"state/articles/manifest/{store.versions('articles')[-1] + 1}").write_text("{")
    store.versions = lambda name: [v for v in state.StateStore.versions(store, name)][:-1]  # another writer came between
    with pytest.raises(state.Conflict):
        store.merge("articles", row, lambda old: old)
