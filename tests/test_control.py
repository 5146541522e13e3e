import threading

import pytest
from pyspark.sql import functions as F

from docweir.operators import probe, status
from docweir.plans.control import Busy, Control


def test_operations_never_overlap(spark):
    seen = []
    c = Control(spark, lambda p: seen.append(p.stage))
    started, leave = threading.Event(), threading.Event()

    def slow(control):
        started.set()
        leave.wait(10)
        return 1

    t = threading.Thread(target=c.run, args=("slow", slow))
    t.start()
    started.wait(10)
    with pytest.raises(Busy):
        c.run("other", lambda control: 2)
    leave.set()
    t.join()
    assert c.run("other", lambda control: spark.range(5).count()) == 5 and seen[-1] == "ended"


def test_stop_between_labels(spark):
    c = Control(spark)

    def one(label):
        if label == "b":
            c.cancel()
        return label

    assert c.run("labels", lambda control: control.each(["a", "b", "c"], one)) == ["a", "b"]
    assert c.stopped and c.progress.counts == {"done": 2, "total": 3}


def test_cursors(spark):
    sync = spark.createDataFrame([("L1", "h1", "2"), ("L2", "h2", "5")], "label_id string, history_id string, updated_at string")
    new = spark.createDataFrame([("L1", "h9", "2"), ("L2", "h0", "1"), ("L3", "h3", "1")], "label_id string, history_id string, updated_at string")
    got = status.advanced(sync, new)
    assert {r.label_id: r.history_id for r in got.collect()} == {"L1": "h9", "L2": "h2", "L3": "h3"}
    assert status.cursor(got, "L3") == "h3" and status.cursor(got, "L3", full=True) is None and status.cursor(got, "zz") is None


def test_located(spark):
    want = {"[1]": ("", "[1]"), "[]": ("", "[]"), '{"a": [], "b": [1], "c": [{"x": 1}]}': ("c", '[{"x":1}]'), '{"z": [{"y": 1}], "a": [{"x": 1}, 2]}': ("z", '[{"y":1}]'), '{"q\'s": [{}]}': ("q's", "[{}]")}
    want |= dict.fromkeys(['{"a": 1}', '"x"', "no", "", '{"a": null, "b": {}}', "{}"], (None, None))
    df = spark.createDataFrame([(x,) for x in want], "payload string").select("payload", probe.located(F.col("payload")).alias("r"))
    assert {r.payload: (r.path, r.items) for r in df.selectExpr("payload", "r.path", "to_json(r.items) AS items").collect()} == want


def test_endpoint_items(spark):
    asked = spark.createDataFrame([(f"u{k}",) for k in range(5)], "url_template string")
    payloads = spark.createDataFrame([("u0", '[{"x": 1, "t": "s", "f": 1.5, "n": null, "b": true}, 2]'), ("u1", '{"k": [{}]}'), ("u2", "[7]"), ("u3", "{}"), ("u9", "[1]")], "url string, payload string")
    got = {r.url_template: r for r in probe.endpoint_items(asked, payloads).collect()}
    assert {k: (r.items_path, r.item_count, r.available_fields) for k, r in got.items()} == {"u0": ("", 2, ["b", "f", "n", "t", "x"]), "u1": ("k", 1, []), "u2": ("", 1, [])}
    assert got["u0"].sample_item == {"b": "true", "t": "s", "x": "1"} and got["u2"].sample_item == {}


def test_pages_of_rows(spark):
    rows = spark.range(10)
    assert [r.id for r in status.page_of(rows, [rows.id], 3, 4).collect()] == [4, 5, 6]
    assert status.page_of(rows, [rows.id]).count() == 10
