import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docweir.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, slice int, best int"


def plain(rows, step, positives=5, negatives=10, least=30, most=90):
    kept = {}
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            x = ([math.floor(256 * x) for x in e], label)
            kept[i] = max(kept.get(i, x), x)
    out = []
    for i, (q, label) in kept.items():
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, lab) for j, (v, lab) in kept.items() if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and least * -s <= 100 * -x[0] <= most * -s][:negatives]
            out += [(i, j, r, c, -s, -t) for r, (t, c, _) in enumerate(inside, 1)]
    return sorted(out)


def run(spark, rows, step, parts=4, **kw):
    df = hn.quantised(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(parts))
    return sorted(tuple(r) for r in hn.hard_negatives(df, df.where(F.col("vec_id") % step == 0), **kw).collect())


def clustered(n, dims, seed, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.5) for c in centres[i % 6]], (i % 6) % labels if rng.random() < 0.7 else rng.randrange(labels)) for i in range(n)]


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(hn, "SLICE_ROWS", 100)
    monkeypatch.setattr(hn, "HELD", 20)
    monkeypatch.setattr(hn, "TOGETHER", 7)


def test_against_brute_force(spark, small_cells):
    rows = clustered(600, 10, 1)
    rows += [(1000 + i, [0.5] * 10, i % 2) for i in range(300)]  # one frequent vector under two labels
    rows += [(5, [3.0] * 10, 1), (5, [3.0] * 10, 2), (2000, [0.0] * 10, 0), (2010, [-0.5] * 10, 1), (2020, [1.0, 2.0], 0), (2030, [], 1)]
    rows += [(3000, None, 1), (3010, [1.0, None], 1), (3020, [float("nan")] * 10, 1), (3030, [float("inf")] * 10, 1), (None, [1.0] * 10, 1), (3040, [1.0] * 10, None)]
    got = run(spark, rows, 10)
    assert got == plain(rows, 10) and len(got) > 2000


def test_other_windows_and_counts(spark, small_cells):
    rows = clustered(400, 5, 2, labels=40)
    for kw in ({"positives": 2, "negatives": 3, "least": -50, "most": 100}, {"positives": 1, "negatives": 400, "least": 0, "most": 200}):
        assert run(spark, rows, 9, **kw) == plain(rows, 9, **kw)


def test_ties_and_small_tables(spark):
    equal = [(i, [1.0, 1.0], i % 2) for i in range(40)]
    assert run(spark, equal, 10, most=100) == plain(equal, 10, most=100)
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 0)], [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 0)], [(1, [1.0], 1)], [(None, None, None)]):
        assert run(spark, rows, 10) == plain(rows, 10)


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (20, 16))
    x = (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 60, (4000, 16))).astype(np.int64)
    books = hn.Codebooks(x[:1000].astype(np.float64), 1)
    codes, norms = books.encode(x)
    score, error = books.bounds(x[:40].astype(np.float64), codes, norms)
    true = x[:40] @ x.T
    assert (np.abs(true - score) <= error).all()
    held = hn.Held(np.arange(40), np.zeros(40, np.int64), x[:40], np.full((40, 1), -(10**15)), np.full((40, 1), 10**15), np.full((40, 1, 5), hn.LEAST), np.full((40, 1, 5), hn.MOST))
    made = held.search(books, np.arange(4000), np.zeros(4000, np.int64), x, codes, norms, True)
    assert made < 0.25 * 40 * 4000  # most products need not be made
    for i in range(40):
        want = sorted((-true[i, j], j) for j in range(4000) if j != i)[:5]
        assert [(-s, c) for s, c in zip(held.scores[i, 0], held.found[i, 0])] == want


def test_codebooks_of_odd_samples():
    for x in (np.zeros((5, 1)), np.zeros((1, 3)), np.ones((2, 9)) * 1e9):
        books = hn.Codebooks(x, 1)
        assert len(books.entries) == -(-x.shape[1] // hn.PART_DIMS)


def test_sql_says_the_same():
    rows = [(10 * i, e, label) for i, e, label in clustered(300, 6, 3)] + [(10, [0.1] * 6, 4), (None, [1.0] * 6, 1), (70, None, 1), (77, [1.0] * 6, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    turned = [(i, e, (label + 1) % 10 if i is not None and label is not None and i % 7 == 0 else label) for i, e, label in rows]
    assert sorted(con.execute(hn.oracle_sql()).fetchall()) == plain(turned, 100)
