import math
import random

from pyspark.sql import functions as F

from docweir.llm import topk


def brute(rows, k, step):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            kept[i] = max(kept.get(i, q), q)
    out = []
    for i in sorted(kept):
        if i % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(kept[i], v)), j) for j, v in kept.items() if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return out


def run(spark, rows, k=5, step=5):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, c int")
    q = topk.quantised(df)
    return sorted(tuple(r) for r in topk.top_k(q, q.where(F.col("vec_id") % step == 0), k).collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # one frequent vector
    rows += [(2000, None), (2005, [1.0, None] + [0.0] * 6), (2010, [float("nan")] * 8), (2015, [float("inf")] * 8), (None, [1.0] * 8), (0, [2.0] * 8), (0, [2.0] * 8), (2020, [1.0, 2.0]), (2025, [])]
    old, topk.BLOCK_ROWS = topk.BLOCK_ROWS, 32
    try:
        assert run(spark, rows) == brute(rows, 5, 5)
    finally:
        topk.BLOCK_ROWS = old


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [-1.0]), (5, [-1.0])]) == brute([(0, [1.0]), (1, [-1.0]), (5, [-1.0])], 5, 5)


def test_bounds_skip_blocks():
    import numpy as np

    class Counted(dict):
        seen = 0

        def __getitem__(self, key):
            Counted.seen += key == "rows"
            return super().__getitem__(key)

    blocks = [Counted(ids=np.arange(4) + 10 * i, rows=np.full((4, 2), 100 - i), top=np.full(2, 100 - i), low=np.full(2, 100 - i)) for i in range(20)]
    got = topk._search(np.array([[1, 1]]), np.array([-1]), np.array([-(10**9)]), blocks, 4)
    assert got[0][1].tolist() == [200] * 4 and Counted.seen == 1


def test_with_bounds_of_many_groups_together_and_many_parts(spark, monkeypatch):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in centres[i % 5]]) for i in range(600)]
    want = brute(rows, 5, 5)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "PART_QUERIES", 25)
    assert run(spark, rows) == want
    for room in (1, 200, 400):
        monkeypatch.setattr(topk, "BOUNDS_BYTES", room)
        assert run(spark, rows) == want


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    rows, q = rng.integers(-9, 9, (50, 4)), rng.integers(-9, 9, (20, 4))
    bound = topk._bounds(q, rows.max(axis=0)[None], rows.min(axis=0)[None])
    assert (bound[:, 0] >= (q @ rows.T).max(axis=1)).all()
