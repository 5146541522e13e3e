import hashlib
import math
import random

import duckdb
import pytest

from docweir.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster int, v int"


def plain(rows, k, rounds, dims, scale, seed=1):
    """The contract, row by row in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cs = [v for _, v in first]
    if not cs:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(cs)]
    last = [(i, *near(v)) for i, v in kept]
    total, per = sum(d for _, d, _ in last), {}
    for _, d, j in last:
        per[j] = per.get(j, 0) + d
    return [(i, j, d, per[j], total, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in last]


def check(spark, rows, parts=5, **kw):
    df = spark.createDataFrame([(i, e, 7, 7) for i, e in rows], SCHEMA).repartition(parts)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in clusters.lloyd(df, **kw).collect()), key=key)
    assert got == sorted(plain(rows, **kw), key=key)
    return got


def test_against_integers(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 4, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # one frequent vector
    rows += [(7, [9.0] * 6), (7, [9.0] * 6), (7, [-9.0] * 6), (None, [1.0] * 6)]
    rows += [(2001, None), (2002, []), (2003, [1.0] * 5), (2004, [1.0] * 7), (2005, [None] + [1.0] * 5), (2006, [float("nan")] * 6), (2007, [float("-inf")] * 6)]
    assert len(check(spark, rows, k=9, rounds=3, dims=6, scale=64)) == 454


def test_ties_empty_clusters_and_few_rows(spark):
    # equal vectors: all go to the first centroid, the others keep their place
    got = check(spark, [(i, [1.0, -1.0]) for i in range(10)], k=4, rounds=3, dims=2, scale=64)
    assert {r[1] for r in got} == {0}
    check(spark, [(1, [0.25, 0.75]), (2, [-0.3, 0.1])], k=16, rounds=3, dims=2, scale=64)
    check(spark, [(5, [0.0])], k=16, rounds=3, dims=1, scale=64)


def test_nothing(spark):
    assert check(spark, [], k=4, rounds=3, dims=2, scale=64) == []
    assert check(spark, [(None, [1.0, 2.0]), (1, None)], k=4, rounds=2, dims=2, scale=64) == []


def test_a_component_without_place_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0], 0, 0)], SCHEMA)
    with pytest.raises(Exception, match="after scaling"):
        clusters.lloyd(df, k=2, rounds=1, dims=2, scale=64).collect()


def test_sql_says_the_same(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)] + [(7, [0.1, 0.2, 0.3, 0.4])]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(con.execute(clusters.oracle_sql(k=5, rounds=2, dims=4)).fetchall()) == sorted(plain(rows, 5, 2, 4, 64))
