import zlib
from collections import Counter

import numpy as np

from docweir.llm import queries, sharding


def test_matrix_has_exact_sums_and_the_right_law():
    m = sharding.communication_matrix([5, 0, 7, 12], [6, 6, 6, 6], 1)
    assert [sum(x) for x in m] == [5, 0, 7, 12] and [sum(x) for x in zip(*m)] == [6, 6, 6, 6]
    rng = __import__("random").Random(4)
    mine = Counter(sharding._hypergeometric(rng, 30, 50, 20) for _ in range(20000))
    theirs = Counter(np.random.default_rng(0).hypergeometric(30, 50, 20, 200000).tolist())
    assert all(abs(mine[k] / 20000 - theirs[k] / 200000) < 0.012 for k in range(21))
    big = [sharding._hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**6) for _ in range(50)]
    assert abs(np.mean(big) - 3e5) < 500 and 200 < np.std(big) < 800


def test_sizes_slots_and_repeatability(spark):
    rows = [(i, f"t{i % 40}" if i % 7 else None, i % 3) for i in range(9001)] + [(None, None, None), (5, "t5", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shuffled(df, 8).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 9003 and max(sizes.values()) - min(sizes.values()) <= 1 and sorted(sizes) == list(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert sorted(got, key=str) == sorted(sharding.shuffled(df.repartition(3), 8).collect(), key=str)
    near = np.corrcoef([r.doc_id for r in got if r.doc_id is not None], [r.slot for r in got if r.doc_id is not None])[0, 1]
    assert abs(near) < 0.05
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None and r.text) == sorted((a, b) for a, b, _ in rows if a is not None and b)


def test_every_row_can_go_anywhere(spark):
    df = spark.createDataFrame([(i,) for i in range(16)], "doc_id long")
    seen = Counter()
    for seed in range(40):
        for r in sharding.shuffled(df, 4, seed).collect():
            seen[(r.doc_id, r.shard)] += 1
    assert all(1 <= seen[(i, s)] <= 25 for i in range(16) for s in range(4))


def test_probabilities_at_any_size():
    from fractions import Fraction
    from math import comb, exp

    for good, bad, draws in ((30, 50, 20), (1, 9, 5), (700, 20, 600), (400, 4000, 37)):
        p = draws / (good + bad)
        for k in range(max(0, draws - bad), min(draws, good) + 1):
            want = Fraction(comb(good, k) * comb(bad, draws - k), comb(good + bad, draws))
            got = exp(sharding._binomial(k, good, p) + sharding._binomial(draws - k, bad, p) - sharding._binomial(draws, good + bad, p))
            assert abs(got - float(want)) < 1e-12
    n, rng = 10**12, __import__("random").Random(1)
    drawn = [sharding._hypergeometric(rng, n, 7 * n, 10**8) for _ in range(200)]
    assert abs(np.mean(drawn) - 1.25e7) < 1500 and 2500 < np.std(drawn) < 4200


def test_many_copies_of_a_row_are_numbered_in_parts(spark):
    df = spark.range(6000, numPartitions=7).selectExpr("if(id % 3 = 0, 'x', cast(id as string)) as text", "id % 2 as slot")
    got = sharding.shuffled(df, 5).collect()
    assert len({(r.shard, r.slot) for r in got}) == 6000 and Counter(r.text for r in got)["x"] == 2000
    assert sorted(map(str, got)) == sorted(map(str, sharding.shuffled(df.repartition(2), 5).collect()))


def test_few_rows(spark):
    assert sharding.shuffled(spark.createDataFrame([], "doc_id long"), 8).count() == 0
    assert [(r.shard, r.slot) for r in sharding.shuffled(spark.createDataFrame([(1,)], "doc_id long"), 8).collect()] == [(0, 0)]


def test_query(spark):
    df = queries.op6_sharding(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert df.count() == 200


def test_query_shards_whole_rows(spark, monkeypatch):
    seen, whole = [], sharding.shuffled
    monkeypatch.setattr(sharding, "shuffled", lambda df, shards: seen.append(df.columns) or whole(df, shards))
    got = queries.op6_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert seen == [docs.columns]
    want = sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == want
