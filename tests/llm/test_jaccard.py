import random

import numpy as np

import corpus_pipeline
from docweir.llm import jaccard, simhash


def brute(rows):
    """Smallest id of each group, by the similarity of all pairs."""

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(set(least.values()))


def test_stage_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 40, 100, 300]))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):  # copies of copies, so that groups are chains
            words = list(words)
            for _ in range(rng.randint(1, 1 + len(words) // 60)):
                words[rng.randrange(len(words))] = "new%d" % rng.randint(0, 99)
            texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), "", None, "a b", "a c"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == brute(rows) and len(got) < len(rows)
    assert jaccard.first_of_each_group(docs.limit(0)).count() == 0


def edited_groups(rng, groups, copies):
    """Groups of copies edited so that their similarities lie around the threshold."""
    texts = []
    for _ in range(groups):
        base = [f"v{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 200))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, len(words) // 40)):
                words[rng.randrange(len(words))] = "new%d" % rng.randint(0, 999)
            texts.append(" ".join(words))
    return texts


def test_sketches_rule_out_nothing_alike():
    rng = random.Random(4)
    sets = [jaccard.shingles(t) for t in edited_groups(rng, 6, 25)] + [jaccard.shingles(t) for t in ("a", "a b", "a b c d e f")]
    n = np.array(list(map(len, sets)))
    a, b, differ = jaccard.near_pairs(n, list(map(jaccard.odd_sketch, sets)))
    passed = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    assert len(passed) == len(a) < len(sets) ** 2 / 4
    alike = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 5 * both >= 4 * (n[i] + n[j] - both):
                alike += 1
                assert (j, i) in passed
    assert alike > 100
    for i, j, d in zip(a.tolist(), b.tolist(), differ.tolist()):
        assert d <= len(np.setxor1d(sets[i], sets[j]))
    old, jaccard.AT_ONCE = jaccard.AT_ONCE, 64
    try:
        again = jaccard.near_pairs(n, list(map(jaccard.odd_sketch, sets)))
        assert set(zip(again[0].tolist(), again[1].tolist())) == set(zip(a.tolist(), b.tolist()))
    finally:
        jaccard.AT_ONCE = old


def test_forest_spans():
    rng = np.random.default_rng(2)
    for m in (2, 10, 60):
        a, b = rng.integers(0, m, (2, 4 * m))
        a, b = a[a != b], b[a != b]
        differ, fp = rng.integers(0, 5, len(a)), rng.permutation(m) * 7
        picked = jaccard.forest(fp, a, b, differ)
        roots = lambda x, y: jaccard.unite(np.arange(m), x, y)
        assert (roots(a[picked], b[picked]) == roots(a, b)).all()
        assert len(picked) == m - len(np.unique(roots(a, b)))


def test_slices_change_nothing(spark):
    texts = edited_groups(random.Random(6), 3, 40)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, fp int, slot int, word int, bits int")
    want, old = brute(rows), jaccard.SLICE
    assert 3 < len(want) < len(rows)
    for jaccard.SLICE in (old, 7):
        try:
            got = jaccard.first_of_each_group(docs)
            assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
        finally:
            jaccard.SLICE = old


def brute_print(h, kind):
    """A kind's fingerprint in plain Python."""
    mixed = sorted((x * int(jaccard._FACTORS[kind, 0]) + int(jaccard._OFFSETS[kind, 0])) % (1 << 64) for x in h)[: jaccard.LEADING]
    weights = [round((1 << 24) * jaccard.RATIO**i) for i in range(len(mixed))]
    return kind << 32 | sum(1 << b for b in range(32) if sum(w if x >> b & 1 else -w for x, w in zip(mixed, weights)) > 0)


def test_fingerprints_propose_what_is_alike():
    assert jaccard.fingerprints_of(jaccard.shingles(None)) == []
    rng = np.random.default_rng(7)
    for n in (1, 2, 16, 17, 900, 3000):
        h = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        kinds = jaccard.PRINTS if n > jaccard.FEW_SHINGLES else jaccard.PRINTS_OF_FEW
        assert jaccard.fingerprints_of(h) == [brute_print(h.tolist(), k) for k in range(kinds)]
    # by the share of fingerprints that agree at a similarity of 0.8, few pairs in a million go unproposed
    for both, a, b in ((4, 1, 0), (8, 1, 1), (16, 4, 0), (16, 2, 2), (40, 10, 0), (160, 20, 20)):
        agree, n = 0, 400
        for _ in range(n):
            h = rng.integers(0, 1 << 64, both + a + b, dtype=np.uint64)
            x, y = (np.array(jaccard.fingerprints_of(p)) for p in (h[: both + a], np.r_[h[:both], h[both + a :]]))
            m = min(len(x), len(y))
            agree += (np.bitwise_count(x[:m] ^ y[:m]) <= 1).mean()
        assert (1 - agree / n) ** m < 5e-6


def test_bands_are_fingerprints_with_their_neighbours(spark):
    """Texts meet where fingerprints of one kind are equal or, by all pairs, a bit apart."""
    texts = edited_groups(random.Random(8), 4, 12)
    prints = [jaccard.fingerprints_of(jaccard.shingles(t)) for t in texts]
    distinct = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "fp long, prints array<long>")
    want, pairs = set(), set()
    for column in zip(*prints):
        near = {(v, w) for v in column for w in column if (v ^ w).bit_count() == 1 and (v & 0xFFFFFFFF).bit_count() % 2 == 0}
        pairs |= near
        rank = lambda v: (column.count(v), v)  # noqa: B023, E731
        for v in set(column):
            with_it = {v} | {w for pair in near if v in pair for w in pair if rank(w) < rank(v)}
            texts_of = frozenset(i for i, w in enumerate(column) if w in with_it)
            if len(texts_of) > 1:
                want.add((v, texts_of))
    old = simhash.SLICE
    for simhash.SLICE in (old, 2):
        try:
            flat = spark.createDataFrame([(v,) for v in {v for p in prints for v in p}], "fp long")
            found = list(map(tuple, simhash.neighbours(flat).collect()))
            assert len(found) == len(set(found)) > 50 and set(found) == pairs
        finally:
            simhash.SLICE = old
    got = {}
    for r in jaccard._met(distinct).collect():
        got.setdefault(r.band, set()).add(r.fp)
    assert {(b, frozenset(g)) for b, g in got.items()} == want
