import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from docweir.llm import simhash


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits=3):
    """rows: (doc_id, fp); by rows, quadratic."""
    fps = sorted({f for d, f in rows if d is not None})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return [(d, f, least[find(f)] if d is not None else None) for d, f in rows]


def test_codes_cover():
    code = simhash.CoveringCode(1)
    x = np.random.default_rng(0).integers(0, 1 << 32, 3000, dtype=np.uint64).astype(np.uint32)
    rows, word, lives = code.anchors(x)
    assert np.array_equal(np.sort(rows[lives]), np.arange(3000))
    at = {}
    for r, w in zip(rows, word):
        at.setdefault(int(r), set()).add(int(w))
    home = dict(zip(rows[lives].tolist(), word[lives].tolist()))
    assert all((int(x[r]) ^ w).bit_count() <= 4 for r, w in home.items())
    assert max((int(x[r]) ^ int(w)).bit_count() for r, w in zip(rows, word)) <= 5
    for bit in range(32):  # whoever is one bit away came to this anchor
        r2, w2, l2 = code.anchors(x[:200] ^ np.uint32(1 << bit))
        assert all(int(w) in at[int(r)] for r, w in zip(r2[l2], w2[l2]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\t\nx\x0b\x1c.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_links_reach_all_pairs(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:60]:
        for _ in range(rng.randint(1, 6)):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            fps.append(g)
    hub = rng.getrandbits(64)
    fps += [hub ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)][:1500]  # many residents: slices
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    old, simhash.SLICE = simhash.SLICE, 8
    try:
        got = simhash.components(simhash.links(distinct)).collect()
    finally:
        simhash.SLICE = old
    comp = {r.node: r.component for r in got}
    mine = {}
    for f in signed:
        mine.setdefault(comp.get(f, f), set()).add(f)
    theirs = {}
    for d, f, c in brute_components([(i, f & (1 << 64) - 1) for i, f in enumerate(signed)]):
        theirs.setdefault(c, set()).add(signed[d])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", " \n", "a b", "A  b", long, long + " x", long.replace("w7 ", "q "), "other words here", long, "z" * 5000]
    rows = [(10 + i, t, "c") for i, t in enumerate(texts)] + [(3, "a b", "c"), (None, "a b", "c"), (13, "a b", "c"), (13, "unlike", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_components([(d, brute_fingerprint(t)) for d, t, _ in rows]), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_codes_cover_wider_thresholds():
    rng = np.random.default_rng(2)
    for threshold in (2, 3):  # max_bits 4 to 7
        code = simhash.CoveringCode(threshold)
        x = rng.integers(0, 1 << 32, 400, dtype=np.uint64).astype(np.uint32)
        rows, word, lives = code.anchors(x)
        home = dict(zip(rows[lives].tolist(), word[lives].tolist()))
        for width, at in ((32, 0), (7, 23)):  # anywhere, and within the Hamming block
            flips = np.array([sum(1 << at + int(b) for b in rng.choice(width, threshold, replace=False)) for _ in x], np.uint64).astype(np.uint32)
            r, w, _ = code.anchors(x ^ flips)
            assert set(home.items()) <= set(zip(r.tolist(), w.tolist()))
