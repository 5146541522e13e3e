import random

import numpy as np

from docweir.llm import decontaminate as d
from docweir.llm import queries


def brute_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.MATCH if a[i - 1] == b[j - 1] else d.MISMATCH), h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP)
    return max(map(max, h))


def test_alignment():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))], [rng.randint(0, 4) for _ in range(rng.randint(0, 15))]
        assert d.alignment_score(np.array(a), np.array(b, np.int64)) == brute_score(a, b)


def brute(docs, items):
    """Every document against every item, over the whole text."""
    out = []
    for doc_id, text in docs:
        for item_id, item in items:
            a = d.words_of(item)
            if a and item_id is not None:
                s = brute_score(a, d.words_of(text)) / (d.MATCH * len(a))
                if s >= d.THRESHOLD:
                    out.append((doc_id, item_id, round(s, 9)))
    return sorted(out, key=str)


def edited(words, rng, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out += ["zzz"] if x < share * 2 / 3 else [w, "yyy"] if x < share else [w]
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(16, 40)))) for i in range(12)] + [(50, "one two"), (51, "single"), (52, ""), (53, None), (None, "null id item here"), (3, "again the same id but other words")]
    docs = []
    for n in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        if n % 2:
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng.choice(items[:12])[1].split(), rng, rng.choice([0, 0.1, 0.25, 0.5]))
        docs.append((n, " ".join(words).capitalize() + "."))
    docs += [(100, None), (101, ""), (None, items[0][1]), (5, docs[5][1]), (102, "x " * 3000 + items[1][1]), (103, "One, TWO"), (104, "a single b"), (105, " ".join([items[2][1]] * 30))]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in d.leaks(df, bench).collect()), key=str)
    assert got == brute(docs, items)
    old, d.BLOCK_BYTES = d.BLOCK_BYTES, 300
    try:
        assert sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in d.leaks(df, bench).collect()), key=str) == got
        kept = d.without_leaks(df, bench)
        assert kept.columns == df.columns
        assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted(a for a, _ in docs if a is not None and a not in {x[0] for x in got})
    finally:
        d.BLOCK_BYTES = old


def test_seeds_are_the_rarer_words_pairs():
    items = d.Items([(1, "a b c d e f g h i j")])
    frequency = np.arange(len(items.pairs))
    kept = items.rare(frequency)
    cost = np.bincount(items.place, weights=frequency[items.which], minlength=10)
    assert (~kept).sum() == (10 - 3) // 2 and cost[kept].max() <= cost[~kept].min()
    assert items.rare(frequency * 10**9).tolist() == kept.tolist()


def patterns(words, kind):
    """Copies with every second or third word changed, left out or followed by another."""
    out = []
    for k, w in enumerate(words):
        step, how = int(kind[-1]), kind[:-1]
        hit = k % step == step - 1
        out += [w] if not hit else {"change": ["zz"], "drop": [], "add": [w, "zz"]}[how]
    return out


def test_no_edited_copy_is_lost():
    rng = random.Random(8)
    links = 0
    for _ in range(120):
        vocab = [f"w{i}" for i in range(rng.choice([4, 12, 200]))]
        items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 11, 20, 33])))) for i in range(6)]
        texts = []
        for _ in range(6):
            words = [rng.choice([*vocab, "q"]) for _ in range(rng.randint(0, 30))]
            at, own = rng.randint(0, len(words)), rng.choice(items)[1].split()
            kind = rng.choice(["change2", "change3", "drop2", "drop3", "add1", "add2", "add3", "mixed"])
            words[at:at] = edited(own, rng, rng.choice([0.1, 0.3, 0.5])) if kind == "mixed" else patterns(own, kind)
            texts.append(" ".join(words))
        got = d.Items(items).find(texts)
        want = [[(i, s) for i, x in items if (s := brute_score(x.split(), t.split()) / (2 * len(x.split()))) >= (d.THRESHOLD if len(x.split()) >= d.SHORT else 1)] for t in texts]
        assert got == want
        links += sum(map(len, want))
    assert links > 500


def test_short_items_stand_whole():
    items = d.Items([(1, "one"), (2, "one two"), (3, "a b c d e"), (4, "a b c d e f")])
    assert items.find(["x one y", "one x two", "x a b c d x", "A b, c! d e", None, ""]) == [[(1, 1.0)], [(1, 1.0)], [(4, 8 / 12)], [(3, 1.0), (4, 10 / 12)], [], []]


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert d.leaks(docs.limit(0), bench).count() == 0 and d.leaks(docs, bench.limit(0)).count() == 0
    assert d.without_leaks(docs, bench.limit(0)).count() == 1 and d.leaks(docs, bench).count() == 1


def test_query(spark):
    got = queries.op10_decontaminate(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in got}
    exact = {(i, k) for i, t in texts.items() for k, x in items.items() if " ".join(d.words_of(x)) in " ".join(d.words_of(t))}
    assert exact and exact <= found


def test_frequent_grams_find_edited_copies(spark):
    item = " ".join(f"w{i}" for i in range(15))
    copy = "w0 zz w2 w3 zz w5 w6 zz " + " ".join(f"w{i}" for i in range(8, 15))  # only grams of the item's end are whole
    docs = [(1, "other " + copy + " words"), (2, ("w8 w9 w10 " + "x w9 w10 w11 x w10 w11 w12 x w11 w12 w13 x w12 w13 w14 x ") * 1001)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = d.leaks(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(1, 7, brute_score(d.words_of(item), d.words_of(copy)) / 30)] == [tuple(r) for r in got if r.doc_id == 1]


def test_memory_of_a_frequent_pair(monkeypatch):
    """Every item has the pair that a text repeats; what is held at once does not grow with their product."""
    import tracemalloc

    rng = random.Random(5)
    items = [(i, " ".join([*(f"w{rng.randint(0, 900)}" for _ in range(4)), "a b", *(f"w{rng.randint(0, 900)}" for _ in range(5))])) for i in range(200)]
    texts = ["a b " * 40_000 + items[7][1], "x y", items[3][1]]
    block = d.Items(items)
    monkeypatch.setattr(d, "POSTINGS", 100_000)
    tracemalloc.start()
    got = block.find(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (7, 1.0) in got[0] and got[1] == [] and (3, 1.0) in got[2]
    assert peak < 60_000_000, peak  # 16 million places meet


def test_postings_in_any_number_give_the_same(monkeypatch):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 5, 8, 20])))) for i in range(20)]
    texts = [" ".join(rng.choice([*vocab, "q"]) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    want = d.Items(items).find(texts)
    for most in (1, 7, 100):
        monkeypatch.setattr(d, "POSTINGS", most)
        assert d.Items(items).find(texts) == want
