import math
import zlib
from functools import cache
from itertools import product

import numpy as np

from docweir.llm import language, queries
from docweir.llm.tokenizer import public_path

PATH = public_path("piece_bpe_32k.model")


def brute(word, vocab, p):
    """Sum over all ways to cut the word."""

    @cache
    def total(i):
        if i == len(word):
            return 1.0
        out = 0.0
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in vocab:
                out += p[vocab[word[i:j]]] * total(j)
            elif j == i + 1:
                out += p[-1] * total(j)
        return out

    return total(0)


def cuts(word, vocab):
    for marks in product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, m in enumerate(marks, 1):
            if m:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        if all(x in vocab or len(x) == 1 for x in parts):
            yield parts


def test_forward_sums_all_segmentations():
    vocab = language.vocabulary(PATH)
    rng = np.random.default_rng(0)
    p = rng.random((len(vocab) + 1, 3)) / 1000
    words = ["▁the", "▁straße", "▁日本", "▁" + "x" * 31, "a", "▁segmentation"]
    got = language.forward(words, vocab, p)
    for w, line in zip(words, got):
        for k in range(3):
            assert math.isclose(line[k], math.log(brute(w, vocab, p[:, k])), rel_tol=1e-9)


def test_expected_counts():
    vocab = language.vocabulary(PATH)
    p = np.random.default_rng(1).random(len(vocab) + 1) / 100
    got = {}
    for piece, x in language.expected("▁these", vocab, p):
        got[piece] = got.get(piece, 0) + x
    weights = {tuple(c): math.prod(p[vocab.get(x, -1)] for x in c) for c in cuts("▁these", vocab)}
    total = sum(weights.values())
    want = {}
    for c, w in weights.items():
        for x in filter(vocab.__contains__, c):
            want[vocab[x]] = want.get(vocab[x], 0) + w / total
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) >= 0.95


def test_odd_rows(spark):
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("lost", None)], "text string, lang string")
    model = language.train(train, PATH)
    assert model.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the mat"), (5, "die Katze"), (None, "the"), (4, "the mat"), (6, "the " * 30000), (7, "x" * 100000), (8, "日本語" * 50), (9, "½ ² 4")]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, lang_pred string")
    got = sorted(((r.doc_id, r.lang_pred) for r in language.predict(df, model).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2, 3, 9)] == [(1, "und"), (2, "und"), (3, "und"), (9, "und")] and len(got) == len(rows)
    assert {g for g in got if g[0] in (4, 5, 6, None)} == {(4, "en"), (5, "de"), (6, "en"), (None, "en")}
    none = language.train(train.where("lang is null"), PATH)
    assert [r.lang_pred for r in language.predict(df.limit(1), none).collect()] == ["und"]
    assert language.predict(df.limit(0), model).count() == 0


def test_copies_do_not_shrink_the_sample(spark):
    rows = [("zzz", "en")] * 2000 + [(f"the cat sat on the mat {'x' * i}", "en") for i in range(20)] + [(f"der Hund und die Katze {'x' * i}", "de") for i in range(20)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), PATH, train_docs=21)
    the = language.vocabulary(PATH)["▁the"]
    assert model.p[the, model.languages.index("en")] > 0.05


def test_long_words_are_whole():
    vocab = language.vocabulary(PATH)
    p = np.random.default_rng(3).random((len(vocab) + 1, 2)) / 10
    p[-1] = language.UNKNOWN
    words = ["▁donaudampfschifffahrtsgesellschaftskapitänsmütze", "▁" + "x" * 30, "▁und", "▁" + "日本語é" * 12]
    for w, line in zip(words, language.forward(words, vocab, p)):
        assert np.allclose(line, [math.log(brute(w, vocab, p[:, k])) for k in range(2)], rtol=1e-9)
    assert language.words_of("Donau" * 40) == ["▁" + "donau" * 40]
    long = "▁" + "straße" * 2000
    assert np.isfinite(language.forward([long], vocab, p / 1000)).all()
    old, language.PLAIN = language.PLAIN, 4
    try:
        scaled = language.forward(words, vocab, p), language.expected(words[0], vocab, p[:, 0])
    finally:
        language.PLAIN = old
    assert np.allclose(scaled[0], language.forward(words, vocab, p), rtol=1e-9)
    language.PLAIN = 99
    try:
        plain = language.expected(words[0], vocab, p[:, 0])
    finally:
        language.PLAIN = old
    assert [x for x, _ in plain] == [x for x, _ in scaled[1]] and np.allclose([n for _, n in plain], [n for _, n in scaled[1]], rtol=1e-7, atol=1e-12)
    assert all(math.isfinite(n) for _, n in language.expected(long, vocab, (p / 1000)[:, 0]))


def test_predict_against_brute_force(spark):
    vocab = language.vocabulary(PATH)
    p = np.random.default_rng(5).random((len(vocab) + 1, 3)) / 100
    model = language.Model(PATH, ["aa", "bb", "cc"], p)
    rng = __import__("random").Random(5)
    pool = ["The", "straße", "x", "été", "Donaudampfschifffahrtsgesellschaftskapitän", "of", "12", "a1b", "日本"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["of", "12 3"]
    old, language.KEPT = language.KEPT, 6
    try:
        local = [s for i in range(0, len(texts), 7) for s in model.score(texts[i : i + 7])]  # what is kept is forgotten in between
    finally:
        language.KEPT = old
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    for i, text in enumerate(texts):
        words = ["▁" + w for w in __import__("re").findall(r"[^\W\d_]+", text.lower())]
        logs = [sum(math.log(brute(w, vocab, p[:, k])) for w in words) for k in range(3)]
        best = max(range(3), key=logs.__getitem__)
        want = (model.languages[best], 1 / sum(math.exp(x - logs[best]) for x in logs)) if words else ("und", 0.0)
        for name, score in (got[i], local[i]):
            assert name == want[0] and math.isclose(score, want[1], rel_tol=1e-9)


def test_more_languages_than_the_model_takes(spark):
    rows = [(f"the cat {w}", "en") for w in ("sat", "ran", "ate")] + [(f"der Hund {w}", "de") for w in ("ist", "war")] + [(f"noise {i}", f"l{i:03}") for i in range(600)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert language.train(df, PATH, rounds=1, max_languages=3).languages == ["de", "en", "l000"]
    assert len(language.train(df, PATH, rounds=1).languages) == 602


def test_memory_does_not_grow_with_languages_and_texts(monkeypatch):
    """Many languages, many words in a batch, and one text with more words than find room."""
    import tracemalloc

    vocab = language.vocabulary(PATH)
    p = np.random.default_rng(7).random((len(vocab) + 1, 300)) / 100
    model = language.Model(PATH, [f"l{k:03}" for k in range(300)], p)
    rng = __import__("random").Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(n)) for n in [20] * 60 + [3000] + [20] * 60]
    want = list(model.score(texts))
    monkeypatch.setattr(language, "KEPT", 300 * 500)
    monkeypatch.setattr(language, "AT_ONCE", 300 * 31 * 50)
    model._forget()
    tracemalloc.start()
    got = list(model.score(iter(texts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [a for a, _ in got] == [a for a, _ in want] and np.allclose([b for _, b in got], [b for _, b in want], rtol=1e-6)
    assert peak < 30_000_000, peak  # 5,400 words of 300 languages alone would be 13 MB, their forward pass 400 MB
