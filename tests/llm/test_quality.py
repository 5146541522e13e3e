import zlib

import numpy as np

from docweir.llm import quality, queries


def test_pairs_rank():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = (x[:, 1] - x[:, 4] + 0.1 * rng.normal(size=600) > -0.8).astype(int)
    model = quality.fit(x, y)
    s = model.score(x)
    assert ((s >= quality.CUT) == y).mean() > 0.95
    assert abs((s < quality.CUT).sum() - (y == 0).sum()) <= 1  # the quantile
    assert model.weights[1] > 0 > model.weights[4]


def test_one_label_and_none():
    x = np.random.default_rng(0).normal(size=(5, len(quality.FEATURES)))
    assert (quality.fit(x, np.ones(5)).score(x) >= quality.CUT).all()
    assert (quality.fit(x[:0], np.ones(0)).score(x) >= quality.CUT).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held)
    good = [got[r.doc_id].score for r in held if r.quality == 1]
    bad = [got[r.doc_id].score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.98
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) >= 0.96


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A plain text, with words."), (None, "x"), (3, "A plain text, with words."), (4, "so " * 50000), (5, "a" * 300000)]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (2, None, 0), (1, 7, 0)], "doc_id long, quality int, y int")
    model = quality.train(docs, labels)
    got = quality.predict(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[3] == 1 and by[4] == 0
    assert quality.predict(docs.limit(0), model).count() == 0
    assert quality.predict(docs, quality.train(docs, labels.limit(0))).count() == 7
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, p in by.items() if p}


def plain_features(text):
    """The features counted character by character and word by word."""
    import math

    text = text or ""
    words, lines = [], [x for x in text.split("\n") if x != ""]
    for w in text.split():
        words.append(w)
    n = len(words) or 1
    kinds = {"lower": 0, "upper": 0, "digit": 0, "space": 0, "mark": 0, "beyond": 0, "symbol": 0}
    for c in text:
        size = len(c.encode())
        kind = "beyond" if size > 1 else "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "space" if c in " \t\n\r\v\f" else "mark" if c in ".,;:?!'\"()-" else "symbol"
        kinds[kind] += size
    size = max(1, sum(kinds.values()) - kinds["space"])
    letters = max(1, kinds["lower"] + kinds["upper"] + kinds["beyond"])
    same = sum(1 for i in range(1, len(words)) if words[i] == words[i - 1]) / n
    bare = sum(1 for w in words if len(w) <= 3 and all(not c.isalnum() for c in w)) / n
    upper, symbol = kinds["upper"] / letters, kinds["symbol"] / size
    return [
        math.log(1 + len(words)), same, math.log(same + 0.01), len(dict.fromkeys(words)) / n, min(20.0, size / n), upper, 1.0 if upper > 0.5 else 0.0, kinds["digit"] / size,
        symbol, math.log(symbol + 0.01), kinds["mark"] / size, bare, math.log(bare + 0.01), text.count("!!") / n, 1 - len(dict.fromkeys(lines)) / (len(lines) or 1), 1.0 if words and words[-1].endswith((".", "?", "!")) else 0.0,
    ]


def test_features_against_plain_counts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", " ", "A", "a a a", "!! !!!! ?", "ÄÖ ÄÖ\n\nß\nß", "½ ³ ٣", "x y z", "- . ,", "A\x0bB\x0cC\x1cD", "😀 😀"]
    for t in texts:
        assert np.allclose(quality.features(t), plain_features(t), rtol=1e-12), t


def test_fit_is_the_minimum_and_the_threshold_the_quantile():
    """At the weights the loss over the pairs, summed pair by pair, has no slope, and any step makes it larger."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, len(quality.FEATURES)))
    y = (x[:, 2] + 0.5 * x[:, 7] + rng.normal(size=90) > 0.3).astype(int)
    model = quality.fit(x, y)
    mean, scale = [sum(c) / 90 for c in x.T], [np.sqrt(sum((v - sum(c) / 90) ** 2 for v in c) / 90) for c in x.T]
    z = [[min(8, max(-8, (v - m) / s)) for v, m, s in zip(row, mean, scale)] for row in x]
    good, bad = [i for i in range(90) if y[i]], [i for i in range(90) if not y[i]]
    draw, pairs = np.random.default_rng(5), max(len(good), len(bad)) * 10
    a = [i for _ in range(-(-pairs // len(good))) for i in draw.permutation(good)][:pairs]
    b = [i for _ in range(-(-pairs // len(bad))) for i in draw.permutation(bad)][:pairs]

    def loss(w):
        differences = ([p - q for p, q in zip(z[i], z[j])] for i, j in zip(a, b))
        return sum(np.log1p(np.exp(-sum(u * v for u, v in zip(d, w)))) for d in differences) / pairs + quality.RIDGE / 2 * sum(v * v for v in w)

    least = loss(model.weights)
    for k in range(len(model.weights)):
        for step in (1e-3, -1e-3):
            w = list(model.weights)
            w[k] += step
            assert loss(w) > least
    raw = sorted(sum(u * v for u, v in zip(row, model.weights)) for row in z)
    assert raw[len(bad) - 1] < model.threshold < raw[len(bad)]
    assert sum(s < quality.CUT for s in model.score(x)) == len(bad)


def test_query_against_plain_scores(spark):
    """Every row of the query's result, from the fitted numbers and the plain features."""
    import math

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    used = sorted((labels[d.doc_id], plain_features(d.text)) for d in docs if d.doc_id in labels)
    got = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("crc32(cast(doc_id as string)) % 5 != 0"))
    assert np.allclose(model.mean, np.mean([f for _, f in used], axis=0)) and len(got) == len(docs)
    for d in docs:
        z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(plain_features(d.text), model.mean, model.scale)]
        u = (sum(p * q for p, q in zip(z, model.weights)) - model.threshold) / model.spread
        score = quality.CUT / (quality.CUT + (1 - quality.CUT) * math.exp(-u))
        assert math.isclose(got[d.doc_id].score, score, rel_tol=1e-6, abs_tol=1e-12) and got[d.doc_id].predicted == int(score >= quality.CUT)
