import itertools
import random
import re

from docweir.llm import licenses


WORDS = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
PAIRS = lambda w: list(zip(w, w[1:]))


def brute(text, templates=licenses.TEMPLATES, threshold=0.8):
    text = text or ""
    passages = text.split("\n") + [p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p]
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a else 0
    out, pairs = [], PAIRS(WORDS(text))
    for name, t in templates:
        wide, known = len(PAIRS(WORDS(t))), set(PAIRS(WORDS(t)))
        out += [(dice(set(PAIRS(WORDS(p))), known), name, i, None) for i, p in enumerate(passages)]
        out += [(dice(set(pairs[i : i + wide]), known), name, None, i) for i, g in enumerate(pairs) if g in known]
    return [m for m in out if m[0] >= threshold]


def matches(df, *how):
    return sorted(((r.doc_id, sorted(((m.dice, m.license, m.passage, m.word) for m in r.matches), key=str)) for r in licenses.license_scan(df, *how).collect()), key=str)


def expected(df, *how):
    return sorted(((r.doc_id, sorted(brute(r.text, *how), key=str)) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    wrapped = "\n".join(" * " + " ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    texts = [
        None, "", "\n\n", "one", "Released under the MIT License.", "x\nreleased UNDER the mit-license\ny", "Released under an MIT License.", mit, "\n\n" + mit.replace(", ", ",\n") + "\n \nother",
        mit.replace("sublicense", "sub-license") + "\n" + mit, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "word " * 20000, "the same the same " * 50 + "\n", "Ünïcode «Licensed» under CC BY-NC 4.0!",
        "A small tool by its authors. Released under the MIT License. See the LICENSE file for details and write to us.", "/*\n * Copyright 2020 Some One\n *\n" + wrapped + "\n *\n * The above notice goes with all copies.\n */\nint main;",
        "end of text released under the mit", "released under the mit license " * 300,
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, mit, 0), (4, texts[4], 1)], "doc_id long, text string, matches int")
    assert matches(df) == expected(df)
    best = {r.doc_id: (r.license, r.licenses) for r in licenses.best_license(licenses.license_scan(df)).collect()}
    assert best[10] == ("Apache-2.0", "Apache-2.0,MIT") and best[0] == (None, "")
    assert best[14] == best[15] == ("MIT", "MIT")


def test_random_edits_against_brute_force(spark):
    rng, bodies = random.Random(5), [t.split() for _, t in licenses.TEMPLATES]
    texts = []
    for k in range(60):
        words = [rng.choice("license the of under software free a to version is".split()) for _ in range(rng.randrange(30))]
        for w in bodies[k % len(bodies)]:
            edit = rng.random()
            words += [] if edit < 0.04 else [w, "more"] if edit < 0.08 else [w]
        texts.append("".join(w + rng.choice((" ", " ", "\n", " # ")) for w in words + ["and", "so", "on"] * rng.randrange(9)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for how in ((), (licenses.TEMPLATES[:3], 0.5), (licenses.TEMPLATES, 1.0)):
        assert matches(df, *how) == expected(df, *how)
    assert sum(bool(m) for _, m in matches(df)) > 30


def test_demands_are_met_by_every_text_with_enough_bigrams():
    rng = random.Random(3)
    assert licenses.demands(["a bb", "bb ccc", "ccc d"], 3) == [(["ccc", "a"], 2), (["bb", "d"], 2)]
    for _ in range(200):
        grams = list({f"{rng.choice('abcde')} {rng.choice('abcdef')}" for _ in range(rng.randrange(1, 9))})
        least = rng.randrange(1, len(grams) + 1)
        for held in itertools.combinations(grams, least):
            present = {w for g in held for w in g.split()}
            assert all(len(present.intersection(words)) >= n for words, n in licenses.demands(grams, least))


def test_no_templates(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert [(r.doc_id, r.matches) for r in licenses.license_scan(df, [("none", "one")]).collect()] == [(1, [])]


def test_empty_table(spark):
    assert licenses.best_license(licenses.license_scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
