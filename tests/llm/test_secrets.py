import hashlib
import random
import re

import numpy as np

from docweir.llm import queries, secret_scan


def plain_base(text):
    """The contract's three kinds, matched by one step at a time."""
    out = []
    for kind, p, ok in (
        ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=\-]+)""", lambda m: len(m[1]) >= 12),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ):
        at, p = 0, re.compile(p)
        while m := p.search(text, at):
            if ok(m):
                out.append((kind, m.start(), m.end()))
            at = m.end()
    return sorted(out, key=lambda s: (s[1], secret_scan.RANK[s[0]]))


def plain_battery(word, alphabet):
    """Chi-squared, changes and serial correlation as sums over the word."""
    n, a = len(word), len(alphabet)
    chi = sum((word.count(c) - n / a) ** 2 / (n / a) for c in alphabet)
    x = [alphabet.index(c) for c in word]
    mean = sum(x) / n
    own = sum((v - mean) ** 2 for v in x)
    return chi, (sum((p - mean) * (q - mean) for p, q in zip(x, x[1:])) / own if own else 1.0)


def some_texts():
    rng = random.Random(4)
    bits = ["password", "PassWd", "secret", "tOKen", "api_key", "apikey", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "\t", "\n", "AKIA", "AKIAKIA", "deadbeef", "0123456789", "ABCDEFGHIJKLMN", "a", "Z9", "+/", "_.-", "é", "\U0001f600", "x" * 11]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)]


def test_base_spans_against_a_plain_version():
    for t in some_texts():
        assert secret_scan.base_spans(t) == plain_base(t), t


def test_a_failing_match_is_not_tried_again():
    assert secret_scan.base_spans("token=password=abcdefghijklm") == [("assign", 0, 28)]
    assert secret_scan.base_spans("token=short secret:abcdefghijkl") == [("assign", 12, 31)]
    assert secret_scan.base_spans("token=a=password") == []


def test_battery_is_what_it_says():
    rng = np.random.default_rng(3)
    for name in ("hex", "base32", "base62"):
        a = secret_scan.ENCODINGS[name]
        codes = rng.integers(0, len(a), (50, 40))
        p = secret_scan.battery(codes, name)
        chis, rs = zip(*(plain_battery("".join(a[c] for c in row), a) for row in codes))
        # the p-values fall as the statistics leave their expectation
        order = np.argsort(np.abs(np.array(rs) + 1 / 40))
        assert (np.diff(p[order, 2]) <= 1e-12).all()
        high = np.array(chis) > len(a) - 1
        assert (np.diff(p[high, 0][np.argsort(np.array(chis)[high])]) <= 1e-12).all()


def test_uniform_words_pass_for_uniform():
    rng = np.random.default_rng(1)
    for name, a in secret_scan.ENCODINGS.items():
        p = secret_scan.battery(rng.integers(0, len(a), (3000, 32)), name)
        assert (np.abs((p < 0.1).mean(axis=0) - 0.1) < 0.05).all(), (name, (p < 0.1).mean(axis=0))
        assert (secret_scan.uniform_p(secret_scan.fisher(p)) < secret_scan.UNIFORM).mean() < 0.01


def test_p_values_of_ordinary_words_hold_for_words_not_seen():
    for name in secret_scan.ENCODINGS:
        for n in (16, 28, 40, 100):
            total = secret_scan.fisher(secret_scan.battery(secret_scan.ordinary_words(name, n, 500, 77), name))
            assert (secret_scan.ordinary_p(total, name, n) <= 0.01).mean() <= 0.07, (name, n)


def corpus():
    """Documents of ordinary words, some with a secret that no pattern has."""
    rng, rows, planted = random.Random(6), [], set()
    for i in range(400):
        words = [rng.choice(secret_scan.ORDINARY) for _ in range(30)]
        for _ in range(5):
            name = rng.choice(["letters", "base62", "base64url", "lower", "base36"])
            seed = rng.randint(1000, 10**6)
            codes = secret_scan.ordinary_words(name, rng.choice([16, 20, 27, 40]), 1, seed)[0]
            words.insert(rng.randrange(len(words)), "".join(secret_scan.ENCODINGS[name][c] for c in codes))
        if i % 4 == 0:
            a = secret_scan.ENCODINGS[rng.choice(["base62", "base64", "base64url", "BASE36"])]
            s = "".join(rng.choice(a) for _ in range(rng.choice([32, 40, 48, 64])))
            s = "k" + s.strip("+/_-") + "Q" if a[0] in "+-" else s
            words.insert(rng.randrange(len(words)), s)
            planted.add((i, s))
        rows.append((i, " ".join(words)))
    return rows, planted


def found_in(rows, texts):
    return {(r.doc_id, texts[r.doc_id][s.start : s.end]) for r in rows for s in r.spans if s.kind == "random"}


def test_held_out_secrets_are_found_and_false_ones_are_few(spark):
    rows, planted = corpus()
    got = found_in(secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect(), dict(rows))
    assert len(got & planted) >= 0.9 * len(planted)
    assert len(got - planted) <= 0.05 * len(got)


def test_cuts_are_those_of_the_rule(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")  # copies are the same hypotheses
    cut, words = secret_scan.cuts(secret_scan.scanned(df)), {}
    for _, t in rows:
        for a, b, s, step, h in secret_scan.candidates(t, secret_scan.base_spans(t)):
            words.setdefault(s, {})[h] = 10 ** (-step / secret_scan.STEPS)
    want = {}
    for s, ps in words.items():
        ordered = sorted(ps.values())
        passing = [p for i, p in enumerate(ordered, 1) if p <= secret_scan.FALSE * i / len(ordered)]
        if passing:
            want[s] = max(passing)
    assert {s: round(10 ** (-c / secret_scan.STEPS), 12) for s, c in cut.items()} == {s: round(p, 12) for s, p in want.items()}


def test_rows_nulls_and_overlaps(spark):
    long = "ordinary words " * 200_000 + "password = hunter2hunter2"
    texts = [None, "", "  ", "x" * 50_000, long, "AKIA" + "Q" * 16 + " token: abcdefabcdefabcdef", "token: abcdefabcdefabcdef", "1234567890123456", "==== ---- ////////////////////"]
    rows = [(i, t, "w", 0) for i, t in enumerate(texts)] + [(6, texts[6], "w", 0), (None, texts[6], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, base int")
    got = secret_scan.find_secrets(df).collect()
    assert sorted((str(r.doc_id), [tuple(s) for s in r.base]) for r in got) == sorted((str(i), plain_base(t or "")) for i, t, *_ in rows)
    assert all(len(r.base) <= len(r.spans) and all(a.start <= b.start for a, b in zip(r.spans, r.spans[1:])) for r in got)
    assert secret_scan.find_secrets(df.limit(0)).collect() == []
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect() if r.doc_id is not None}
    assert clean[0] is None and clean[1] == "" and clean[7] == "[HEX]" and clean[6] == "[ASSIGN]"


def test_query_on_a_given_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op13_secrets(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base, r = plain_base(d.text or ""), got[d.doc_id]
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert set(filter(None, r.spans.split(","))) >= set(written)
