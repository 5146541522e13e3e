import difflib
import random

from docweir.functions.similarity import CUTOFF
from docweir.operators import linkage

KEYS = "key string, corpus_ord long, message_id string"


def model(title, slug, index):
    """The rules one after the other; index: keys in corpus order."""
    if title and title in index:
        return "exact", title
    for probe in (title, slug):
        if len(probe) >= 20:
            for key in index:
                if key.startswith(probe) or probe.startswith(key):
                    return "prefix", key
    if title:
        close = difflib.get_close_matches(title, index, n=1, cutoff=CUTOFF)
        if close:
            return "fuzzy", f"{difflib.SequenceMatcher(None, title, close[0]).ratio():.2f} {close[0]}"
    return None


def words(rng, n):
    return "-".join(rng.choice(["alpha", "beta", "gamma", "delta", "list", "the", "of", "road", "map"]) for _ in range(n))


def test_chain_against_a_sequential_model(spark):
    rng = random.Random(11)
    index = list(dict.fromkeys([words(rng, rng.randint(1, 9)) for _ in range(80)] + ["the", words(rng, 45)[:200]]))
    refs = []
    for i in range(160):
        base = rng.choice(index)
        kind = rng.randint(0, 6)
        title = [base, base[: rng.randint(1, len(base))].strip("-"), base + "-" + words(rng, 2), base.replace("a", "o", 2), words(rng, 5), "", base[:-1] + "x"][kind]
        slug = rng.choice(["", base[:25].strip("-"), words(rng, 3)])
        refs.append((i, f"https://x.test/p/{slug}", title))
    df = spark.createDataFrame(refs, "ord int, url string, title string")
    idx = spark.createDataFrame([(k, i, f"m{i}") for i, k in enumerate(index)], KEYS)
    none = spark.createDataFrame([], "canonical string")
    got = {r.ord: r.match_reason for r in linkage.classify(df, idx, none).collect()}
    assert len(got) == len(refs)
    for i, url, title in refs:
        slug = url.rsplit("/", 1)[1] or "p"
        want = model(title, slug, index)
        reason = got[i]
        if want is None:
            assert reason == ""
        elif want[0] == "fuzzy":
            ratio, key = want[1].split(" ")
            assert reason.startswith(f"fuzzy match ({ratio}): '{key}'"), (title, reason, want)
        else:
            assert reason.startswith(want[0]) and f"'{want[1]}' → m{index.index(want[1])}" in reason, (title, slug, reason, want)


def test_long_keys_follow_the_library(spark):
    """Keys at the length from which the library sets frequent characters aside."""
    rng = random.Random(3)
    keys = ["".join(rng.choice("abcdefgh-") for _ in range(200)) for _ in range(3)]
    probes = [k[:90] + "x" + k[91:] for k in keys] + [k[10:] + k[:10] for k in keys]
    idx = spark.createDataFrame([(k, i, f"m{i}") for i, k in enumerate(keys)], KEYS)
    refs = linkage.keyed_refs(spark.createDataFrame([(i, "https://x.test/p", p) for i, p in enumerate(probes)], "ord int, url string, title string")).drop("probe_title")
    refs = refs.withColumnRenamed("title", "probe_title")
    got = {r.ord: (r.key, round(r.ratio, 9)) for r in linkage.fuzzy_matches(refs, idx).collect()}
    want = {}
    for i, p in enumerate(probes):
        close = difflib.get_close_matches(p, keys, n=1, cutoff=CUTOFF)
        if close:
            want[i] = (close[0], round(difflib.SequenceMatcher(None, p, close[0]).ratio(), 9))
    assert got == want


def test_known_urls_go_first_and_ids_are_stable(spark):
    refs = spark.createDataFrame([(0, "https://X.test/p/a/?utm_source=x", "Held"), (1, "https://x.test/p/b", "Held"), (2, "https://x.test/p/c", ""), (3, "https://x.test/p/a", "")], "ord int, url string, title string")
    idx = linkage.corpus_index(spark.createDataFrame([("m1", "Re: held", 5), ("m0", "HELD", 9), ("m2", "", 1)], "message_id string, subject string, corpus_ord int"))
    known = spark.createDataFrame([("https://x.test/p/a",)], "canonical string")
    got = {r.ord: r for r in linkage.classify(refs, idx, known).collect()}
    assert got[0].match_reason == got[3].match_reason == "already backfilled" and got[0].article_id == got[3].article_id
    assert got[1].match_reason == "exact title match: 'held' → m1" and got[2].status == "discovered"
    assert linkage.summary(linkage.classify(refs, idx, known)).first().asDict() == {"listed": 4, "held": 3, "missing": 1}
    assert linkage.classify(refs.limit(0), idx, known).count() == 0
    assert linkage.summary(linkage.classify(refs, idx.limit(0), known.limit(0))).first().missing == 4


def edits(rng, key, n):
    """A key with so many characters changed, left out or put in, wherever they fall."""
    out = list(key)
    for _ in range(n):
        k, how = rng.randrange(len(out) + 1), rng.randint(0, 2)
        out[k : k + (how != 2)] = [] if how == 0 else [rng.choice("abcdefghij-")]
    return "".join(out).strip("-")


def test_no_similar_pair_is_lost(spark):
    """All pairs that reach the cutoff are among those that share a piece, for cutoffs of any kind; most others are not."""
    rng = random.Random(21)
    keys = sorted({edits(rng, words(rng, rng.randint(1, 8)), 2) for _ in range(60)} | {"".join(rng.choice("abcdefghij-") for _ in range(rng.randint(1, 70))).strip("-") or "a" for _ in range(60)})
    probes = sorted({edits(rng, rng.choice(keys), rng.randint(0, 8)) for _ in range(200)} - {""})
    k = spark.createDataFrame([(x, "m") for x in keys], "key string, message_id string")
    p = spark.createDataFrame([(x,) for x in probes], "probe string")
    for cutoff in (0.9, 0.8, 0.97):
        got = {(r.probe, r.key) for r in linkage.similar_pairs(p, k, cutoff).collect()}
        want = {(a, b) for a in probes for b in keys if difflib.SequenceMatcher(None, b, a).ratio() >= cutoff}
        assert want <= got and len(want) > 20
        assert len(got) < 0.1 * len(probes) * len(keys)


def test_pieces_are_few_and_cover_the_key(spark):
    keys = [("x" * n,) for n in range(1, 201)] + [("".join(chr(97 + i % 26) for i in range(60)),)]
    got = linkage.key_pieces(spark.createDataFrame(keys, "key string"), 0.9).collect()
    for (key,) in keys:
        own = sorted((r.start, r.piece) for r in got if r.key == key)
        assert "".join(piece for _, piece in own) == key and all(key[s : s + len(piece)] == piece and piece for s, piece in own)
        assert len(own) > 0.1 * (len(key) + len(key) * 1.1 / 0.9) - 1e-6


def broadcast_explodes(df):
    """Explodes of sequences whose rows are broadcast as they come, by the physical plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [next((i for i, c in enumerate(x) if c.isalpha() or c in "*("), 0) for x in lines]
    found = []
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            for y, d in zip(lines[i + 1 :], depth[i + 1 :]):
                if d <= depth[i] or "Exchange hashpartitioning" in y:
                    break
                found += [y] if "Generate explode(transform(sequence" in y else []
    return found


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    """The optimiser takes an explode to be as small as its input; the driver would hold all rows of it."""
    spark.createDataFrame([(0, "alpha-beta-gamma-delta-epsilon", "a")], "ord int, probe_title string, probe_slug string").write.parquet(f"{tmp_path}/refs")
    spark.createDataFrame([("alpha-beta-gamma-delta", 0, "m0"), ("alpha-beta-gamma-delta-epsilox", 1, "m1")], KEYS).write.parquet(f"{tmp_path}/index")
    refs, index = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("refs", "index"))
    found = linkage.prefix_matches(refs, index)
    assert not broadcast_explodes(found) and [r.key for r in found.collect()] == ["alpha-beta-gamma-delta"]
    similar = linkage.fuzzy_matches(refs, index)
    assert not broadcast_explodes(similar) and [r.key for r in similar.collect()] == ["alpha-beta-gamma-delta-epsilox"]
