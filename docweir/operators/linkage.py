"""Which listed articles are held already: a chain of rules, each run on what the ones before left.

Every rule is an equi-join on a derived key. Sides are never broadcast by hand:
where one is small enough the optimiser sees its size. It does not see how many
rows an explode makes of one, so what comes out of an explode is merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.functions.similarity import CUTOFF, lengths_allow, ratios
from docweir.functions.text import MIN_PROBE, canonical_url, id_of_canonical, title_key
from docweir.sources.durable import durable

# The reasons that a match gives.
KNOWN, EXACT, PREFIX, FUZZY, SAME_AS, HELD_AS = "already backfilled", "exact title match: ", "prefix match: ", "fuzzy match (", " ~ ", " → "


def corpus_index(held: DataFrame) -> DataFrame:
    """``(key, corpus_ord, message_id)`` of ``held(message_id, subject, corpus_ord)``: the first message of each title key."""
    keyed = held.select(title_key("subject").alias("key"), "corpus_ord", "message_id").where("key <> ''")
    return keyed.groupBy("key").agg(F.min(F.struct("corpus_ord", "message_id")).alias("m")).select("key", "m.corpus_ord", "m.message_id")


def keyed_refs(refs: DataFrame) -> DataFrame:
    """``refs(ord, url, title, ...)`` with the canonical URL, the title key and the slug."""
    keyed = refs.withColumn("canonical", canonical_url("url")).withColumn("probe_title", title_key("title"))
    return keyed.withColumn("probe_slug", F.substring_index("canonical", "/", -1))


def known_urls(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Refs whose canonical URL is among ``known(canonical)``."""
    return refs.join(known.select("canonical").distinct(), "canonical", "left_semi").select(*refs.columns)


def exact_matches(refs: DataFrame, index: DataFrame) -> DataFrame:
    """``(ord, key, message_id)`` of refs whose title key is held."""
    return refs.where("probe_title <> ''").join(index, F.col("probe_title") == F.col("key")).select("ord", "key", "message_id")


def prefix_matches(refs: DataFrame, index: DataFrame) -> DataFrame:
    """``(ord, probe, key, message_id)``: a ref's probe and a held key of which one begins the other.

    The title's probe goes before the slug's, and of the keys the first in the
    corpus. Probes have ``MIN_PROBE`` characters at least, keys any number. A
    key that begins a probe equals one of the probe's prefixes; a probe that
    begins a key equals one of the key's, and of all keys with a prefix only the
    first can win. So both are equi-joins that never list pairs of a group.
    """
    probes = refs.select("ord", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("probe_title").alias("probe")), F.struct(F.lit(1).alias("rank"), F.col("probe_slug").alias("probe")))).alias("p"))
    probes = probes.select("ord", "p.rank", "p.probe").where(F.length("probe") >= MIN_PROBE)
    distinct = probes.select("probe").distinct()
    entry = F.struct("corpus_ord", "key", "message_id")
    begun = distinct.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("probe")), lambda n: F.left(F.col("probe"), n))))
    shorter = begun.hint("merge").join(index, "key").groupBy("probe").agg(F.min(entry).alias("m"))
    # only keys that agree with some probe on the least length can go on
    begin = distinct.select(F.left("probe", F.lit(MIN_PROBE)).alias("begin")).distinct()
    longer = index.where(F.length("key") > MIN_PROBE).withColumn("begin", F.left("key", F.lit(MIN_PROBE))).join(begin, "begin", "left_semi")
    prefixes = longer.withColumn("probe", F.explode(F.transform(F.sequence(F.lit(MIN_PROBE), F.length("key") - 1), lambda n: F.left(F.col("key"), n))))
    longer = prefixes.groupBy("probe").agg(F.min(entry).alias("m")).join(distinct, "probe")
    best = shorter.unionByName(longer.select("probe", "m")).groupBy("probe").agg(F.min("m").alias("m"))
    found = probes.join(best, "probe").groupBy("ord").agg(F.min(F.struct("rank", "probe", "m")).alias("b"))
    return found.select("ord", "b.probe", "b.m.key", "b.m.message_id")


#: Characters of keys, twelve to a long; how many occurrences of each are told apart; places that count as one when pieces are joined.
ALPHABET, LEVELS, NEAR = "abcdefghijklmnopqrstuvwxyz0123456789-", 5, 8


def _letters(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with the letter counts of ``text`` as bits of four longs, one for each occurrence up to ``LEVELS``, and the number of further ones."""
    marks = F.array(*[F.lit((1 << n) - 1).cast("long") for n in range(LEVELS + 1)])
    count = {x: F.length(text) - F.length(F.replace(F.col(text), F.lit(x))) for x in ALPHABET}
    longs = []
    for at in range(0, len(ALPHABET), 12):
        word = F.lit(0).cast("long")
        for k, x in enumerate(ALPHABET[at : at + 12]):
            word = word + F.shiftleft(F.get(marks, F.least(count[x], F.lit(LEVELS))), LEVELS * k)
        longs.append(word.alias(f"{to}{at // 12}"))
    out = df.select("*", *longs)
    kept = sum((F.bit_count(f"{to}{i}") for i in range(len(longs))), F.lit(0))
    return out.withColumn(f"{to}_rest", F.length(text) - kept)


def _unmatched(lengths: Column, cutoff: float) -> Column:
    """How many characters of two keys of these lengths together may stay without a partner."""
    return F.floor(lengths * (1 - cutoff) + 1e-9).cast("int")


def _number_of_pieces(n: Column, cutoff: float) -> Column:
    """One more than the characters that a key of ``n`` and any key near enough may leave unmatched."""
    return F.floor(n * (2 * (1 - cutoff) / cutoff) + 1e-9).cast("int") + 1


def key_pieces(keys: DataFrame, cutoff: float) -> DataFrame:
    """``keys(key, ...)`` cut into pieces of about equal length: a row ``(..., n, start, piece)`` for each."""
    n, m = F.length("key"), _number_of_pieces(F.length("key"), cutoff)
    cut = lambda i: F.floor(n * i / m).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(cut(i).alias("start"), F.substring("key", cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")))
    return keys.select("*", n.alias("n"), F.explode(pieces).alias("_p")).select(*keys.columns, "n", "_p.start", "_p.piece")


def probe_pieces(probes: DataFrame, cutoff: float) -> DataFrame:
    """``probes(probe, ...)`` with whatever in them may be a key's piece: ``(..., place, near, piece)``, for each stretch of places where it may stand in the key."""
    length = F.length("probe")
    near_enough = F.sequence(F.greatest(F.lit(1), F.ceil(length * cutoff / (2 - cutoff) - 1e-9).cast("int")), F.floor(length * (2 - cutoff) / cutoff + 1e-9).cast("int"))
    sizes = F.transform(near_enough, lambda n: n / _number_of_pieces(n, cutoff))
    size = F.explode(F.sequence(F.floor(F.array_min(sizes)).cast("int"), F.least(length, F.ceil(F.array_max(sizes)).cast("int"))))
    sized = probes.select("*", size.alias("_n")).where("_n > 0")
    placed = sized.select("*", F.explode(F.sequence(F.lit(0), F.length("probe") - F.col("_n"))).alias("place"))
    reach = _number_of_pieces(F.length("probe"), cutoff) - 1
    near = F.sequence(F.floor(F.greatest(F.lit(0), F.col("place") - reach) / NEAR).cast("int"), F.floor((F.col("place") + reach) / NEAR).cast("int"))
    return placed.select(*probes.columns, "place", F.substring("probe", F.col("place") + 1, F.col("_n")).alias("piece"), F.explode(near).alias("near"))


def similar_pairs(probes: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """Different pairs of ``probes(probe)`` and ``keys(key, message_id)`` that may reach the cutoff: none that does is lost.

    If two keys of ``a`` and ``b`` characters reach it, at most ``(1 - cutoff) *
    (a + b)`` characters of the two stay unmatched. Cut into one piece more than
    that, the key has a piece that no unmatched character touches: it stands in
    the probe as it is, moved by what is unmatched before it, and what is
    unmatched after it makes up the rest of the difference in length. So pairs
    meet in an equi-join on pieces and the stretch of places where they stand.
    Of those that agree on a place, the ones go on whose letters allow it.
    """
    p = probe_pieces(_letters(probes, "probe", "p"), cutoff)
    k = key_pieces(_letters(keys, "key", "k"), cutoff).withColumn("near", F.floor(F.col("start") / NEAR).cast("int"))
    common = sum((F.bit_count(F.col(f"p{i}").bitwiseAND(F.col(f"k{i}"))) for i in range(-(-len(ALPHABET) // 12))), F.least("p_rest", "k_rest"))
    both, moved, longer = F.length("probe") + F.col("n"), F.col("place") - F.col("start"), F.length("probe") - F.col("n")
    met = p.hint("merge").join(k, ["piece", "near"]).where((F.abs(moved) + F.abs(longer - moved) <= _unmatched(both, cutoff)) & (2.0 * common >= F.lit(cutoff) * both - 1e-9))
    return met.select("probe", "key", "message_id").dropDuplicates(["probe", "key"])


def fuzzy_matches(refs: DataFrame, index: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``(ord, key, message_id, ratio)``: the held key most similar to the ref's, at least ``cutoff``; ties go to the key that is last in order.

    Distinct keys only. A key equal to the probe is the most similar one; for
    the rest the library's ratio decides among :func:`similar_pairs`.
    """
    probes = refs.where("probe_title <> ''").select(F.col("probe_title").alias("probe")).distinct()
    same = probes.join(index, F.col("probe") == F.col("key")).select("probe", F.struct(F.lit(1.0).alias("decided"), "key", "message_id", F.lit(1.0).alias("reported")).alias("b"))
    rest = probes.join(index.select(F.col("key").alias("probe")), "probe", "left_anti")
    pairs = similar_pairs(rest, index.select("key", "message_id"), cutoff).where(lengths_allow(F.col("probe"), F.col("key"), cutoff))
    scored = pairs.select("probe", "key", "message_id", ratios("key", "probe").alias("r")).where("r.decided is not null")
    best = scored.groupBy("probe").agg(F.max(F.struct("r.decided", "key", "message_id", "r.reported")).alias("b"))
    found = same.unionByName(best)
    return refs.join(found, F.col("probe_title") == F.col("probe")).select("ord", "b.key", "b.message_id", F.col("b.reported").alias("ratio"))


def classify(refs: DataFrame, index: DataFrame, known: DataFrame, fuzzy: bool = True) -> DataFrame:
    """A row for each ref: ``(ord, url, title, article_id, status, match_reason)``; ``have`` with a reason, or ``discovered``.

    Known URLs first, then equal titles, then prefixes, then similar titles;
    each rule sees only the refs that the ones before left.
    """
    keyed, index = durable(keyed_refs(refs)), durable(index)
    left, reasons = keyed, []

    def settled(found: DataFrame) -> None:
        nonlocal left
        found = durable(found.select("ord", "reason"))
        reasons.append(found)
        left = left.join(found.select("ord"), "ord", "left_anti")

    settled(known_urls(left, known).select("ord", F.lit(KNOWN).alias("reason")))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    held = lambda *parts: F.concat(*parts, F.lit(HELD_AS), F.col("message_id").cast("string")).alias("reason")
    settled(exact_matches(left, index).select("ord", held(F.lit(EXACT), quoted(F.col("key")))))
    settled(prefix_matches(left, index).select("ord", held(F.lit(PREFIX), quoted(F.col("probe")), F.lit(SAME_AS), quoted(F.col("key")))))
    if fuzzy:
        settled(fuzzy_matches(left, index).select("ord", held(F.lit(FUZZY), F.format_number("ratio", 2), F.lit("): "), quoted(F.col("key")))))
    found = reasons[0]
    for r in reasons[1:]:
        found = found.unionByName(r)
    out = keyed.join(found, "ord", "left")
    return out.select("ord", "url", "title", id_of_canonical("canonical").alias("article_id"), F.when(F.col("reason").isNotNull(), "have").otherwise("discovered").alias("status"), F.coalesce("reason", F.lit("")).alias("match_reason"))


def summary(entries: DataFrame) -> DataFrame:
    """Counts of a scan: listed, held, missing."""
    return entries.agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("status") == "have").alias("held"), F.count_if(F.col("status") == "discovered").alias("missing"))


def display_keys() -> list[Column]:
    """Missing ones first, then by date with undated ones first, then as listed."""
    return [F.col("status") != "discovered", F.coalesce(F.col("published_at").cast("string"), F.lit("")), F.col("ord")]


def display_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy(*display_keys())
