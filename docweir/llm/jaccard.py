"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints propose pairs, the exact similarity decides.

One fingerprint over all shingles cannot propose pairs at 0.8: half of all bits
tell nothing, and about a sixth of them differ. So a text has many short ones. In
each the shingles stand in another random order and count by their place in it,
each a little over half of what the one before counts: two texts have nearly the
same fingerprint where they share the leading shingles. The anchors of
:mod:`.simhash` bring together those of one kind that differ in a single bit, and
texts whose fingerprints are equal or neighbours are compared.

Between the two stand odd sketches: a bit for each of some hash values, set if an
odd number of shingles has it. Bits in which two sketches differ are never more
than the shingles in which two texts differ, so they rule pairs out without
ruling out any that reaches the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import arrow_schema, durable, shuffle_width, sifted
from .components import components
from .simhash import keep_first, unite

#: Shingles have so many words; texts are linked from this similarity, a fraction.
SHINGLE_WORDS = 5
THRESHOLD = (4, 5)
#: A text has so many fingerprints, one with few shingles has more.
PRINTS, FEW_SHINGLES, PRINTS_OF_FEW = 24, 16, 60
#: So many shingles count for a fingerprint, each this fraction of the one before, in whole numbers: further ones would count a ten-thousandth.
LEADING, RATIO = 16, 0.55
#: A band with more texts than this is cut into slices, each pair of which is compared by itself.
SLICE = 1024
#: Words of sketches that are compared at once.
AT_ONCE = 1 << 21
_FACTORS, _OFFSETS = np.random.default_rng(5).integers(0, 1 << 64, (2, PRINTS_OF_FEW, 1), dtype=np.uint64)
_FACTORS |= np.uint64(1)
_WEIGHTS = np.round((1 << 24) * RATIO ** np.arange(LEADING)).astype(np.int64)
_KINDS = np.arange(PRINTS_OF_FEW, dtype=np.int64) << 32


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def key_of(text: str | None) -> int:
    """A 64-bit hash of the words, by which copies are told."""
    return xxhash.xxh64_intdigest(b" ".join(_words(text)), 7)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, in order; fewer than five words are one shingle, none have none."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    starts, ends = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n))


def fingerprints_of(h: np.ndarray) -> list[int]:
    """A weighted SimHash of 32 bits for each kind, with the kind's number above it; none without shingles.

    A kind's values of the shingles give their order, and their lower halves the bits.
    """
    if not len(h):
        return []
    k = PRINTS if len(h) > FEW_SHINGLES else PRINTS_OF_FEW
    first = np.zeros((k, 0), np.uint64)
    for i in range(0, len(h), 1024):
        first = np.concatenate([first, h[None, i : i + 1024] * _FACTORS[:k] + _OFFSETS[:k]], axis=1)
        if first.shape[1] > LEADING:
            first = np.partition(first, LEADING - 1, axis=1)[:, :LEADING]
    first.sort(axis=1)
    m = first.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(first.astype("<u4")).view(np.uint8).reshape(k, m, 4), axis=2, bitorder="little")
    votes = np.einsum("kmb,m->kb", bits.astype(np.int64), 2 * _WEIGHTS[:m]) > _WEIGHTS[:m].sum()
    return (np.packbits(votes, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64) | _KINDS[:k]).tolist()


def odd_sketch(h: np.ndarray) -> bytes:
    """A bit for each value that the hashes' lowest bits can take; there are two bits or more for each shingle."""
    bits = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def near_pairs(n: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of texts that may reach the threshold, given their numbers of shingles, and by how many bits they differ."""
    size = np.array([len(s) for s in sketches]) // 8
    out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    for words in np.unique(size).tolist():
        # sets whose sizes differ by more than a quarter cannot be alike, so at most one sketch is twice as long; it folds
        own, twice = np.flatnonzero(size == words), np.flatnonzero(size == 2 * words)
        rows = [np.frombuffer(sketches[i], np.uint64) for i in own] + [(w := np.frombuffer(sketches[i], np.uint64))[:words] ^ w[words:] for i in twice]
        at, table = np.r_[own, twice], np.stack(rows)
        step = max(1, AT_ONCE // (words * len(at)))
        for i in range(0, len(own), step):
            differ = np.bitwise_count(table[i : min(i + step, len(own)), None, :] ^ table[None, :, :]).sum(axis=2, dtype=np.int64)
            a, b = np.nonzero((THRESHOLD[0] + THRESHOLD[1]) * differ <= (THRESHOLD[1] - THRESHOLD[0]) * (n[own[i : i + step]][:, None] + n[at][None, :]))
            later = b > a + i
            out.append((own[a[later] + i], at[b[later]], differ[a[later], b[later]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def forest(fp: np.ndarray, a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Which of the pairs ``a``, ``b`` make a spanning forest of those that differ least, ties by ``fp``."""
    order = np.lexsort((np.maximum(fp[a], fp[b]), np.minimum(fp[a], fp[b]), differ))
    parent, chosen = np.arange(len(fp)), []
    while True:
        order = order[parent[a[order]] != parent[b[order]]]
        if not len(order):
            return np.concatenate(chosen) if chosen else order
        best = np.full(len(fp), len(order))
        rank = np.arange(len(order))
        np.minimum.at(best, parent[a[order]], rank)
        np.minimum.at(best, parent[b[order]], rank)
        picked = order[np.unique(best[best < len(order)])]
        chosen.append(picked)
        parent = unite(parent, a[picked], b[picked])


def _prints(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, fp long, n int, prints array<long>, odd binary"
    out = arrow_schema(T._parse_datatype_string(schema))

    def scan(batches):
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.slice(i, 1000)
                rows = [(key_of(t), len(h := shingles(t)), fingerprints_of(h), odd_sketch(h)) for t in part.column(1).to_pylist()]
                key, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(key, np.uint64).view(np.int64)), *[pa.array(c, f.type) for c, f in zip(rest, list(out)[2:])]], schema=out)

    return docs.mapInArrow(scan, schema)


def _met(distinct: DataFrame) -> DataFrame:
    """``(band, fp, tile)``: texts that share a band with others; a large band's in each pair of slices that they take part in.

    A band is a fingerprint with those neighbours that fewer texts have, ties by
    value, so that texts of a frequent one do not meet again around each neighbour.
    """
    spread = durable(distinct.select("fp", F.explode("prints").alias("print")))
    counted = durable(spread.groupBy("print").agg(F.count(F.lit(1)).alias("n")))
    near = durable(simhash.neighbours(counted.select(F.col("print").alias("fp"))))
    sized = [counted.select(F.col("print").alias(c), F.struct("n", "print").alias(f"n{c}")) for c in ("u", "v")]
    ranked = near.join(sized[0], "u").join(sized[1], "v")
    around = durable(ranked.select(F.least("nu", "nv")["print"].alias("print"), F.greatest("nu", "nv")["print"].alias("band")))
    own = counted.where("n > 1").select("print").unionByName(around.select(F.col("band").alias("print"))).distinct()
    shared = durable(around.unionByName(own.withColumn("band", F.col("print"))))
    crowded = spread.join(shared, "print").select("band", "fp").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("band")))
    slices, own = F.ceil(F.col("size") / SLICE).cast("int"), F.pmod(F.xxhash64("fp"), F.ceil(F.col("size") / SLICE)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), slices - 1), lambda j: F.least(own, j) * slices + F.greatest(own, j))
    return durable(crowded.select("band", "fp", F.explode(F.when(slices > 1, pairs).otherwise(F.array(F.lit(0)))).alias("tile")))


def _proposed(met: DataFrame, known: DataFrame, forests: bool) -> DataFrame:
    """``(u, v)``: pairs in a tile that the sketches let pass; spanning forests of them, or all whose ends have other labels.

    ``known(fp, n, odd, label)`` holds what is needed of each text.
    """
    dealt = met.join(known, "fp").withColumn("bucket", F.pmod(F.xxhash64("band", "tile"), F.lit(shuffle_width(met.sparkSession))).cast("int"))

    def compare(part: pa.Table) -> pa.Table:
        band, tile = (part.column(c).to_numpy() for c in ("band", "tile"))
        fp, n, label = (part.column(c).to_numpy() for c in ("fp", "n", "label"))
        odd, found = part.column("odd"), set()
        order = np.lexsort((fp, tile, band))
        for rows in np.split(order, np.flatnonzero((np.diff(band[order]) != 0) | (np.diff(tile[order]) != 0)) + 1):
            if (label[rows] == label[rows[0]]).all():
                continue
            a, b, differ = near_pairs(n[rows], [odd[i].as_py() for i in rows.tolist()])
            keep = forest(fp[rows], a, b, differ) if forests else np.flatnonzero(label[rows[a]] != label[rows[b]])
            u, v = fp[rows[a[keep]]], fp[rows[b[keep]]]
            found.update(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist()))
        u, v = zip(*found) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return durable(dealt.select("bucket", "band", "tile", "fp", "n", "odd", "label").groupBy("bucket").applyInArrow(compare, "u long, v long").distinct())


def _sets(pairs: DataFrame, distinct: DataFrame, rows: DataFrame) -> DataFrame:
    """``(fp, grams)``, the shingles of each text in ``pairs``, read once from the row with the smallest id."""
    wanted = durable(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct().join(distinct.select("fp", F.col("first_id").alias("doc_id")), "fp"))
    schema = "doc_id long, fp long, grams array<long>"
    out = arrow_schema(T._parse_datatype_string(schema))

    def scan(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            key = np.array(list(map(key_of, texts)), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key), pa.array([shingles(t).view(np.int64) for t in texts], out.field("grams").type)], schema=out)

    some, _ = sifted(rows.select("doc_id", "text"), "doc_id", wanted.select("doc_id"))
    # a row may be there more than once, and other texts may have its id
    return durable(some.mapInArrow(scan, schema).join(wanted, ["doc_id", "fp"], "left_semi").select("fp", "grams").dropDuplicates(["fp"]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(u, v)`` of the pairs whose exact similarity reaches the threshold."""
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("grams").alias("b")), "v")
    both = both.withColumn("shared", F.size(F.array_intersect("a", "b")))
    return durable(both.where(THRESHOLD[1] * F.col("shared") >= THRESHOLD[0] * (F.size("a") + F.size("b") - F.col("shared"))).select("u", "v"))


def links(distinct: DataFrame, rows: DataFrame) -> DataFrame:
    """``(u, v)`` links that join the same texts as all pairs that share a band of fingerprints and reach the threshold.

    The pairs of spanning forests are verified first; after that only those
    pairs that lie between texts not yet joined. So a large group of copies
    costs verifications by its size, and comparisons of sketches by pairs.
    """
    met = _met(distinct)
    known = distinct.select("fp", "n", "odd")
    trees = _proposed(met, known.withColumn("label", F.col("fp")), True)
    sets = _sets(trees, distinct, rows)
    found = _verified(trees, sets)
    joined = durable(components(found).select(F.col("node").alias("fp"), F.col("component").alias("_c")))
    # only texts of the forests differ from others by few enough bits
    touched = known.join(sets.select("fp"), "fp", "left_semi").join(joined, "fp", "left")
    rest = _proposed(met, touched.select("fp", "n", "odd", F.coalesce("_c", "fp").alias("label")), False)
    return found.unionByName(_verified(rest.join(trees, ["u", "v"], "left_anti"), sets))


def groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for each row of ``docs(doc_id, text, ...)``.

    ``fp`` tells copies, ``component_id`` is the smallest ``doc_id`` that links
    reach; words are those of :func:`.simhash.near_duplicates`, and so are the
    rules for nulls and repeats.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = durable(_prints(rows))
    distinct = durable(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.first("prints").alias("prints"), F.first("odd").alias("odd")))
    found = durable(components(links(distinct, rows)).select(F.col("node").alias("fp"), "component"))
    smallest = durable(found.join(distinct.select("fp", "first_id"), "fp").groupBy("component").agg(F.min("first_id").alias("smallest")))
    grouped = durable(found.join(smallest, "component").select("fp", "smallest"))
    by_print = durable(distinct.select("fp", "first_id").join(grouped, "fp", "left").select("fp", F.coalesce("smallest", "first_id").alias("component_id")))
    return prints.select("doc_id", "fp").join(by_print, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest ``doc_id`` stays."""
    return keep_first(docs, groups(docs), key_of)
