"""SimHash near-duplicates through anchors of a covering code.

Each 32-bit half of a fingerprint is covered by a product code: the perfect
Golay code on 23 bits (covering radius 3), the perfect Hamming code on 7 bits
(radius 1) and the two bits left over as they are (radius 0). Two fingerprints
that differ in at most ``t`` bits differ in at most ``t // 2`` within one of the
halves. So each half is handled with the threshold ``t // 2``: a fingerprint
lives at the anchor nearest to it, within the covering radius, and is copied to
every anchor that lies within the covering radius plus the threshold, block by
block. Whoever lives at an anchor is compared with all that came there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch, durable, fresh, shuffle_width, sifted
from .components import components

#: Fingerprints differing in so many bits at most are linked.
MAX_BITS = 3
#: Shingles have so many words.
SHINGLE_WORDS = 3
#: Generator polynomials of the perfect codes, length and covering radius.
GOLAY = (0b101011100011, 23, 3)
HAMMING = (0b1011, 7, 1)
#: At an anchor with more residents than this the residents are split into slices, each compared by its own task.
SLICE = 512
#: Short fingerprints are dealt into so many buckets for each shuffle partition.
NEIGHBOUR_BUCKETS = 8


class Block:
    """A cyclic perfect code on some bits of a fingerprint, as tables by syndrome."""

    def __init__(self, generator: int, length: int, radius: int, excess: int):
        degree = generator.bit_length() - 1
        self.shift, self.mask, self.generator, self.length = degree, (1 << length) - 1, generator, length
        power = [1]
        for _ in range(length - 1):
            x = power[-1] << 1
            power.append(x ^ generator if x >> degree else x)
        self.columns = np.array(power, np.uint32)
        #: by excess over the covering radius, then by syndrome: patterns that lead to codewords.
        self.leads = []
        for e in range(excess + 1):
            table: list[list[int]] = [[] for _ in range(1 << degree)]
            for weight in range(radius + 1) if e == 0 else [radius + e]:
                for bits in combinations(range(length), weight):
                    s, pattern = 0, 0
                    for b in bits:
                        s ^= power[b]
                        pattern |= 1 << b
                    table[s].append(pattern)
            width = max(map(len, table))
            self.leads.append((np.array([x + [0] * (width - len(x)) for x in table], np.uint32), np.array([len(x) for x in table])))
        # bytewise tables for the syndrome
        self.by_byte = [np.array([self._fold(v, 8 * k) for v in range(256)], np.uint32) for k in range((length + 7) // 8)]

    def _fold(self, value: int, at: int) -> int:
        s = 0
        for b in range(8):
            if value >> b & 1 and at + b < self.length:
                s ^= int(self.columns[at + b])
        return s

    def anchors(self, x: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and codewords that exceed the covering radius by exactly ``excess``."""
        s = np.zeros(len(x), np.uint32)
        for k, t in enumerate(self.by_byte):
            s ^= t[(x >> np.uint32(8 * k)) & np.uint32(255)]
        leads, count = self.leads[excess]
        rows = np.repeat(np.arange(len(x)), count[s])
        within = np.arange(len(rows)) - np.repeat(np.cumsum(count[s]) - count[s], count[s])
        return rows, x[rows] ^ leads[s[rows], within]


class Plain:
    """Bits that stand for themselves: every word is a codeword."""

    def __init__(self, length: int):
        self.length, self.mask = length, (1 << length) - 1

    def anchors(self, x: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        flips = np.array([sum(1 << b for b in bits) for bits in combinations(range(self.length), excess)], np.uint32)
        return np.repeat(np.arange(len(x)), len(flips)), (x[:, None] ^ flips[None, :]).ravel().astype(np.uint32)


class CoveringCode:
    """Anchors for one half of a fingerprint under a threshold."""

    def __init__(self, threshold: int):
        self.threshold = threshold
        self.blocks = [Block(*GOLAY, threshold), Block(*HAMMING, min(threshold, 6)), Plain(2)]

    def anchors(self, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, anchors, and whether the row lives there; ``half`` holds 32-bit values."""
        parts, at = [], 0
        for b in self.blocks:
            parts.append((b, at, ((half >> np.uint32(at)) & np.uint32(b.mask)).astype(np.uint32)))
            at += b.length
        out = []
        for excess in product(range(self.threshold + 1), repeat=len(parts)):
            if sum(excess) > self.threshold or excess[1] > 6 or excess[2] > 2:
                continue
            rows, word = np.arange(len(half)), np.zeros(len(half), np.uint32)
            for (b, at, x), e in zip(parts, excess):
                r, w = b.anchors(x[rows], e)
                rows, word = rows[r], word[r] | (w << np.uint32(at))
            out.append((rows, word, np.full(len(rows), not any(excess))))
        return tuple(np.concatenate(x) for x in zip(*out))


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text; zero if it is null or has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    starts, ends = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``: a row for each row of ``docs(doc_id, text, ...)``, the fingerprint as a signed long."""
    schema = "doc_id long, fp long"
    out = arrow_schema(T._parse_datatype_string(schema))

    def scan(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield batch(out, b.column(0), fp)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hooks the roots of linked pairs until each pair has one root."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        ra, rb = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _near(anchor: np.ndarray, fp: np.ndarray, lives: np.ndarray, max_bits: int, at_once: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compares at each anchor whoever lives there with all that came; places of those within ``max_bits``."""
    order = np.argsort(anchor, kind="stable")
    anchor, lives = anchor[order], lives[order]
    cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    group = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]]) - 1
    size = np.diff(np.r_[cuts, len(anchor)])
    homes = np.flatnonzero(lives)
    homes = homes[size[group[homes]] > 1]
    width = size[group[homes]]
    upto = np.cumsum(width)
    i = 0
    while i < len(homes):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + at_once, side="right")))
        w = width[i:j]
        for k in range(0, int(w.sum()) if j == i + 1 else 1, at_once):
            if j == i + 1:
                a = np.full(min(at_once, int(w[0]) - k), homes[i])
                b = cuts[group[homes[i]]] + k + np.arange(len(a))
            else:
                a = np.repeat(homes[i:j], w)
                b = np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(cuts[group[homes[i:j]]], w)
            a, b = order[a], order[b]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
            yield a[near], b[near]
        i = j


def _links_of(anchor: np.ndarray, fp: np.ndarray, lives: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to join what is alike, at most one for each fingerprint."""
    nodes, local = np.unique(fp, return_inverse=True)
    parent = np.arange(len(nodes))
    for a, b in _near(anchor, fp, lives, max_bits):
        parent = unite(parent, local[a], local[b])
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _pairs_of(anchor: np.ndarray, fp: np.ndarray, lives: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All that is alike, the one that lives at the anchor first."""
    found = [(fp[a[a != b]], fp[b[a != b]]) for a, b in _near(anchor, fp, lives, max_bits)]
    return tuple(np.concatenate([np.zeros(0, np.uint64), *x]) for x in zip(*found)) if found else (fp[:0], fp[:0])


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(u, v)`` links that join the same fingerprints as all pairs within ``max_bits`` of ``distinct(fp long)``."""

    def places(fp: np.ndarray):
        for half in (0, 1):
            rows, word, lives = code.anchors((fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32))
            yield rows, np.full(len(rows), half), word, lives

    code = CoveringCode(max_bits // 2)
    return _compared(distinct, places, lambda *x: _links_of(*x, max_bits), shuffle_width(distinct.sparkSession))


def neighbours(distinct: DataFrame) -> DataFrame:
    """``(u, v)``: all pairs of ``distinct(fp long)`` that differ in a single bit of the lower 32, and not in the upper ones.

    Above its 32 bits a fingerprint has the number of its kind, below 256. One of
    a pair has an even number of bits, ``u``, the other an odd one: the even ones
    live at their anchors and only the odd ones travel. A fingerprint has 32
    neighbours at most, so pairs grow as fingerprints do.
    """

    def places(fp: np.ndarray):
        bits = fp.view(np.uint64).astype(np.uint32)
        rows, word, lives = code.anchors(bits)
        even = (np.bitwise_count(bits) & 1 == 0)[rows]
        met = lives | ~even
        yield rows[met], (fp >> 32)[rows[met]], word[met], (lives & even)[met]

    code = CoveringCode(1)
    # texts have many of these fingerprints, so they are dealt into more buckets
    return _compared(distinct, places, lambda *x: _pairs_of(*x, 1), NEIGHBOUR_BUCKETS * shuffle_width(distinct.sparkSession))


def _compared(distinct: DataFrame, places: Callable, found: Callable, buckets: int) -> DataFrame:
    """What ``found(anchor, fp, lives)`` tells of each bucket of anchors, as ``(u, v)``.

    ``places(fp)`` yields row numbers, halves or kinds, anchors, and whether the
    row lives there. An anchor with many residents is split into slices, each with
    a part of the residents and all that came to the anchor.
    """
    anchored = "half int, anchor long, fp long, lives boolean"
    out = arrow_schema(T._parse_datatype_string(anchored))

    def spread(residents_only: bool):
        def run(batches):
            for b in batches:
                fp = b.column(0).to_numpy()
                for rows, half, word, lives in places(fp):
                    if residents_only:
                        rows, half, word, lives = rows[lives], half[lives], word[lives], lives[lives]
                    for i in range(0, len(rows), 1 << 16):
                        k = slice(i, i + (1 << 16))
                        yield batch(out, half[k], word[k].astype(np.int64), fp[rows[k]], lives[k])

        return run

    distinct = distinct.select("fp")
    heavy = durable(
        distinct.mapInArrow(spread(True), anchored).groupBy("half", "anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE).select("half", "anchor", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    )
    dealt = distinct.mapInArrow(spread(False), anchored)
    dealt = dealt.join(heavy, ["half", "anchor"], "left") if heavy.take(1) else dealt.withColumn("slices", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    dealt = dealt.withColumn("slice", F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("slices") - 1))))
    here = F.col("lives") & (F.col("slices").isNull() | (F.col("slice") == own))
    # one long for the place: 32 bits of the anchor, 8 of the half or kind, 1 for residents, the rest for the slice
    place = F.col("anchor").bitwiseOR(F.shiftleft(F.col("half").cast("long"), 32)).bitwiseOR(F.shiftleft(here.cast("long"), 40)).bitwiseOR(F.shiftleft(F.col("slice").cast("long"), 41))
    dealt = dealt.select(F.pmod(F.xxhash64("half", "anchor", "slice"), F.lit(buckets)).cast("int").alias("bucket"), place.alias("place"), "fp")

    def compare(part: pa.Table) -> pa.Table:
        place, resident = part.column("place").to_numpy().view(np.uint64), np.uint64(1 << 40)
        u, v = found(place & ~resident, part.column("fp").to_numpy().view(np.uint64), place & resident != 0)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return dealt.groupBy("bucket").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for each row of ``docs(doc_id, text, ...)``.

    Words are runs of anything but space and the ASCII controls 9 to 13, A-Z
    lower-cased; shingles have three words, repeats included. Copies share a
    fingerprint and are compared once. ``component_id`` is the smallest
    ``doc_id`` of the rows that links of at most ``max_bits`` bits reach. A null
    text has fingerprint zero as one without words has, and is linked like any
    other. A row with a null ``doc_id`` keeps its fingerprint, links nothing and
    has a null ``component_id``. Repeated rows stay; other columns are not used.
    """
    prints = durable(fingerprints(docs))
    distinct = durable(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = durable(components(links(distinct, max_bits)).select(F.col("node").alias("fp"), "component"))
    smallest = durable(found.join(distinct, "fp").groupBy("component").agg(F.min("first_id").alias("smallest")))
    grouped = durable(found.join(smallest, "component").select("fp", "smallest"))
    by_print = durable(distinct.join(grouped, "fp", "left").select("fp", F.coalesce("smallest", "first_id").alias("component_id")))
    return prints.join(by_print, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def first_of_each_group(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest ``doc_id`` stays.

    Of rows that repeat that ``doc_id`` within the group one stays, that with the
    smallest fingerprint. Rows with a null ``doc_id`` link nothing and all stay.
    """
    return keep_first(docs, near_duplicates(docs, max_bits), fingerprint)


def keep_first(docs: DataFrame, groups: DataFrame, print_of: Callable[[str | None], int]) -> DataFrame:
    """The rows of ``docs`` that ``groups(doc_id, fp, component_id)`` lets stay; ``fp`` is what ``print_of`` makes of a text.

    Rows whose id is certainly in order pass as they are; only the others are
    looked up, so that few texts are shuffled.
    """
    columns, own = docs.columns, fresh(docs, "fp")
    groups = durable(groups)
    others = durable(groups.where("doc_id <> component_id").select("doc_id", F.col("fp").alias(own)).distinct())
    again = durable(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    doubtful, sure = sifted(docs, "doc_id", others.select("doc_id").unionByName(again))
    kept = _with_print(doubtful, print_of, own).join(others, ["doc_id", own], "left_anti")
    if again.take(1):
        first = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(own, *columns)).alias("row")).select("row.*")
        kept = kept.join(again, "doc_id", "left_anti").select(*columns).unionByName(first.select(*columns))
    return sure.unionByName(kept.select(*columns))


def _with_print(docs: DataFrame, print_of: Callable[[str | None], int], name: str) -> DataFrame:
    """``docs`` with what ``print_of`` makes of its text as ``name``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    out, at = arrow_schema(schema), docs.columns.index("text")

    def scan(batches):
        for b in batches:
            fp = np.array([print_of(t.as_py()) for t in b.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], schema=out)

    return docs.mapInArrow(scan, schema)


def hex_fingerprint(fp: str = "fp"):
    """Sixteen lower-case hexadecimal digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
