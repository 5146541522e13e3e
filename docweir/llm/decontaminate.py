"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are pairs of words that stand next to each other or one word apart, in an
item and in a document. Take an alignment that scores ``S``, and its matches in
order. Between two of them that lie ``a`` words apart in the item and ``b`` in
the document it loses at least ``max(a, b) - 1``. So ``S - 2`` is at most the sum
of the pairs' weights: 2 where both are neighbours, 1 where ``max(a, b)`` is 2,
and 0 or less for all others. Two bounds follow, neither of which loses an
alignment that reaches the threshold ``T``:

* the seeds of a stretch weigh ``T - 2`` or more together (the count filter);
* of an item's words any ``q`` with ``2 q < T - 2`` may begin no seed, and one of
  the others still does. The words left out are those whose pairs are the most
  frequent in the texts at hand; the rest are the rare seeds that propose items.

What passes both is aligned word by word, which scores edited copies as well as
exact ones. Nothing depends on the size of the corpus.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch, durable

#: Alignment: a match, another word, a word left out on either side. The bounds above hold for these values.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A document holds an item if the alignment reaches this share of the item's own score.
THRESHOLD = 0.5
#: Half of a shorter item is a common phrase: items of fewer words are held only where they stand whole.
SHORT = 6
#: Items are handled in blocks of about so many bytes, so that what each task holds is bounded.
BLOCK_BYTES = 8_000_000
#: Texts of about so many characters are searched at once.
AT_ONCE = 2_000_000
#: So many places where a pair of an item meets one of a text are held at once.
POSTINGS = 1_000_000

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i]``, ``starts[i] + 1``, ... for each ``i``, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def _cuts(sizes: np.ndarray, keys: np.ndarray, most: int):
    """Ranges of rows whose sizes sum up to ``most`` or less, cut between different keys; more only where one key has more."""
    if not len(sizes):
        return
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    upto = np.r_[0, np.cumsum(sizes)][np.r_[head, len(sizes)]]
    k = 0
    while k < len(head):
        n = max(k + 1, int(np.searchsorted(upto, upto[k] + most, side="right")) - 1)
        yield head[k], head[n] if n < len(head) else len(sizes)
        k = n


def alignment_score(item: np.ndarray, text: np.ndarray) -> int:
    """Smith-Waterman: the best local alignment of two sequences of word numbers; 0 in ``text`` matches nothing."""
    n = len(text)
    ramp = -GAP * np.arange(n + 1)
    row, best = np.zeros(n + 1, np.int64), 0
    for w in item.tolist():
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(text == w, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + ramp) - ramp  # words left out of the item's side
        best = max(best, int(row.max()))
    return best


class Items:
    """A block of test items: their words as numbers, one item after the other, and where each pair stands."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.vocab: dict[str, int] = {}
        self.ids, sequences = [], []
        for item_id, text in rows:
            words = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if words:
                self.ids.append(item_id)
                sequences.append(words)
        self.base = len(self.vocab) + 1
        self.length = np.array([len(s) for s in sequences], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.array([w for s in sequences for w in s], np.int64)
        #: the score that an item needs, and how many words an alignment that has it can span in a text
        self.need = np.where(self.length < SHORT, MATCH * self.length, np.ceil(THRESHOLD * MATCH * self.length - 1e-9).astype(np.int64))
        self.span = 3 * self.length - self.need
        self.owner = np.repeat(np.arange(len(sequences)), self.length)
        self.single = {int(self.flat[f]): [] for f, n in zip(self.first, self.length) if n == 1}
        for i, (f, n) in enumerate(zip(self.first.tolist(), self.length.tolist())):
            if n == 1:
                self.single[int(self.flat[f])].append(i)
        codes, places, apart = [], [], []
        for distance in (1, 2):
            at = np.flatnonzero(np.arange(len(self.flat)) + distance < np.repeat(self.first + self.length, self.length))
            codes.append(self.flat[at] * self.base + self.flat[at + distance])
            places.append(at)
            apart.append(np.full(len(at), distance))
        code, place, distance = (np.concatenate(x) for x in (codes, places, apart))
        #: distinct pairs in order; of each the places in ``flat`` where it begins, and how far its words are apart there
        self.pairs, which = np.unique(code, return_inverse=True)
        order = np.argsort(which, kind="stable")
        self.which, self.place, self.distance = which[order], place[order], distance[order]
        #: of each item its distinct pairs, and whether one of them stands on neighbouring words
        code, back = np.unique(self.owner[place] * max(1, len(self.pairs)) + which, return_inverse=True)
        self.own_pair, self.own_near = code % max(1, len(self.pairs)), np.bincount(back, weights=distance == 1, minlength=len(code)) > 0
        self.own = np.bincount(code // max(1, len(self.pairs)), minlength=len(sequences))
        self.own_at = np.cumsum(self.own) - self.own

    def numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))

    def words(self, i: int) -> np.ndarray:
        return self.flat[self.first[i] : self.first[i] + self.length[i]]

    def rare(self, frequency: np.ndarray) -> np.ndarray:
        """Which places may begin a seed, given how often each pair occurs: all but the costliest of each item."""
        cost = np.bincount(self.place, weights=frequency[self.which], minlength=len(self.flat))
        order = np.lexsort((-cost, self.owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - self.first[self.owner[order]]
        return rank >= np.maximum(0, (self.need - 3) // 2)[self.owner]

    def _pairs_in(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the items' pairs stand in a run of texts: document, pair, first word and distance, in this order."""
        p, pair, apart = [], [], []
        for distance in (1, 2):
            a, b = words[:-distance], words[distance:]
            at = np.flatnonzero((a > 0) & (b > 0) & (doc[:-distance] == doc[distance:]))
            code = a[at] * self.base + b[at]
            k = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            ok = self.pairs[k] == code
            p.append(at[ok])
            pair.append(k[ok])
            apart.append(np.full(int(ok.sum()), distance, np.int8))
        p, pair, apart = (np.concatenate(x) for x in (p, pair, apart))
        order = np.lexsort((p, pair, doc[p]))
        return doc[p[order]], pair[order], p[order], apart[order]

    def _proposed(self, doc: np.ndarray, pair: np.ndarray, frequency: np.ndarray):
        """Documents and items that share a rare seed, some documents at a time: from each document and pair in it, once, to the items where it is rare."""
        seed = self.rare(frequency)[self.place]
        which, owner = self.which[seed], self.owner[self.place[seed]]
        count = np.bincount(which, minlength=len(self.pairs))
        first = np.cumsum(count) - count
        for low, high in _cuts(count[pair], doc, POSTINGS):
            met = np.zeros(0, np.int64)
            for i, j in _cuts(count[pair[low:high]], np.arange(high - low), POSTINGS):
                k = pair[low + i : low + j]
                there = np.repeat(doc[low + i : low + j], count[k]) * len(self.ids) + owner[_ranges(first[k], count[k])]
                met = np.union1d(met, there)
            if len(met):
                yield met

    def _stretches(self, words: np.ndarray, doc: np.ndarray):
        """Document, item, first word and end of the stretches of ``words`` that pass both bounds; those of a document and item do not overlap.

        Postings are gathered for proposed documents and items alone, and at most
        ``POSTINGS`` at a time, or those of one document and item.
        """
        d, pair, p, apart = self._pairs_in(words, doc)
        if not len(p):
            return
        key = d * len(self.pairs) + pair
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size, key = np.diff(np.r_[head, len(p)]), key[head]
        for met in self._proposed(d[head], pair[head], np.bincount(pair, minlength=len(self.pairs))):
            item = met % len(self.ids)
            for low, high in _cuts(self.own[item], met, POSTINGS):
                n = self.own[item[low:high]]
                who, own = np.repeat(met[low:high], n), _ranges(self.own_at[item[low:high]], n)
                want = who // len(self.ids) * len(self.pairs) + self.own_pair[own]
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                ok = key[at] == want
                who, own, at = who[ok], own[ok], at[ok]
                for i, j in _cuts(size[at], who, POSTINGS):
                    yield from self._heavy(who[i:j], self.own_near[own[i:j]], head[at[i:j]], size[at[i:j]], p, apart, len(words))

    def _heavy(self, who: np.ndarray, near: np.ndarray, head: np.ndarray, size: np.ndarray, p: np.ndarray, apart: np.ndarray, end: int):
        """The count filter: stretches where an item's pairs weigh enough, joined where they overlap."""
        at = _ranges(head, size)
        who, near, p, apart = np.repeat(who, size), np.repeat(near, size), p[at], apart[at]
        weight = np.where((apart == 1) & near, 2, 1)
        # an alignment begins one pair at a word at most, so the heaviest counts
        order = np.lexsort((-weight, p, who))
        who, p, weight = who[order], p[order], weight[order]
        once = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (p[1:] != p[:-1])])
        who, p, weight = who[once], p[once], weight[once]
        item = who % len(self.ids)
        upto, key = np.r_[0, np.cumsum(weight)], who * (end + 1) + p
        last = np.searchsorted(key, who * (end + 1) + np.minimum(p + self.span[item], end))
        heavy = np.flatnonzero(upto[last] - upto[np.arange(len(p))] >= self.need[item] - MATCH)
        if len(heavy):
            who, p, span = who[heavy], p[heavy], self.span[item[heavy]]
            new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (p[1:] - span[1:] > p[:-1] + span[:-1])])
            low, high = p[new] - span[new], (p + span)[np.r_[new[1:], len(p)] - 1]
            yield from zip((who[new] // len(self.ids)).tolist(), (who[new] % len(self.ids)).tolist(), low.tolist(), high.tolist())

    def find(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """``(item_id, similarity)`` of each item at or over the threshold, for each text."""
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        if not self.ids:
            return out
        numbers = list(map(self.numbers, texts))
        lengths = np.array([len(x) for x in numbers])
        begin = np.cumsum(lengths) - lengths
        words, doc = np.concatenate(numbers), np.repeat(np.arange(len(texts)), lengths)
        if not len(words):
            return out
        best: dict[tuple[int, int], int] = {}
        for w, items in self.single.items():
            for d in np.unique(doc[words == w]).tolist():
                best.update({(d, i): MATCH for i in items})
        for d, i, a, b in self._stretches(words, doc) if len(self.pairs) else ():
            low, high = begin[d], begin[d] + lengths[d]
            score = alignment_score(self.words(i), words[max(a, low) : min(b, high)])
            if score >= self.need[i]:
                best[d, i] = max(score, best.get((d, i), 0))
        for (d, i), score in sorted(best.items()):
            out[d].append((self.ids[i], score / (MATCH * int(self.length[i]))))
        return out


def _groups(texts: pa.Array):
    """Runs of texts that are searched together: where each begins, and its texts."""
    run, size, at = [], 0, 0
    for k, t in enumerate(texts):
        run.append(t.as_py())
        size += len(run[-1] or "")
        if size >= AT_ONCE:
            yield at, run
            run, size, at = [], 0, k + 1
    if run:
        yield at, run


def _blocks(benchmark: DataFrame):
    """The test items, block by block; their number is that of the benchmark's bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    number = max(1, -(-int(size) // BLOCK_BYTES))
    for k in range(number):
        yield k + 1 == number, Items(sorted((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).collect()))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, similarity)``: a row for each row of ``docs`` and item of ``benchmark`` that it holds.

    Words are lower-cased runs of letters, digits and underscores. The
    similarity is the score of the best alignment as a share of the item's with
    itself, at least ``THRESHOLD``; items of fewer than ``SHORT`` words are held
    where they stand whole. Null texts, items without a word and items with a
    null id hold nothing; a null ``doc_id`` stays null; repeated rows give
    repeated results, as do repeated items; other columns are not used. The
    result is that of aligning every item with every document. Beyond one block
    of items each block's rows are cut off and its items released.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double"
    out = arrow_schema(T._parse_datatype_string(schema))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = None
    for last, block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            for b in batches:
                ids = b.column(0).to_pylist()
                for at, texts in _groups(b.column(1)):
                    got = [(ids[at + k], *x) for k, found in enumerate(shared.value.find(texts)) for x in found]
                    if got:
                        yield batch(out, *zip(*got))

        found = rows.mapInArrow(scan, schema)
        if not (last and result is None):
            found = durable(found)
            shared.destroy()
        result = found if result is None else result.unionByName(found)
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark`` (as :func:`leaks` says), as they are."""
    at, kept = docs.columns.index("text"), docs
    for last, block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            for b in batches:
                clean = [not found for _, texts in _groups(b.column(at)) for found in shared.value.find(texts)]
                yield b.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(scan, docs.schema)
        if not last:
            kept = durable(kept)
            shared.destroy()
    return kept
