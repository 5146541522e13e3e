"""Per-chunk lexicons: each distinct word is resolved once, and the answers go back by position.

A chunk is a run of documents of one input partition, closed at a bound on its
words. Its documents hold positions in the chunk's own lexicon; the lexicon
itself is dealt by a hash of the word into buckets. A bucket gathers the same
word from all chunks, so that each distinct word is resolved once, and sends
the answers back to the chunks. A word costs one entry for each chunk that has
it, however often it occurs there, so no frequent word makes a task heavy.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch, durable, pack_ints, pack_strings, shuffle_width, unpack_ints, unpack_strings

#: A chunk ends with the document that reaches one of these; a row holds documents until one reaches the third.
CHUNK_WORDS, CHUNK_DISTINCT, ROW_WORDS = 4_000_000, 400_000, 100_000
#: So many distinct words and their answers does a task hold while it resolves.
MEMO = 1_000_000

#: bucket: -1 for documents, -2 for a chunk's order, else the bucket of a part of the lexicon.
SCHEMA = "chunk long, bucket int, doc_ids array<long>, n_bytes array<long>, lengths binary, words binary, counts binary"


class Chunk:
    """Documents under way, and their lexicon."""

    def __init__(self, number: int, buckets: int, frequencies: bool, limits: tuple[int, int, int]):
        self.number, self.buckets, self.frequencies, self.limits = number, buckets, frequencies, limits
        self.lexicon: dict = defaultdict()
        self.lexicon.default_factory = self.lexicon.__len__
        self.docs: list[tuple] = []
        self.words = 0

    def add(self, doc_id: int | None, n_bytes: int, words: list[str]) -> bool:
        """Takes a document; whether the chunk is full now."""
        at = np.fromiter(map(self.lexicon.__getitem__, words), np.uint32, len(words))
        self.words += len(words)
        self.docs.append((doc_id, n_bytes, *(np.unique(at, return_counts=True) if self.frequencies else (at, None))))
        return self.words >= self.limits[0] or len(self.lexicon) >= self.limits[1]

    def rows(self) -> Iterator[tuple]:
        """Documents first; words are numbered anew, the most frequent first."""
        total = np.zeros(len(self.lexicon), np.int64)
        for _, _, at, n in self.docs:
            if n is None:
                total += np.bincount(at, minlength=len(total))
            else:
                total[at] += n
        rank = np.empty(len(total), np.uint32)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        run: list[tuple] = []
        for i, d in enumerate(self.docs):
            run.append(d)
            if i + 1 == len(self.docs) or sum(len(x[2]) for x in run) >= self.limits[2] or len(run) >= 200:
                counts = pack_ints(np.concatenate([x[3] for x in run])) if self.frequencies else None
                yield self.number, -1, [x[0] for x in run], [x[1] for x in run], pack_ints(np.array([len(x[2]) for x in run])), pack_ints(rank[np.concatenate([x[2] for x in run])]), counts
                run = []
        dealt = defaultdict(list)
        for w in self.lexicon:
            dealt[zlib.crc32(w.encode()) % self.buckets].append(w)
        order = [np.zeros(0, np.uint32)]
        for b, words in sorted(dealt.items()):
            words.sort()
            order.append(rank[np.fromiter(map(self.lexicon.__getitem__, words), np.int64, len(words))])
            yield self.number, b, None, None, None, pack_strings(words), None
        yield self.number, -2, None, None, None, pack_ints(np.concatenate(order)), None


def split_chunks(df: DataFrame, splitter: Callable[[], Callable[[str], list[str]]], frequencies: bool) -> tuple[DataFrame, DataFrame]:
    """``df(doc_id, text)`` as rows of documents and as parts of lexicons.

    ``splitter()`` is called once a task and gives the function that cuts a text
    into words. With ``frequencies`` a document holds its distinct positions and
    how often each occurs, else its positions in order. A null text is empty.
    """
    buckets, limits = shuffle_width(df.sparkSession), (CHUNK_WORDS, CHUNK_DISTINCT, ROW_WORDS)
    out = arrow_schema(T._parse_datatype_string(SCHEMA))

    def scan(batches):
        split, part, k = splitter(), TaskContext.get().partitionId() << 32, 0

        def made(rows):
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(r, out)], schema=out)

        chunk = Chunk(part, buckets, frequencies, limits)
        for b in batches:
            for doc_id, text, n_bytes in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if chunk.add(doc_id, n_bytes, split(text.as_py() or "")):
                    yield from made(chunk.rows())
                    k += 1
                    chunk = Chunk(part + k, buckets, frequencies, limits)
        if chunk.docs:
            yield from made(chunk.rows())

    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    made = durable(source.mapInArrow(scan, SCHEMA))
    return made.where("bucket < 0").drop("bucket"), made.where("bucket >= 0").select("chunk", "bucket", "words")


def resolve(lexicons: DataFrame, resolver: Callable[[], Callable[[list[str]], list]], pack: Callable[[list], bytes]) -> DataFrame:
    """``(chunk, bucket, answers)``, with each distinct word of all chunks resolved once.

    ``resolver()`` gives the function from distinct words to answers, ``pack``
    turns the answers for one chunk's part into bytes. The parts of a bucket
    pass through one by one; what stays is the distinct words of a task's
    buckets and their answers. Beyond ``MEMO`` words these are let go, and a
    word that comes again is resolved again.
    """
    limit, schema = MEMO, "chunk long, bucket int, answers binary"
    out = arrow_schema(T._parse_datatype_string(schema))

    def each(batches):
        solve, known = resolver(), {}
        for b in batches:
            for chunk, bucket, part in zip(b.column(0), b.column(1), b.column(2)):
                words = unpack_strings(part.as_py())
                new = [w for w in words if w not in known]
                if len(known) + len(new) > limit:
                    known, new = {}, words
                if new:
                    known.update(zip(new, solve(new)))
                yield batch(out, [chunk.as_py()], [bucket.as_py()], [pack([known[w] for w in words])])

    return lexicons.select("chunk", "bucket", "words").repartition("bucket").mapInArrow(each, schema)


def rejoin(documents: DataFrame, answers: DataFrame, finish: Callable[[np.ndarray, list[bytes]], Callable], out: str) -> DataFrame:
    """A row for each document, with the columns of ``out``.

    For each chunk ``finish(order, parts)`` gets its lexicon's order and answers:
    what ``parts`` hold, one after the other, answers the positions in ``order``.
    It gives the function from a document's id, bytes, positions and
    frequencies to its row.
    """
    schema = arrow_schema(T._parse_datatype_string(out))

    def each(docs: pa.Table, got: pa.Table) -> pa.Table:
        parts = [x["answers"] for x in sorted(got.select(["bucket", "answers"]).to_pylist(), key=lambda x: x["bucket"])]
        runs = [x for x in docs.to_pylist() if x["doc_ids"] is not None]
        order = next(x["words"] for x in docs.select(["doc_ids", "words"]).to_pylist() if x["doc_ids"] is None)
        row = finish(unpack_ints(order), parts)
        rows = []
        for x in runs:
            cuts = np.cumsum(unpack_ints(x["lengths"]))[:-1]
            words = np.split(unpack_ints(x["words"]), cuts)
            counts = np.split(unpack_ints(x["counts"]), cuts) if x["counts"] is not None else [None] * len(words)
            rows += map(row, x["doc_ids"], x["n_bytes"], words, counts)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(each, out)
