"""Hard negatives for contrastive training, by product quantisation with stored residual norms.

Vectors are cut into short parts; each part keeps the number of the nearest entry
of its codebook and the norm of what that entry leaves over. An anchor's product
with a row is then the sum of entries of lookup tables, give or take, for each
part, the anchor's norm times the row's residual norm (Cauchy-Schwarz). Rows
whose upper bound lies below a window or below scores that enough certain rows
reach, and rows whose lower bound lies above it, are ruled out without an error;
what is left is scored exactly in whole numbers, and completes the window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch, durable
from .topk import _matrix, _product

#: Components of a part, entries of a codebook, rows (those with the smallest hashes) and rounds that codebooks are fitted on.
PART_DIMS, ENTRIES, SAMPLE, ROUNDS = 2, 256, 8192, 8
#: Anchors that one task holds at most, and that are looked up together; into so many slices rows are dealt, of about this size or more.
HELD, TOGETHER, SLICES, SLICE_ROWS = 65_536, 32, 64, 4096
#: So many times the rows of a window are scored first where more could enter it.
FIRST = 4
#: What rounding may add to a bound, relative to the largest value that it can have.
SLACK = 1e-9

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, label, v array<long>)``: floor(scale * x) of each component, as double.

    Rows with a null ``vec_id``, ``label`` or vector, or a null or non-finite
    component, take no part. Of rows that repeat a ``vec_id`` the one with the
    largest vector, then label, stays.
    """
    x = F.col("embedding").cast("array<double>")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(ok)
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(v, F.col("label").cast("long").alias("label")).alias("s")).groupBy("vec_id").agg(F.max("s").alias("s"))
    return kept.select("vec_id", "s.label", "s.v")


class Codebooks:
    """For each part of a vector the entries that stand for it."""

    def __init__(self, sample: np.ndarray, seed: int):
        """By a few rounds of Lloyd on distinct parts; any codebooks give right bounds, good ones give close ones."""
        self.dims = sample.shape[1]
        self.parts = max(1, -(-self.dims // PART_DIMS))
        rng, self.entries = np.random.default_rng(seed), []
        for x in self.cut(sample):
            x = np.unique(x, axis=0)
            c = x[rng.permutation(len(x))[:ENTRIES]]
            for _ in range(ROUNDS):
                near = self.nearest(x, c)
                n = np.bincount(near, minlength=len(c))
                total = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(PART_DIMS)], axis=1)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            self.entries.append(c)

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        """The parts of vectors, the last filled up with zeros."""
        full = np.zeros((len(x), self.parts * PART_DIMS))
        full[:, : self.dims] = x
        return [full[:, p * PART_DIMS : (p + 1) * PART_DIMS] for p in range(self.parts)]

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (np.square(c).sum(axis=1)[None] - 2 * (x @ c.T)).argmin(axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers and residual norms, a column for each part; norms are rounded up."""
        codes, norms = np.empty((len(x), self.parts), np.uint8), np.empty((len(x), self.parts), np.float32)
        for p, (part, c) in enumerate(zip(self.cut(x), self.entries)):
            codes[:, p] = near = self.nearest(part, c)
            norms[:, p] = np.nextafter((np.linalg.norm(part - c[near], axis=1) * (1 + SLACK)).astype(np.float32), np.float32(np.inf))
        return codes, norms

    def bounds(self, anchors: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores from the lookup tables, and by how much the true products may differ; a row for each anchor."""
        score, error = np.zeros((len(anchors), len(codes))), np.zeros((len(anchors), len(codes)))
        for p, (a, c) in enumerate(zip(self.cut(anchors), self.entries)):
            score += (a @ c.T)[:, codes[:, p]]
            size = np.linalg.norm(a, axis=1)[:, None]
            error += size * norms[:, p][None]
            error += SLACK * size * (np.linalg.norm(c, axis=1).max(initial=0) + 1)
        return score, error


@dataclass
class Held:
    """Anchors of a task with their windows, and the best rows met so far in each."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    low: np.ndarray  # a window a column; those that an anchor lacks are empty
    high: np.ndarray
    scores: np.ndarray
    found: np.ndarray

    @classmethod
    def of(cls, parts: list[pa.RecordBatch], dims: int, k: int) -> Held:
        table = pa.Table.from_batches(parts).combine_chunks()
        column = lambda c: table.column(c).combine_chunks()
        lows = column("low").to_pylist()
        most = max(1, max(map(len, lows)))
        fill = lambda lists, gap: np.array([x + [gap] * (most - len(x)) for x in lists], np.int64).reshape(len(lists), most)
        low, high = fill(lows, MOST), fill(column("high").to_pylist(), LEAST)
        n = len(low)
        return cls(column("vec_id").to_numpy(), column("label").to_numpy(), _matrix(column("v"), dims), low, high, np.full((n, most, k), LEAST), np.full((n, most, k), MOST))

    def floor(self, i: int, w: int) -> float:
        """What a row must reach to enter a window, less what a float of that size may lose."""
        least = float(max(self.low[i, w], self.scores[i, w, -1]))
        return least - SLACK * abs(least)

    def take(self, i: int, windows: list[int], ids: np.ndarray, v: np.ndarray, rows: np.ndarray, exact: bool) -> int:
        """Scores rows exactly and puts them into the windows of an anchor."""
        if len(rows):
            s, c = _product(self.rows[i : i + 1], v[rows], exact)[0], ids[rows]
            for w in windows:
                inside = (s >= max(self.low[i, w], self.scores[i, w, -1])) & (s <= self.high[i, w])
                if inside.any():
                    all_s, all_c = np.r_[self.scores[i, w], s[inside]], np.r_[self.found[i, w], c[inside]]
                    order = np.lexsort((all_c, -1 - all_s))[: self.scores.shape[2]]
                    self.scores[i, w], self.found[i, w] = all_s[order], all_c[order]
        return len(rows)

    def search(self, books: Codebooks, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, codes: np.ndarray, norms: np.ndarray, same: bool) -> int:
        """Takes rows into the windows; returns how many products had to be made."""
        k, made = self.scores.shape[2], 0
        exact = float(np.abs(self.rows).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, v.shape[1]) < 2**52
        for at in range(0, len(self.ids), TOGETHER):
            score, error = books.bounds(self.rows[at : at + TOGETHER].astype(np.float64), codes, norms)
            upper, lower = score + error, score - error
            for i in range(at, min(at + TOGETHER, len(self.ids))):
                fit = (ids != self.ids[i]) & ((labels == self.labels[i]) == same)
                windows = [w for w in range(self.low.shape[1]) if self.low[i, w] <= self.high[i, w]]
                can = lambda w: fit & (upper[i - at] >= self.floor(i, w)) & (lower[i - at] <= self.high[i, w])  # noqa: B023, E731
                # first the rows that the tables rank highest in each window: they raise what the others have to reach
                early = [np.zeros(0, np.int64)]
                for w in windows:
                    rows = np.flatnonzero(can(w) & (score[i - at] <= self.high[i, w]))
                    if len(rows) > FIRST * k:
                        early.append(rows[np.argpartition(score[i - at, rows], -FIRST * k)[-FIRST * k :]])
                rows = np.unique(np.concatenate(early))
                made += self.take(i, windows, ids, v, rows, exact)
                fit[rows] = False
                wanted = np.zeros(len(ids), bool)
                for w in windows:
                    wanted |= can(w)
                made += self.take(i, windows, ids, v, np.flatnonzero(wanted), exact)
        return made


def _indexed(rows: DataFrame, dims: int, books) -> DataFrame:
    """Every row with its codes and residual norms."""
    schema = "vec_id long, label long, v array<long>, codes binary, norms binary"
    out = arrow_schema(T._parse_datatype_string(schema))

    def encode(batches):
        for b in batches:
            if len(b):
                codes, norms = books.value.encode(_matrix(b.column(2), dims))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([c.tobytes() for c in codes]), pa.array([n.tobytes() for n in norms])], schema=out)

    return rows.select("vec_id", "label", "v").mapInArrow(encode, schema)


def _windows(index: DataFrame, anchors: DataFrame, size: int, queries: int, dims: int, books, k: int, same: bool) -> DataFrame:
    """``(anchor_id, low, high, vec_id, score)``: the ``k`` best rows of each window of each anchor.

    ``anchors`` holds ``(vec_id, label, v, low array<long>, high array<long>)``.
    A cell is a slice of the rows against a part of the anchors; a task holds the
    part and lets the slice stream past it, so its memory does not grow with the
    rows.
    """
    slices, parts = max(1, min(SLICES, -(-size // SLICE_ROWS))), max(1, -(-queries // HELD))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    cell = (F.col("slice") * parts + F.col("part")).alias("cell")
    asking = anchors.select("*", deal(parts).alias("part"), all_of(slices).alias("slice")).select(cell, F.lit(0).alias("tag"), "vec_id", "label", "v", none("binary").alias("codes"), none("binary").alias("norms"), "low", "high")
    asked = index.select("*", deal(slices).alias("slice"), all_of(parts).alias("part")).select(cell, F.lit(1).alias("tag"), "vec_id", "label", "v", "codes", "norms", none("array<long>").alias("low"), none("array<long>").alias("high"))
    met = asking.unionByName(asked).repartition(slices * parts, "cell").sortWithinPartitions("cell", "tag")
    schema = "anchor_id long, low long, high long, vec_id long, score long"
    out = arrow_schema(T._parse_datatype_string(schema))

    def best(held: Held | None):
        if held is not None:
            i, w, j = np.nonzero(held.scores > LEAST)
            for at in range(0, len(i), 10_000):
                x, y, z = (t[at : at + 10_000] for t in (i, w, j))
                yield batch(out, held.ids[x], held.low[x, y], held.high[x, y], held.found[x, y, z], held.scores[x, y, z])

    def search(batches):
        now, waiting, held = None, [], None
        for b in batches:
            cells, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(tags) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(b)]):
                if i == j:
                    continue
                if cells[i] != now:
                    yield from best(held)
                    now, waiting, held = cells[i], [], None
                run = b.slice(i, j - i)
                if tags[i] == 0:
                    waiting.append(run)
                    continue
                if held is None and waiting:
                    held, waiting = Held.of(waiting, dims, k), []
                if held is not None:
                    read = lambda c, kind: np.frombuffer(b"".join(run.column(c).to_pylist()), kind).reshape(j - i, -1)  # noqa: B023, E731
                    held.search(books.value, run.column(2).to_numpy(), run.column(3).to_numpy(), _matrix(run.column(4), dims), read(5, np.uint8), read(6, np.float32), same)
        yield from best(held)

    hits = met.mapInArrow(search, schema).groupBy("anchor_id", "low", "high")
    top = hits.agg(F.slice(F.array_sort(F.collect_list(F.struct((-1 - F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return top.select("anchor_id", "low", "high", F.posexplode("best").alias("pos", "hit")).select("anchor_id", "low", "high", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-1 - F.col("hit.s")).alias("score"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, seed: int = 5) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` and ``anchors`` hold ``(vec_id, label, v)`` with distinct ids, as
    :func:`quantised` makes them. An anchor's positives are the ``positives``
    other rows of its label with the highest products; for each, the negatives
    are the ``negatives`` highest rows of other labels from ``least`` to ``most``
    hundredths of its product. Ties go to the smaller ``vec_id``. An anchor
    without positives, and a positive without such rows, has no row here. Vectors
    of other lengths count as if they ended in zeros; a hundred times a product
    must fit a long.
    """
    spark, result = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = durable(rows.select("vec_id", "label", "v"))
    anchors = durable(anchors.select("vec_id", "label", "v"))
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    asked = anchors.agg(F.max(F.size("v")).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    if not size.n or not asked.n:
        return spark.createDataFrame([], result)
    dims = max(size.dims, asked.dims, 1)
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    books = spark.sparkContext.broadcast(Codebooks(_matrix(sample, dims).astype(np.float64), seed))
    index = durable(_indexed(rows, dims, books))

    open_window = [F.array(F.lit(x).cast("long")).alias(n) for x, n in ((int(LEAST) + 1, "low"), (int(MOST), "high"))]
    alike = durable(_windows(index, anchors.select("vec_id", "label", "v", *open_window), size.n, asked.n, dims, books, positives, True))
    # a window for each different product of an anchor's positives: from the least whole number in it to the greatest
    low, high = f"({least} * score + pmod(({-least}) * score, 100)) div 100", f"({most} * score - pmod({most} * score, 100)) div 100"
    pairs = alike.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(low).alias("low"), F.expr(high).alias("high")).where("low <= high")
    limits = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("w")).select("vec_id", "w.low", "w.high")
    unlike = _windows(index, anchors.join(limits, "vec_id"), size.n, asked.n, dims, books, negatives, False)
    renamed = unlike.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return pairs.join(renamed, ["anchor_id", "low", "high"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle_sql() -> str:
    """The query's result in DuckDB's SQL, all anchors against all rows."""
    return """
WITH r AS (
    SELECT vec_id, max({'v': v, 'label': label}) AS s FROM (
        SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ) GROUP BY vec_id
), s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.s.label = c.s.label AS alike,
           CAST(coalesce(list_sum(list_transform(range(1, len(a.s.v) + 1), lambda i: a.s.v[i] * c.s.v[i])), 0) AS BIGINT) AS score
    FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
