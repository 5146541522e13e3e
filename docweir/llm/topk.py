"""Exact top-k inner products by block-at-a-time pruning.

Rows are put into document-range blocks: near a common centre, then by id. A
block keeps its forward index (the ids and the vectors of its rows) and, for
each dimension, its largest and smallest value. For a query, the summed term
maxima of a block bound the score of any of its rows. Each query goes through
the blocks from the highest bound down and stops when the bound falls below its
k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch, durable, shuffle_width

#: Rows of a block; blocks that one task searches at once; queries that travel together.
BLOCK_ROWS, GROUP_BLOCKS, QUERY_CHUNK = 256, 64, 256
#: The centres are fitted on at most so many rows, the ones with the smallest hashes.
CENTRE_SAMPLE, CENTRES = 4096, 64


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, v array<long>)``: floor(scale * x) of each component, as double.

    Rows whose vector is null or holds a null or non-finite component take no
    part, nor do rows with a null ``vec_id``. Of rows that repeat a ``vec_id``
    the one with the largest vector, in the order of arrays, stays.
    """
    x = F.col("embedding").cast("array<double>")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(ok)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v")).groupBy("vec_id").agg(F.max("v").alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    """Arrays as rows of ``dims`` columns; shorter ones end in zeros."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    out = np.zeros((len(column), dims), np.int64)
    lengths = np.diff(ends)
    if len(lengths) and (lengths == dims).all():
        return flat[ends[0] : ends[-1]].reshape(-1, dims).astype(np.int64)
    for i in range(len(column)):
        out[i, : lengths[i]] = flat[ends[i] : ends[i + 1]]
    return out


def _centres(rows: DataFrame, dims: int, seed: int) -> np.ndarray:
    """A few rounds of spherical k-means on a bounded sample; only the order of the rows depends on it."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(CENTRE_SAMPLE).toArrow().column("v").combine_chunks()
    x = _matrix(sample, dims).astype(np.float64)
    x = np.unique(x, axis=0)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:CENTRES]]
    for _ in range(6):
        nearest = (x @ centres.T).argmax(axis=1)
        for c in np.unique(nearest):
            m = x[nearest == c].mean(axis=0)
            centres[c] = m / max(np.linalg.norm(m), 1e-9)
    return centres


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``; by floating point where that is exact."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T


def _bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The summed term maxima: no row between ``low`` and ``top`` has a higher product with ``q``."""
    exact = float(np.abs(q).max(initial=0)) * float(max(np.abs(top).max(initial=0), np.abs(low).max(initial=0))) * q.shape[1] < 2**52
    return _product(np.maximum(q, 0), top, exact) + _product(np.minimum(q, 0), low, exact)


def _search(q: np.ndarray, own: np.ndarray, floor: np.ndarray, blocks: list[dict], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's best rows of ``blocks``; ``floor`` is a score that its k-th is known to reach."""
    top = np.stack([b["top"] for b in blocks])
    low = np.stack([b["low"] for b in blocks])
    exact = float(np.abs(q).max(initial=0)) * float(max(np.abs(top).max(initial=0), np.abs(low).max(initial=0))) * q.shape[1] < 2**52
    bound = _bounds(q, top, low)
    out = []
    for i in range(len(q)):
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = floor[i]
        for b in np.argsort(-bound[i], kind="stable").tolist():
            if bound[i, b] < least:
                break
            block = blocks[b]
            if len(scores) == k and bound[i, b] == scores[-1] and block["ids"].min() > ids[-1]:
                continue
            s, c = _product(q[i : i + 1], block["rows"], exact)[0], block["ids"]
            keep = (s >= least) & (c != own[i])
            if keep.any():
                scores, ids = _best(np.r_[scores, s[keep]], np.r_[ids, c[keep]], k)
                if len(scores) == k:
                    least = max(least, scores[-1])
        out.append((i, scores, ids))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, seed: int = 7) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` with the ``k`` rows of highest inner product for each query, its own row left out.

    Both tables hold ``(vec_id long, v array<long>)`` with distinct ids, as
    :func:`quantised` makes them. Ties go to the smaller ``vec_id``; a query
    with fewer other rows has as many ranks as there are. A query is sent to those
    groups of blocks alone whose maxima can reach its floor. Vectors of other
    lengths count as if they ended in zeros; a product must fit a long.
    """
    spark = vectors.sparkSession
    rows = durable(vectors.select("vec_id", "v"))
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not size.n:
        return spark.createDataFrame([], result)
    dims = max(size.dims, 1)
    centres = _centres(rows, dims, seed)
    near = "c int, vec_id long, v array<long>"
    near_out = arrow_schema(T._parse_datatype_string(near))

    def place(batches):
        for b in batches:
            if len(b):
                c = (_matrix(b.column(1), dims).astype(np.float64) @ centres.T).argmax(axis=1)
                yield batch(near_out, c, b.column(0), b.column(1))

    groups = max(shuffle_width(spark), -(-size.n // (BLOCK_ROWS * GROUP_BLOCKS)))
    groups = max(1, min(groups, -(-size.n // BLOCK_ROWS)))
    ordered = rows.mapInArrow(place, near).repartitionByRange(groups, "c", "vec_id").sortWithinPartitions("c", "vec_id")
    block = "grp int, ids binary, rows binary, top binary, low binary"
    block_out = arrow_schema(T._parse_datatype_string(block))

    def index(batches):
        grp = TaskContext.get().partitionId()
        ids, vs = np.zeros(0, np.int64), np.zeros((0, dims), np.int64)

        def cut(n):
            x = vs[:n]
            return batch(block_out, [grp], [ids[:n].tobytes()], [x.tobytes()], [x.max(axis=0).tobytes()], [x.min(axis=0).tobytes()])

        for b in batches:
            if len(b):
                ids, vs = np.r_[ids, b.column(1).to_numpy()], np.concatenate([vs, _matrix(b.column(2), dims)])
            while len(ids) >= BLOCK_ROWS:
                yield cut(BLOCK_ROWS)
                ids, vs = ids[BLOCK_ROWS:], vs[BLOCK_ROWS:]
        if len(ids):
            yield cut(len(ids))

    blocks = durable(ordered.mapInArrow(index, block))

    def read_block(b: dict) -> dict:
        return {"ids": np.frombuffer(b["ids"], np.int64), "rows": np.frombuffer(b["rows"], np.int64).reshape(-1, dims), "top": np.frombuffer(b["top"], np.int64), "low": np.frombuffer(b["low"], np.int64)}

    # A group's maxima bound the score of all its rows; those of so many neighbouring groups together as make them fit are broadcast.
    together = max(1, -(-groups * dims * 16 // BOUNDS_BYTES))
    bounds = "grp int, top binary, low binary"

    def widest(part: pa.Table) -> pa.Table:
        read = lambda c: np.stack([np.frombuffer(x.as_py(), np.int64) for x in part.column(c)])
        return pa.table({"grp": pa.array(part.column("grp").to_numpy()[:1], pa.int32()), "top": pa.array([read("top").max(axis=0).tobytes()]), "low": pa.array([read("low").min(axis=0).tobytes()])})

    by_group = blocks.select("grp", "top", "low").groupBy("grp").applyInArrow(widest, bounds)
    got = by_group.withColumn("grp", F.floor(F.col("grp") / together).cast("int")).groupBy("grp").applyInArrow(widest, bounds).toArrow().to_pylist()
    known = spark.sparkContext.broadcast((np.array([x["grp"] for x in got]), *(np.stack([np.frombuffer(x[c], np.int64) for x in got]) for c in ("top", "low"))))

    # Queries travel in chunks: ids, vectors and a score that each k-th is known to reach, from a bounded seed of blocks.
    # A chunk goes to the groups whose bound some of its queries can reach, with those queries alone.
    chunk = "grp int, part int, ids binary, rows binary, floor binary"
    chunk_out = arrow_schema(T._parse_datatype_string(chunk))
    seeds = [read_block(b.asDict()) for b in blocks.orderBy(F.xxhash64("ids")).limit(SEED_BLOCKS).collect()]
    parts = max(1, -(-queries.count() // PART_QUERIES))

    def pack_queries(batches):
        for b in batches:
            for i in range(0, len(b), QUERY_CHUNK):
                part = b.slice(i, QUERY_CHUNK)
                q, own = _matrix(part.column(1), dims), part.column(0).to_numpy()
                floor = np.full(len(q), np.iinfo(np.int64).min)
                for j, scores, _ in _search(q, own, floor, seeds, k):
                    if len(scores) == k:
                        floor[j] = scores[-1]
                to = int(own[0]) % parts
                names, top, low = known.value
                reach = _bounds(q, top, low) >= floor[:, None]
                for n in np.flatnonzero(reach.any(axis=0)).tolist():
                    at = reach[:, n]
                    for g in range(int(names[n]) * together, min(groups, (int(names[n]) + 1) * together)):
                        yield batch(chunk_out, [g], [to], [own[at].tobytes()], [q[at].tobytes()], [floor[at].tobytes()])

    dealt = durable(queries.select("vec_id", "v").mapInArrow(pack_queries, chunk))
    # a block goes to those parts of the queries alone of which some ask for its group
    asked = dealt.select(F.col("grp").alias("asked"), F.col("part").alias("by")).distinct()
    spread = blocks.join(asked, F.col("grp") == F.col("asked")).select("grp", F.col("by").alias("part"), "ids", "rows", "top", "low")
    found = "query_id long, vec_id long, score long"

    def search(qs: pa.Table, bs: pa.Table) -> pa.Table:
        own_blocks = [read_block(b) for b in bs.select(["ids", "rows", "top", "low"]).to_pylist()]
        out = ([], [], [])
        if own_blocks:
            for x in qs.to_pylist():
                own = np.frombuffer(x["ids"], np.int64)
                for i, scores, ids in _search(np.frombuffer(x["rows"], np.int64).reshape(-1, dims), own, np.frombuffer(x["floor"], np.int64), own_blocks, k):
                    out[0].append(np.full(len(ids), own[i]))
                    out[1].append(ids)
                    out[2].append(scores)
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": cat(out[0]), "vec_id": cat(out[1]), "score": cat(out[2])})

    hits = dealt.groupBy("grp", "part").cogroup(spread.groupBy("grp", "part")).applyInArrow(search, found)
    best = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


#: So many blocks give every query its first floor.
SEED_BLOCKS = 16
#: So many bytes of maxima are broadcast at most: of groups, or of as many neighbouring ones together as it takes. One task searches for so many queries at most.
BOUNDS_BYTES, PART_QUERIES = 32_000_000, 65_536
