"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The table is written once as it lies, each row with its number and a hash of its
values. Virtual partitions are made by that hash, so that the result does not
depend on how the table lies. A matrix says how many rows of
each partition go to each shard: it is drawn with the exact law that a uniform
shuffle has, a multivariate hypergeometric one, from nothing but the partitions'
and shards' row counts. Each partition is permuted locally and dealt by its row of
the matrix, each shard is permuted again in pieces that lie one after the other.
All that is done on numbers and hashes alone; then the rows are exchanged, once.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, scratch_folder

#: Virtual partitions: one for so many rows, and never more than this.
PARTITION_ROWS, MAX_PARTITIONS = 2_000, 4_096


def _stirling_error(n: int) -> float:
    """log(n!) less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (0.5 * math.log(2 * math.pi * n) + n * math.log(n) - n) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: float, m: float) -> float:
    """x log(x / m) + m - x, without cancellation where x is near m."""
    if abs(x - m) >= 0.1 * (x + m):
        return x * math.log(x / m) + m - x
    v = (x - m) / (x + m)
    total, term, j = (x - m) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def _binomial(x: int, n: int, p: float) -> float:
    """The logarithm of the binomial probability by saddle-point expansion (Loader, 2000), exact at any size."""
    if x == 0 or x == n:
        return n * (math.log1p(-p) if x == 0 else math.log(p)) if n else 0.0
    error = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
    return error - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) - 0.5 * (math.log(2 * math.pi) + math.log(x) + math.log1p(-x / n))


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good + bad`` are good, by inversion outwards from the mode; any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = draws / (good + bad)
    at_mode = math.exp(_binomial(mode, good, p) + _binomial(draws - mode, bad, p) - _binomial(draws, good + bad, p))
    left = rng.random() - at_mode
    a, b, pa, pb = mode, mode, at_mode, at_mode
    while left > 0:
        pb = pb * (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1)) if b < high else 0.0
        pa = pa * a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1)) if a > low else 0.0
        if pa <= 0.0 and pb <= 0.0:
            break
        b, a = min(b + 1, high), max(a - 1, low)
        left -= pb
        if left <= 0:
            return b
        left -= pa
        if left <= 0:
            return a
    return mode


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows from each partition to each shard, as a uniform shuffle would send them."""
    rng, left, out = random.Random(seed), list(shards), []
    for n in rows:
        line, rest = [], n
        for s, size in enumerate(left):
            others = sum(left[s + 1 :])
            take = _hypergeometric(rng, size, others, rest) if rest and size else 0
            line.append(take)
            rest -= take
        left = [a - b for a, b in zip(left, line)]
        out.append(line)
    return out


def _literal_table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table of known bound as a literal of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _numbered(lying: DataFrame) -> DataFrame:
    """``(_row, _h1, _h2, _copy)``: rows alike are told apart by a number.

    They are numbered within what one task wrote and moved on by what the tasks
    before it wrote, so no task gathers all copies of a row.
    """
    rows = lying.select("_row", "_h1", "_h2", F.shiftright("_row", 33).alias("_task"))
    own = ["_h1", "_h2", "_task"]
    written = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_h1", "_h2").orderBy("_task")) - F.col("_n")
    ahead = written.select(*own, before.alias("_ahead")).where("_ahead > 0")
    within = F.row_number().over(Window.partitionBy(*own).orderBy("_row"))
    return rows.withColumn("_copy", within.cast("long")).join(ahead, own, "left").select("_row", "_h1", "_h2", (F.col("_copy") + F.coalesce("_ahead", F.lit(0))).alias("_copy"))


def shuffled(df: DataFrame, shards: int, seed: int = 11) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 without gaps in each shard).

    Every assignment with shard sizes at most one apart is equally likely, as
    far as hashes of the rows and of ``seed`` are random; the same rows and seed
    give the same result. Rows alike in every column are told apart by a number,
    so the columns must be of types that can be hashed. Nulls are values like
    any other; columns named ``shard`` or ``slot`` are replaced;
    an empty table gives an empty one. The table is written to the shared folder
    once, where it stays until the driver ends.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    path = scratch_folder(spark, "shards")
    base = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    # a null leaves a hash as it is, so where the nulls are is hashed too
    hashed = [*names.values(), *[F.col(n).isNull() for n in names.values()]]
    base.select("*", F.monotonically_increasing_id().alias("_row"), F.xxhash64(F.lit(1), *hashed).alias("_h1"), F.xxhash64(F.lit(2), *hashed).alias("_h2")).write.mode("overwrite").parquet(path)
    lying = spark.read.parquet(path)
    total = lying.count()
    parts = max(1, min(MAX_PARTITIONS, -(-total // PARTITION_ROWS)))
    own = ["_h1", "_h2", "_copy"]
    keyed = lambda salt: F.xxhash64(*own, F.lit(seed), F.lit(salt))
    rows = durable(_numbered(lying).withColumn("_part", F.pmod(keyed(1), F.lit(parts)).cast("int")))
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], sizes, seed)
    cuts = _literal_table(spark, [{"_part": p, "ends": [sum(line[: s + 1]) for s in range(shards)]} for p, line in enumerate(matrix)], "_part: int, ends: array<bigint>")
    local = Window.partitionBy("_part").orderBy(keyed(2), *own)
    dealt = rows.withColumn("_at", F.row_number().over(local).cast("long")).join(F.broadcast(cuts), "_part")
    dealt = dealt.withColumn("shard", F.aggregate("ends", F.lit(0), lambda n, end: n + (F.col("_at") > end).cast("int")))
    # what a shard receives is permuted again: by piece, and within the piece
    pieces = max(1, -(-parts // shards))
    dealt = durable(dealt.select("_row", *own, "shard", F.pmod(keyed(3), F.lit(pieces)).cast("int").alias("_piece")))
    received = dealt.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("n")).collect()
    ahead, offsets = 0, []
    for i, r in enumerate(found := sorted(received, key=lambda r: (r["shard"], r["_piece"]))):
        ahead = 0 if i == 0 or found[i - 1]["shard"] != r["shard"] else ahead
        offsets.append({"shard": r["shard"], "_piece": r["_piece"], "before": ahead})
        ahead += r["n"]
    starts = _literal_table(spark, offsets, "shard: int, _piece: int, before: bigint")
    within = Window.partitionBy("shard", "_piece").orderBy(keyed(4), *own)
    placed = dealt.withColumn("_at", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "_piece"])
    placed = placed.select("_row", "shard", (F.col("before") + F.col("_at") - 1).alias("slot"))
    return lying.join(placed, "_row").select(*[F.col(n).alias(c) for c, n in names.items()], "shard", "slot")
