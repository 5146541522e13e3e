"""What the training-data operators share: table access, durable cuts and packed strings."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share; a temporary one where all run in this process and it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="docweir-ckpt-")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    That folder is :func:`shared_folder`.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes when the driver ends, if not before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is set to suit the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A sieve has so many bits at most: 262,144 rows of 64.
SIEVE_BITS = 1 << 24


def sifted(df: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``column`` may be in ``ids``, and rows in which it certainly is not, nulls included.

    A bit for each hash of an id is set in a table of bounded size, which is
    broadcast. Beyond a sixteenth of ``SIEVE_BITS`` ids it lets more rows
    through; what is let through is to be joined with the ids themselves.
    """
    (name,) = ids.columns
    ids = ids.where(F.col(name).isNotNull())
    bits = min(SIEVE_BITS, max(64, 1 << (16 * ids.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word = lambda s: F.floor(s / 64)
    mask = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), (s % 64).cast("int"))
    at, key, mark = (fresh(df, x) for x in ("slot", "word", "bits"))
    sieve = durable(ids.select(slot(F.col(name)).alias("s")).groupBy(word(F.col("s")).alias(key)).agg(F.bit_or(mask(F.col("s"))).alias(mark)))
    marked = df.withColumn(at, slot(F.col(f"`{column}`"))).withColumn(key, word(F.col(at))).join(F.broadcast(sieve), key, "left")
    hit = F.col(f"`{column}`").isNotNull() & (F.coalesce(F.col(mark), F.lit(0).cast("long")).bitwiseAND(mask(F.col(at))) != 0)
    names = [F.col(f"`{c}`") for c in df.columns]
    return marked.where(hit).select(*names), marked.where(~hit).select(*names)


def _planes(values) -> bytes:
    return np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_strings(words: list[str]) -> bytes:
    """Strings as what each shares with the one before and what follows, compressed; sorted ones take the least room."""
    shared, left, rest, before = [], [], [], b""
    for w in words:
        w = w.encode()
        k, most = 0, min(len(w), len(before))
        while k < most and w[k] == before[k]:
            k += 1
        shared.append(k)
        left.append(len(w) - k)
        rest.append(w[k:])
        before = w
    return zstandard.compress(np.uint32(len(words)).tobytes() + _planes(shared) + _planes(left) + b"".join(rest), 9)


def unpack_strings(blob: bytes) -> list[str]:
    """The inverse of :func:`pack_strings`."""
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    shared, left = _from_planes(data[4 : 4 + 4 * n]).tolist(), _from_planes(data[4 + 4 * n : 4 + 8 * n]).tolist()
    out, before, at = [], b"", 4 + 8 * n
    for k, m in zip(shared, left):
        before = before[:k] + data[at : at + m]
        at += m
        out.append(before.decode())
    return out


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers under 2**32 as compressed byte planes."""
    return zstandard.compress(_planes(values), 1)


def unpack_ints(blob: bytes) -> np.ndarray:
    return _from_planes(zstandard.decompress(blob))


def pack_lists(lists: list[list[int]]) -> bytes:
    """Lists of non-negative integers under 2**32: their lengths, then all of them in as few bytes each as the largest needs."""
    flat = np.concatenate([np.asarray(x, np.uint32) for x in lists]) if lists else np.zeros(0, np.uint32)
    kind = "<u2" if flat.max(initial=0) < 1 << 16 else "<u4"
    head = np.array([len(lists), int(kind[2])], "<u4").tobytes()
    return zstandard.compress(head + _planes([len(x) for x in lists]) + flat.astype(kind).tobytes(), 9)


def unpack_lists(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The lengths and all integers."""
    data = zstandard.decompress(blob)
    n, width = np.frombuffer(data, "<u4", 2).tolist()
    return _from_planes(data[8 : 8 + 4 * n]), np.frombuffer(data, f"<u{width}", offset=8 + 4 * n).astype(np.uint32)


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
