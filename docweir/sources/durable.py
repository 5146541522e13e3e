"""Cutting a plan: what is used several times is computed once and kept where all executors see it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import files


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share; a temporary one where all run in this process and it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="docweir-")


def durable(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes when the driver ends, if not before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where, fs = files.located(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path
