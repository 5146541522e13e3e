"""Files out of rows: pairs of a raw page and its Markdown, put in place together, batch by batch.

Tasks write pairs into a folder of their batch, and a journal names those of the
tasks that were committed. Only then are files moved to their places and the
state told. Whatever a job or a driver left at any point is either without a
journal, and goes, or with one, and is finished.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import files

#: Folders of batches begin so; the journal's name.
STAGING, JOURNAL = ".batch-", "journal.json"
PAIRS = "article_id string, file_name string, html string, markdown string, error string"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: ``(article_id, staged raw, staged Markdown, file name)``, and ``(article_id, error)`` of the others."""

    pairs: list[tuple[str, str, str, str]]
    errors: list[tuple[str, str]]


class PairWriter(DataSourceWriter):
    """Writes rows of ``PAIRS`` below a batch's folder; the journal is all that the commit adds."""

    def __init__(self, folder: str):
        self.folder = folder

    def _put(self, system: arrow_fs.FileSystem, path: str, text: str) -> None:
        with system.open_output_stream(path) as out:
            out.write(text.encode())

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = arrow_fs.FileSystem.from_uri(self.folder)
        own = f"{root}/{uuid.uuid4().hex}"  # a task that runs twice writes twice, and one of the two is committed
        system.create_dir(own, recursive=True)
        done = Written([], [])
        for k, r in enumerate(iterator):
            if r.error or not (r.markdown or "").strip():
                done.errors.append((r.article_id, r.error or "no text in the article"))
                continue
            raw, md = f"{own}/{k}.html", f"{own}/{k}.md"
            self._put(system, raw, r.html or "")
            self._put(system, md, r.markdown)
            done.pairs.append((r.article_id, raw, md, r.file_name))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = arrow_fs.FileSystem.from_uri(self.folder)
        said = [m for m in messages if m is not None]
        self._put(system, f"{root}/.new", json.dumps({"pairs": [p for m in said for p in m.pairs], "errors": [e for m in said for e in m.errors]}))
        system.move(f"{root}/.new", f"{root}/{JOURNAL}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = arrow_fs.FileSystem.from_uri(self.folder)
        if system.get_file_info(root).type != arrow_fs.FileType.NotFound:
            system.delete_dir(root)


class PairSink(DataSource):
    """``df.write.format("article_pairs").option("folder", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "article_pairs"

    def writer(self, schema: T.StructType, overwrite: bool) -> PairWriter:
        return PairWriter(self.options["folder"])


def stage(rows: DataFrame, markdown_dir: str) -> None:
    """Writes a batch of ``rows(article_id, file_name, html, markdown, error)`` beside the Markdown files, ready to be settled; nothing is left of a batch that fails.

    The folders must be shared by all executors and lie on one file system, any
    that Arrow knows.
    """
    rows.sparkSession.dataSource.register(PairSink)
    kinds = [x.split() for x in PAIRS.split(", ")]
    rows.select(*[F.col(n).cast(kind) for n, kind in kinds]).write.format("article_pairs").mode("append").option("folder", f"{files.arrow_path(rows.sparkSession, markdown_dir)}/{STAGING}{uuid.uuid4().hex}").save()


def staged(spark: SparkSession, markdown_dir: str) -> list[str]:
    """The batches' folders that are there."""
    return [f"{markdown_dir}/{n}" for n in files.names_in(spark, markdown_dir) if n.startswith(STAGING)]


def settle(spark: SparkSession, folder: str, raw_dir: str, markdown_dir: str) -> list[tuple[str, str, str, str]]:
    """Puts the files of a staged batch in their places: ``(article_id, raw_html_path, markdown_path, error)`` of each, as many as the batch has.

    The raw page goes first, so where there is Markdown its page is there too. A
    batch that was cut off half-way is finished: what has been moved stays.
    """
    if JOURNAL not in files.names_in(spark, folder):
        return []
    said = json.loads(files.read_text(spark, f"{folder}/{JOURNAL}"))
    system, root = arrow_fs.FileSystem.from_uri(files.arrow_path(spark, folder))
    out = [(i, "", "", e) for i, e in said["errors"]]
    raw_root, markdown_root = (arrow_fs.FileSystem.from_uri(files.arrow_path(spark, d))[1] for d in (raw_dir, markdown_dir))
    system.create_dir(raw_root, recursive=True)
    there = {x.path for x in system.get_file_info(arrow_fs.FileSelector(root, recursive=True))}
    for i, raw, md, name in said["pairs"]:
        for source, target in ((raw, f"{raw_root}/{i}.html"), (md, f"{markdown_root}/{name}")):
            if source in there:
                system.move(source, target)
        out.append((i, f"{raw_dir}/{i}.html", f"{markdown_dir}/{name}", ""))
    return out


def let_go(spark: SparkSession, folder: str) -> None:
    """A batch's folder goes once the state knows its outcome."""
    files.delete(spark, folder)


def files_in(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``(path, is_dir)`` of what lies in folders, listed by a task for each; missing folders are empty."""
    named = spark.createDataFrame([(f.rstrip("/"), files.arrow_path(spark, f)) for f in dict.fromkeys(folders)], "folder string, at string").repartition(max(1, len(folders)))

    def listed(batches):
        for b in batches:
            for folder, at in zip(b.folder, b["at"]):
                system, root = files.opened(at)
                found = system.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pd.DataFrame({"path": [f"{folder}/{x.base_name}" for x in part], "is_dir": [x.type == arrow_fs.FileType.Directory for x in part]})

    return named.mapInPandas(listed, "path string, is_dir boolean")


def delete_paths(paths: DataFrame) -> DataFrame:
    """Deletes the files and folders of ``paths(path)`` in tasks: ``(path, gone, error)`` of each.

    What is not there any more is neither gone nor an error, so a task that runs
    again reports less and deletes no more.
    """

    def delete(batches):
        for b in batches:
            out = []
            for p in b["path"]:
                try:
                    system, at = files.opened(p if ":" in p or p.startswith("/") else os.path.abspath(p))
                    kind = system.get_file_info(at).type
                    if kind == arrow_fs.FileType.Directory:
                        system.delete_dir(at)
                    elif kind != arrow_fs.FileType.NotFound:
                        system.delete_file(at)
                    out.append((p, kind != arrow_fs.FileType.NotFound, ""))
                except OSError as e:
                    out.append((p, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "gone", "error"])

    return paths.select("path").mapInPandas(delete, "path string, gone boolean, error string")
