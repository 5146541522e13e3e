"""State of articles and runs: merges that keep what must be kept.

Each operation is a function from tables to a table, and changes no rows but those
of the ids it is given. So :class:`StateStore` keeps tables in buckets of their
ids under a shared folder, and a merge rewrites those that it touches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.functions.text import ERROR_LENGTH
from docweir.sources import files
from docweir.sources.tables import SCHEMAS, empty

STATUSES = ("discovered", "have", "done", "failed")


def invalid_statuses(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status").isNull() | ~F.col("status").isin(*STATUSES))


def upserted(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``old`` merged with ``new(article_id, label_name, label_id, url, title, published_at, status, match_reason)``.

    Of new rows with one id the last by all columns counts. The URL, paths,
    error and creation time of an old row stay, ``done`` stays ``done``, all else
    is taken over.
    """
    taken = ["label_name", "label_id", "title", "published_at", "match_reason"]
    new = new.groupBy("article_id").agg(F.max(F.struct("url", "status", *taken)).alias("n"))
    both = old.withColumn("_old", F.lit(True)).join(new, "article_id", "full_outer")
    fresh, kept = F.col("n").isNotNull(), F.coalesce("_old", F.lit(False))
    pick = {c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(c)) for c in taken}
    pick |= {"url": F.when(kept, F.col("url")).otherwise(F.col("n.url"))}
    pick |= {"status": F.when(fresh & ~F.coalesce(F.col("status") == "done", F.lit(False)), F.col("n.status")).otherwise(F.col("status"))}
    pick |= {c: F.when(kept, F.col(c)).otherwise("") for c in ("raw_html_path", "markdown_path", "error_message")}
    pick |= {"created_at": F.when(kept, F.col("created_at")).otherwise(now), "updated_at": F.when(fresh, now).otherwise(F.col("updated_at"))}
    return both.select(*[(pick[c] if c in pick else F.col(c)).alias(c) for c in old.columns])


def marked_done(old: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """``done(article_id, raw_html_path, markdown_path)`` sets the status and paths and clears the error; unknown ids do nothing."""
    done = done.groupBy("article_id").agg(F.max(F.struct("raw_html_path", "markdown_path")).alias("d"))
    both, hit = old.join(done, "article_id", "left"), F.col("d").isNotNull()
    pick = {"status": F.when(hit, "done").otherwise(F.col("status")), "error_message": F.when(hit, "").otherwise(F.col("error_message")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    pick |= {c: F.when(hit, F.col(f"d.{c}")).otherwise(F.col(c)) for c in ("raw_html_path", "markdown_path")}
    return both.select(*[(pick[c] if c in pick else F.col(c)).alias(c) for c in old.columns])


def marked_failed(old: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """``failed(article_id, error_message)`` sets the status, of ``done`` rows too; the message is cut."""
    failed = failed.groupBy("article_id").agg(F.max("error_message").alias("_error"), F.lit(True).alias("_hit"))
    both, hit = old.join(failed, "article_id", "left"), F.coalesce("_hit", F.lit(False))
    pick = {"status": F.when(hit, "failed").otherwise(F.col("status")), "error_message": F.when(hit, F.left(F.coalesce("_error", F.lit("")), F.lit(ERROR_LENGTH))).otherwise(F.col("error_message")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return both.select(*[(pick[c] if c in pick else F.col(c)).alias(c) for c in old.columns])


def without_ids(old: DataFrame, ids: DataFrame) -> DataFrame:
    return old.join(ids.select("article_id").distinct(), "article_id", "left_anti").select(*old.columns)


def number_of_ids(old: DataFrame, ids: DataFrame) -> int:
    return old.join(ids.select("article_id").distinct(), "article_id", "left_semi").count()


def retried(old: DataFrame) -> DataFrame:
    """Failed rows become pending again."""
    return old.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def completed_urls(articles: DataFrame, label_name: str | None = None) -> DataFrame:
    """URLs of what is done, of a label if one is given; failed ones are tried again."""
    rows = articles.where("status = 'done'")
    return (rows.where(F.col("label_name") == label_name) if label_name else rows).select("url")


def counts(articles: DataFrame, label_name: str | None = None) -> DataFrame:
    """Rows by status, of a label if one is given."""
    rows = articles.where(F.col("label_name") == label_name) if label_name else articles
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def articles_for_label(articles: DataFrame, label_name: str) -> DataFrame:
    return articles.where(F.col("label_name") == label_name).orderBy(F.col("published_at").desc(), "article_id")


class Conflict(RuntimeError):
    """Another writer was there first."""


class StateStore:
    """Tables in buckets of their key's hash; a manifest names the version of each bucket that counts.

    ``name/data/v=N/b=K`` holds the rows of bucket ``K`` as version ``N`` left
    them, ``name/manifest/N`` which version each bucket has. A merge reads and
    writes the buckets of its keys alone, whatever the table's size. A version
    counts from when its manifest is there, so one that was cut off never does.
    One writer at a time: of two that meet one fails. Rows are read lazily, so
    what is read must be used before ``keep`` further versions are written.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, keep: int = 3):
        self.spark, self.folder, self.buckets, self.keep = spark, folder.rstrip("/"), buckets, keep

    def versions(self, name: str) -> list[int]:
        return sorted(int(x) for x in files.names_in(self.spark, f"{self.folder}/{name}/manifest") if x.isdigit())

    def manifest(self, name: str, version: int | None = None) -> dict:
        """``{"buckets": number, "at": {bucket: version}}``; the number of a table that is there already stays."""
        v = self.versions(name)
        if not v:
            return {"buckets": self.buckets, "at": {}}
        found = json.loads(files.read_text(self.spark, f"{self.folder}/{name}/manifest/{v[-1] if version is None else version}"))
        return {"buckets": found["buckets"], "at": {int(k): x for k, x in found["at"].items()}}

    @staticmethod
    def key(name: str) -> str:
        return SCHEMAS[name].split()[0]

    def bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key(name)), F.lit(buckets)).cast("int")

    def _read(self, name: str, at: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/{name}/data/v={v}/b={k}" for k, v in sorted(at.items())]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else empty(self.spark, name)

    def read(self, name: str) -> DataFrame:
        return self._read(name, self.manifest(name)["at"])

    def merge(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets of ``keys`` by what ``change`` makes of their rows; the buckets that were written.

        ``change`` gets the rows of these buckets and must give rows whose keys
        are in them.
        """
        m = self.manifest(name)
        touched = sorted(r.b for r in keys.select(self.bucket(name, m["buckets"]).alias("b")).distinct().collect())
        if touched:
            self._publish(name, m, change(self._read(name, {k: m["at"][k] for k in touched if k in m["at"]})), touched)
        return touched

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces all rows."""
        m = self.manifest(name)
        self._publish(name, m, df, list(range(m["buckets"])))

    def _publish(self, name: str, m: dict, rows: DataFrame, touched: list[int]) -> None:
        v = self.versions(name)
        new, base = (v[-1] + 1 if v else 0), f"{self.folder}/{name}"
        b = F.col("_bucket")
        dealt = rows.withColumn("_bucket", self.bucket(name, m["buckets"]))
        dealt = dealt.withColumn("b", F.when(b.isin(touched), b).otherwise(F.raise_error(F.lit("a row outside the buckets of the keys")).cast("int"))).drop("_bucket")
        dealt.repartition(min(len(touched), 200), "b").write.mode("overwrite").partitionBy("b").parquet(f"{base}/data/v={new}")
        written = {int(x[2:]): new for x in files.names_in(self.spark, f"{base}/data/v={new}") if x.startswith("b=")}
        at = {k: x for k, x in m["at"].items() if k not in touched} | written
        if not files.write_text(self.spark, f"{base}/manifest/{new}", json.dumps({"buckets": m["buckets"], "at": at})):
            raise Conflict(f"version {new} of {name} is there already")
        self._clean(name, [*v, new])

    def _clean(self, name: str, versions: list[int]) -> None:
        """Lets go of manifests but the last ones, and of buckets that none of these names."""
        base, kept = f"{self.folder}/{name}", versions[-self.keep :]
        used = {(x, k) for n in kept for k, x in self.manifest(name, n)["at"].items()}
        for n in versions[: -self.keep]:
            files.delete(self.spark, f"{base}/manifest/{n}")
        for v in files.names_in(self.spark, f"{base}/data"):
            n = int(v[2:])
            there = [x for x in files.names_in(self.spark, f"{base}/data/{v}") if x.startswith("b=")]
            left = [x for x in there if (n, int(x[2:])) in used]
            for x in [] if n in kept else set(there) - set(left):
                files.delete(self.spark, f"{base}/data/{v}/{x}")
            if not left and n < kept[0]:
                files.delete(self.spark, f"{base}/data/{v}")

    def start_run(self, label_name: str, started_at: str, dry_run: bool = False) -> int:
        """Appends a run that is under way, with the next number."""
        run_id = (self.read("runs").agg(F.max("run_id").alias("m")).first().m or 0) + 1
        row = self.spark.createDataFrame([(run_id, label_name, started_at, None, 0, 0, 0, 0, dry_run)], SCHEMAS["runs"])
        self.merge("runs", row, lambda runs: runs.unionByName(row))
        return run_id

    def complete_run(self, run_id: int, completed_at: str, listed: int, held: int, written: int, failed: int) -> None:
        hit = F.col("run_id") == run_id
        values = {"completed_at": F.lit(completed_at), "articles_listed": F.lit(listed), "articles_held": F.lit(held), "articles_written": F.lit(written), "articles_failed": F.lit(failed)}
        closed = lambda runs: runs.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(dict(runs.dtypes)[c]) for c, v in values.items()})
        self.merge("runs", self.spark.createDataFrame([(run_id,)], "run_id long"), closed)

    def last_run(self, label_name: str | None = None) -> DataFrame:
        runs = self.read("runs")
        runs = runs.where(F.col("label_name") == label_name) if label_name else runs
        return runs.orderBy(F.col("run_id").desc()).limit(1)
