"""A read-only source over an SQLite file, for message stores kept there: ``spark.read.format("sqlite")`` and ``spark.readStream``."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from .tables import SCHEMAS

#: Comparisons that SQLite makes as Spark does: texts by their bytes, numbers by value.
COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


class _Range(ds.InputPartition):
    """Rows with ids from ``low`` to ``high``, by further conditions."""

    def __init__(self, low: int, high: int, conditions: list[tuple[str, list]]):
        super().__init__((low, high, conditions))


class _File:
    """A table of the file, through short-lived connections; no file or no table has no rows."""

    def __init__(self, schema, options):
        self.names, self.path, self.table, self.parts = schema.names, options["path"], options["table"], int(options.get("partitions", 1))
        self.kinds = {f.name: f.dataType.typeName() for f in schema.fields}

    def rows(self, sql: str, *args) -> list:
        if not Path(self.path).exists():
            return []
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            con.execute("PRAGMA query_only = ON")
            return con.execute(sql, args).fetchall()
        except sqlite3.OperationalError:
            return []
        finally:
            con.close()

    @property
    def name(self) -> str:
        return '"' + self.table.replace('"', '""') + '"'

    def columns(self) -> set[str]:
        return {r[1] for r in self.rows(f"PRAGMA table_info({self.name})")}

    def condition(self, f: ds.Filter) -> tuple[str, list] | None:
        """A filter in SQL with its values; none if SQLite cannot be trusted to decide it alike."""
        if isinstance(f, ds.Not):
            return None
        column = f.attribute[0] if len(f.attribute) == 1 else None
        if column not in self.columns():
            return None
        if isinstance(f, (ds.IsNull, ds.IsNotNull)):
            return f'"{column}" IS {"NOT " if isinstance(f, ds.IsNotNull) else ""}NULL', []
        values = list(f.value) if isinstance(f, ds.In) else [f.value] if type(f) in COMPARED else []
        like = str if self.kinds[column] == "string" else int
        if not values or not all(type(v) is like for v in values):
            return None
        # a value of another kind than the column's is left to Spark, which casts it
        kind = "text" if like is str else "integer"
        test = f'"{column}" IN ({", ".join("?" * len(values))})' if isinstance(f, ds.In) else f'"{column}" {COMPARED[type(f)]} ?'
        return f"(typeof(\"{column}\") <> '{kind}' OR {test})", values

    def ranges(self, conditions: list[tuple[str, list]]) -> list[_Range]:
        ends = self.rows(f"SELECT min(rowid), max(rowid) FROM {self.name}")
        if not ends or ends[0][0] is None:
            return [_Range(0, -1, [])]
        low, high = ends[0]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(high, a + step - 1), conditions) for a in range(low, high + 1, step)]

    def read(self, partition) -> Iterator[tuple]:
        low, high, conditions = partition.value
        have = self.columns()
        columns = ", ".join(f'"{n}"' if n in have else "NULL" for n in self.names)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *(c for c, _ in conditions)])
        yield from self.rows(f"SELECT {columns} FROM {self.name} WHERE {where}", low, high, *(v for _, values in conditions for v in values))


class _Reader(ds.DataSourceReader):
    """Ranges of row ids, of which SQLite gives the wanted rows alone."""

    def __init__(self, schema, options):
        self.file, self.conditions = _File(schema, options), []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if (c := self.file.condition(f)) is not None:
                self.conditions.append(c)
            yield f  # Spark looks again: what a store holds may be of any kind

    def partitions(self):
        return self.file.ranges(self.conditions)

    def read(self, partition) -> Iterator[tuple]:
        yield from self.file.read(partition)


class _StreamReader(ds.DataSourceStreamReader):
    """New rows in the order of a cursor column and the row id; what a query's checkpoint has seen is not read again.

    A row whose cursor moves on, as ``updated_at`` does, comes again.
    """

    def __init__(self, schema, options):
        self.file, self.cursor = _File(schema, options), options.get("cursor", "rowid")

    @property
    def _by(self) -> str:
        known = self.cursor != "rowid" and self.cursor in self.file.columns()
        return "coalesce(\"" + self.cursor + "\", '')" if known else "''"

    def initialOffset(self) -> dict:
        return {"at": "", "row": -(2**62)}

    def latestOffset(self) -> dict:
        last = self.file.rows(f"SELECT {self._by}, rowid FROM {self.file.name} ORDER BY 1 DESC, 2 DESC LIMIT 1")
        return {"at": str(last[0][0]), "row": last[0][1]} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        place = f"({self._by}, rowid)"
        return self.file.ranges([(f"{place} > (?, ?) AND {place} <= (?, ?)", [start["at"], start["row"], end["at"], end["row"]])])

    def read(self, partition) -> Iterator[tuple]:
        yield from self.file.read(partition)


class SqliteSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema):
        return _Reader(schema, self.options)

    def streamReader(self, schema):
        return _StreamReader(schema, self.options)


def _named(reader, path: str, name: str, columns: list[str] | None, partitions: int):
    fields = [f for f in SCHEMAS[name].split(", ") if columns is None or f.split()[0] in columns]
    return reader.format("sqlite").schema(", ".join(fields)).option("path", path).option("table", name).option("partitions", partitions)


def sqlite_table(spark: SparkSession, path: str, name: str, partitions: int = 1, columns: list[str] | None = None) -> DataFrame:
    """A store's table by name, with the schema that stores have, or those ``columns`` of it alone; the file must be where executors see it.

    Equalities, comparisons, lists and null checks go to SQLite.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return _named(spark.read, path, name, columns, partitions).load()


def sqlite_stream(spark: SparkSession, path: str, name: str, cursor: str = "rowid", partitions: int = 1) -> DataFrame:
    """The table as a stream: a query that starts again on its checkpoint reads what is new by ``cursor``; on a new checkpoint, everything."""
    spark.dataSource.register(SqliteSource)
    return _named(spark.readStream, path, name, None, partitions).option("cursor", cursor).load()
