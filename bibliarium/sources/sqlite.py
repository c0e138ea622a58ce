"""Tables of SQLite files as a Spark data source, format "sqlite".

Options: path (a file that all executors can open), table, and partitions (ranges of row numbers that are read side by
side). Columns that a query doesn't select are not read where Spark prunes them after the scan only; types follow the
declared ones: INTEGER, REAL and BLOB, anything else as strings.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _name(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.parts, self.schema = options["path"], options["table"], int(options.get("partitions", 8)), schema

    def partitions(self) -> list[Rows]:
        with _open(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.parts)
        return [Rows(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, partition: Rows | None) -> Iterator[tuple]:
        if partition is None:
            return
        casts = [{"bigint": int, "double": float, "binary": bytes}.get(f.dataType.simpleString(), str) for f in self.schema]
        with _open(self.path) as con:
            for row in con.execute(f"SELECT {', '.join(_name(f.name) for f in self.schema)} FROM {_name(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last)):
                yield tuple(None if v is None else cast(v) for v, cast in zip(row, casts))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        kinds = {"INTEGER": T.LongType(), "INT": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BLOB": T.BinaryType()}
        with _open(self.options["path"]) as con:
            found = con.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(name, kinds.get(kind.upper(), T.StringType())) for _, name, kind, *_ in found])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader({k: self.options.get(k) for k in ("path", "table", "partitions") if self.options.get(k) is not None}, schema)


def register(spark) -> None:
    spark.dataSource.register(SqliteSource)
