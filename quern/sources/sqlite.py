"""A Spark data source for SQLite files, opened read-only."""

from __future__ import annotations

import os
import sqlite3
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def connect_readonly(path: str) -> sqlite3.Connection:
    """By URI, its path escaped; a file that is absent is not created."""
    return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.parts = options["path"], options["dbtable"], int(options.get("partitions", "4"))
        self.columns = [f.name for f in schema]

    def partitions(self):
        with connect_readonly(self.path) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        names = ", ".join(f'"{c}"' for c in self.columns)
        with connect_readonly(self.path) as db:
            yield from db.execute(f'select {names} from "{self.table}" where rowid >= ? and rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_ro").option("path", …).option("dbtable", …).schema(…)``; split by row id."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self):
        with connect_readonly(self.options["path"]) as db:
            rows = db.execute(f'pragma table_info("{self.options["dbtable"]}")').fetchall()
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "BLOB": "binary"}
        return ", ".join(f"`{r[1]}` {kinds.get((r[2] or 'TEXT').upper(), 'string')}" for r in rows)

    def reader(self, schema):
        return SqliteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | None = None) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_ro").option("path", path).option("dbtable", table)
    return (reader.schema(schema) if schema else reader).load()
