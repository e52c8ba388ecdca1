"""SQLite files as a source: consistent snapshots and a partitioned, read-only scan."""

from __future__ import annotations

import os
import sqlite3
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def snapshot(live: str, to: str, pages: int = 2048, limit_s: float = 180, progress: Callable[[int, int], None] | None = None) -> None:
    """Copy a database that others write to, page by page, as of one transaction; refuses to overwrite."""
    if os.path.exists(to):
        raise FileExistsError(to)
    began = time.monotonic()

    def step(status: int, left: int, total: int) -> None:
        if progress:
            progress(total - left, total)
        if time.monotonic() - began > limit_s:
            raise TimeoutError(f"no snapshot within {limit_s} s")

    source = sqlite3.connect(f"file:{live}?mode=ro", uri=True)
    target = sqlite3.connect(to)
    try:
        source.backup(target, pages=pages, progress=step)
    except BaseException:
        target.close()
        os.remove(to)
        raise
    finally:
        source.close()
        target.close()


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__(None)
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.names
        self.kinds = [f.dataType for f in schema.fields]
        self.path, self.table = options["path"], options["table"]
        self.parts = int(options.get("partitions", "8"))

    def _open(self) -> sqlite3.Connection:
        if os.path.exists(self.path + "-wal") and os.path.getsize(self.path + "-wal"):
            raise RuntimeError(f"{self.path} has unmerged writes; take a snapshot first")
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, -1)]
        width = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + width - 1, high)) for a in range(low, high + 1, width)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        cols = ", ".join(f'"{n}"' for n in self.names)
        schema = pa.schema([(n, to_arrow_type(k)) for n, k in zip(self.names, self.kinds)])
        db = self._open()
        try:
            rows = db.execute(f'select {cols} from "{self.table}" where rowid between ? and ?', (part.low, part.high))
            while got := rows.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got), schema)], schema=schema)
        finally:
            db.close()


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")`` with options ``path``, ``table`` and ``partitions``; the schema is declared."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self):
        raise ValueError("declare a schema: SQLite's types belong to values, not to columns")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, self.options)


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 8) -> DataFrame:
    """A table of a SQLite file that all executors can read, in ranges of its row ids.

    A column is read as its declared type; values of another type fail the read.
    """
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).option("path", path).option("table", table).option("partitions", partitions).load()
