"""A read-only data source over SQLite files: each row becomes (line, doc), doc being its JSON text.

    spark.dataSource.register(SqliteSource)
    spark.read.format("ravelin_sqlite").option("path", file).option("table", name).load()

``query`` instead of ``table`` runs an own SELECT. A table with a rowid is read in ranges of it, one to a task.
"""

from __future__ import annotations

import json
import math
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a range.
RANGE_ROWS = 200_000


def cell(v: object) -> object:
    """A column's value as JSON: text that is an object or array is parsed, numbers that aren't finite are null."""
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, str) and v[:1] in ("{", "["):
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v


class Range(InputPartition):
    def __init__(self, lo: int | None, hi: int | None, first: int):
        super().__init__((lo, hi))
        self.lo, self.hi, self.first = lo, hi, first


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.query = options["path"], options.get("table"), options.get("query")
        if (self.table is None) == (self.query is None):
            raise ValueError("give either table or query")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def _name(self) -> str:
        return '"' + self.table.replace('"', '""') + '"'

    def partitions(self) -> list[Range]:
        if self.query is None:
            try:
                with self._open() as db:
                    lo, hi, n = db.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {self._name()}").fetchone()
                    if n > RANGE_ROWS and hi - lo + 1 == n:  # dense, so line numbers follow from it
                        return [Range(a, a + RANGE_ROWS, a - lo + 1) for a in range(lo, hi + 1, RANGE_ROWS)]
            except sqlite3.Error:
                pass  # a view, or a table without rowid
        return [Range(None, None, 1)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with self._open() as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            sql, args = self.query or f"SELECT * FROM {self._name()}", ()
            if partition.lo is not None:
                sql, args = sql + " WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (partition.lo, partition.hi)
            rows = db.execute(sql, args)
            names = [d[0] for d in rows.description]
            for i, row in enumerate(rows):
                record = {n: cell(v) for n, v in zip(names, row, strict=True) if v is not None and not isinstance(v, bytes)}
                yield partition.first + i, json.dumps(record, ensure_ascii=False)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ravelin_sqlite"

    def schema(self) -> str:
        return "line bigint, doc string"

    def reader(self, schema: object) -> SqliteReader:
        return SqliteReader(self.options)
