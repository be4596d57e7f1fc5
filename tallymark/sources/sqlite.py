"""Read-only SQLite scans as a Python data source: one partition a database file."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructType

from ..shipping import python_ready


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def columns(db: sqlite3.Connection, table: str) -> set[str]:
    return {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}


class SqliteReader(DataSourceReader):
    """Rows of the first query whose tables and columns a database has; a database that can't be read has none."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.paths, self.queries = schema, json.loads(options["paths"]), json.loads(options["queries"])

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def _value(self, v, kind):
        if v is None:
            return None
        try:
            if isinstance(kind, BinaryType):
                return v if isinstance(v, bytes) else str(v).encode()
            if isinstance(v, bytes):
                return None
            if isinstance(kind, LongType):
                return int(v)
            if isinstance(kind, DoubleType):
                return float(v)
            if isinstance(kind, BooleanType):
                return bool(v)
            return str(v) if isinstance(kind, StringType) else v
        except (TypeError, ValueError):
            return None

    def read(self, partition: _File) -> Iterator[tuple]:
        db = None
        try:
            db = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
            cursor = None
            for q in self.queries:
                try:
                    cursor = db.execute(q)
                    break
                except sqlite3.OperationalError:
                    continue
            if cursor is None:
                return
            names = [d[0] for d in cursor.description]
            at = {n: i for i, n in enumerate(names)}
            for n, row in enumerate(cursor):
                out = []
                for f in self.schema.fields:
                    if f.name == "source_file":
                        out.append(partition.path)
                    elif f.name == "seq":
                        out.append(n)
                    else:
                        out.append(self._value(row[at[f.name]], f.dataType) if f.name in at else None)
                yield tuple(out)
        except sqlite3.Error:
            return
        finally:
            if db is not None:
                db.close()


class SqliteSource(DataSource):
    """spark.read.format("tallymark_sqlite"): options paths and queries (JSON lists), schema by the user."""

    @classmethod
    def name(cls) -> str:
        return "tallymark_sqlite"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, paths: list[str], queries: list[str], ddl: str) -> DataFrame:
    """(source_file, seq, and the columns of ddl) of a query over each database.

    Several queries are tried in turn, for databases of other schema versions. The files must be reachable by
    every executor; they are opened read-only.
    """
    python_ready(spark)
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("tallymark_sqlite").schema(f"source_file string, seq long, {ddl}")
    return reader.option("paths", json.dumps(paths)).option("queries", json.dumps(queries)).load()


def databases(root: str, glob: str) -> list[str]:
    """Databases under a folder, or the file itself, in order."""
    p = Path(root)
    return [str(p)] if p.is_file() else sorted(str(x) for x in p.rglob(glob))
