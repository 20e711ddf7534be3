"""SQLite files through Spark's Python data source API, and a store over them.

A table is read in ranges of its row ids, one per partition, each by a connection of its own opened
read-only; it is written in one transaction per partition by insert-or-replace.
"""

from __future__ import annotations

import contextlib
import os
import sqlite3
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.functions.globs import user_tables
from tidemark.operators import merge as M
from tidemark.operators.batching import insert_statement, quoted
from tidemark.plans.config import ConfigError, NotFound

from .store import Store, TableSpec

KINDS = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))


def connect(path: str, read_only: bool = True) -> sqlite3.Connection:
    """Open an existing file; never make one."""
    if not os.path.exists(path):
        raise NotFound(f"no SQLite file at {path}")
    return sqlite3.connect(f"file:{path}?mode={'ro' if read_only else 'rw'}", uri=True)


def table_info(con: sqlite3.Connection, table: str) -> tuple[T.StructType, list[str]]:
    """Schema by declared type, and the key in the order of the columns."""
    rows = con.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not rows:
        raise NotFound(f"no table {table!r}")
    schema = T.StructType()
    for _, name, kind, *_ in rows:
        declared = (kind or "").upper()
        schema.add(name, next((t for mark, t in KINDS if mark in declared), T.StringType()), True)
    return schema, [r[1] for r in rows if r[5]]


def list_tables(con: sqlite3.Connection) -> list[str]:
    return user_tables(r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'"))


def to_kind(value, kind: T.DataType):
    """A stored value as the column's type; what does not fit is an error, not a guess."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else value.decode() if isinstance(value, bytes) else str(value)
    if isinstance(kind, T.BinaryType):
        return value.encode() if isinstance(value, str) else value
    if isinstance(kind, T.DoubleType):
        return float(value)
    return int(value)


def to_sqlite(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float, str, bytes, type(None))):
        return value
    if isinstance(value, bytearray):
        return bytes(value)
    if isinstance(value, Decimal):
        return str(value)
    return value.isoformat(" ") if hasattr(value, "isoformat") else str(value)


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.name, self.schema = options["path"], options["table"], schema
        self.parts = int(options.get("partitions", 4))

    def partitions(self):
        with contextlib.closing(connect(self.path)) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.name)}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids
                return [Range(None, None)]
        if low is None:
            return [Range(None, None)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, part):
        names = ", ".join(quoted(f.name) for f in self.schema)
        where, args = (" WHERE rowid >= ? AND rowid < ?", (part.low, part.high)) if part.low is not None else ("", ())
        with contextlib.closing(connect(self.path)) as con:
            for row in con.execute(f"SELECT {names} FROM {quoted(self.name)}{where}", args):
                yield tuple(to_kind(v, f.dataType) for v, f in zip(row, self.schema, strict=True))


class SqliteWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.name, self.columns = options["path"], options["table"], schema.names
        self.shadow = None
        if overwrite:
            # Rows gather beside the table, which is emptied and filled in one transaction at the end.
            self.shadow = f"_cf_tidemark_{uuid.uuid4().hex}"
            with contextlib.closing(connect(self.path, False)) as con, con:
                con.execute(f"CREATE TABLE {quoted(self.shadow)} ({', '.join(map(quoted, self.columns))})")

    def commit(self, messages):
        if self.shadow:
            names = ", ".join(map(quoted, self.columns))
            with contextlib.closing(connect(self.path, False)) as con:
                con.execute("PRAGMA busy_timeout = 60000")
                try:
                    with con:
                        con.execute(f"DELETE FROM {quoted(self.name)}")
                        con.execute(f"INSERT INTO {quoted(self.name)} ({names}) SELECT {names} FROM {quoted(self.shadow)}")
                finally:
                    with con:
                        con.execute(f"DROP TABLE {quoted(self.shadow)}")

    def abort(self, messages):
        if self.shadow:
            with contextlib.closing(connect(self.path, False)) as con, con:
                con.execute(f"DROP TABLE IF EXISTS {quoted(self.shadow)}")

    def write(self, rows):
        sql, _ = insert_statement(self.shadow or self.name, self.columns, [{}])
        with contextlib.closing(connect(self.path, False)) as con, con:
            con.execute("PRAGMA busy_timeout = 60000")
            con.executemany(sql, ([to_sqlite(v) for v in row] for row in rows))
        return WriterCommitMessage()


class SqliteSource(DataSource):
    """``spark.read.format("tidemark_sqlite").option("path", ...).option("table", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_sqlite"

    def schema(self) -> T.StructType:
        with contextlib.closing(connect(self.options["path"])) as con:
            return table_info(con, self.options["table"])[0]

    def reader(self, schema):
        return SqliteReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return SqliteWriter(dict(self.options), schema, overwrite)


class SqliteStore(Store):
    """The tables of one file, reached from all executors by its path."""

    def __init__(self, spark: SparkSession, path: str, ts_col: str | None = None, read_only: bool = False):
        connect(path).close()
        spark.dataSource.register(SqliteSource)
        self.spark, self.path, self.ts_col, self.read_only = spark, path, ts_col, read_only

    def list_tables(self) -> list[str]:
        with contextlib.closing(connect(self.path)) as con:
            return list_tables(con)

    def spec(self, name: str) -> TableSpec:
        with contextlib.closing(connect(self.path)) as con:
            schema, pk = table_info(con, name)
        return TableSpec(name, pk, self.ts_col if self.ts_col in schema.names else None)

    def _io(self, io, name: str):
        return io.format("tidemark_sqlite").option("path", self.path).option("table", name)

    def table(self, name: str) -> DataFrame:
        self.spec(name)
        return self._io(self.spark.read, name).load()

    def row_count(self, name: str) -> int:
        self.spec(name)
        with contextlib.closing(connect(self.path)) as con:
            return con.execute(f"SELECT count(*) FROM {quoted(name)}").fetchone()[0]

    def upsert(self, name: str, rows: DataFrame) -> None:
        if self.read_only:
            raise ConfigError("the store is read-only")
        self._io(rows.coalesce(1).write, name).mode("append").save()  # one writer: the file has one lock

    def apply(self, name: str, rows: DataFrame, keys: DataFrame | None = None, mode: str = "preserve") -> None:
        """Insert or replace the rows in one transaction; they are computed before it begins."""
        held = M.completed(self.table(name), rows, self.spec(name).pk, mode).persist()
        try:
            held.count()
            self.upsert(name, held)
        finally:
            held.unpersist()

    def replace(self, name: str, rows: DataFrame) -> None:
        """Take over the rows in one transaction, or none of them; they are computed before the table that they may come from is emptied."""
        if self.read_only:
            raise ConfigError("the store is read-only")
        held = rows.persist()
        try:
            held.count()
            self._io(held.coalesce(1).write, name).mode("overwrite").save()
        finally:
            held.unpersist()
