"""Stores: named tables with keys, read as DataFrames, replaced as wholes or changed by rows.

``ParquetStore`` never overwrites a file. A version of a table is a list of folders and files; changed rows rewrite only
the files that hold rows of their keys, into a new folder, and the other files are named again. It publishes by a commit log:
commit n + 1 is a small file that can be created once, so of two writers one gets ``ConcurrentWrite``,
and nothing that a plan still reads is ever overwritten. Snapshots are commits with a name.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass, field
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.globs import user_tables
from tidemark.operators import merge as M
from tidemark.plans.config import ConcurrentWrite, ConfigError, NotFound

from .files import Files


@dataclass
class TableSpec:
    """What a table is compared by; keys stand in the order of its columns."""

    name: str
    pk: list[str] = field(default_factory=list)
    ts_col: str | None = None


class Store(ABC):
    """The connector contract: everything else is built on these calls."""

    @abstractmethod
    def list_tables(self) -> list[str]: ...

    @abstractmethod
    def spec(self, name: str) -> TableSpec: ...

    @abstractmethod
    def table(self, name: str) -> DataFrame: ...

    @abstractmethod
    def replace(self, name: str, rows: DataFrame) -> None: ...

    def apply(self, name: str, rows: DataFrame, keys: DataFrame | None = None, mode: str = "preserve") -> None:
        """Insert or replace rows by key; ``keys`` are theirs, where they are at hand without computing the rows."""
        self.replace(name, M.upsert(self.table(name), rows, self.spec(name).pk, mode, keys))

    def has_column(self, name: str, column: str) -> bool:
        return column in self.table(name).columns

    def row_count(self, name: str) -> int:
        return self.table(name).count()


class MemoryStore(Store):
    """Tables held as plans; for tests and for joining up frames that exist already."""

    def __init__(self, tables: dict[str, DataFrame], specs: dict[str, TableSpec]):
        self._tables, self._specs = dict(tables), specs

    def list_tables(self) -> list[str]:
        return user_tables(self._tables)

    def spec(self, name: str) -> TableSpec:
        return self._specs.get(name) or TableSpec(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise NotFound(name)
        return self._tables[name]

    def replace(self, name: str, rows: DataFrame) -> None:
        self._tables[name] = rows


class ParquetStore(Store):
    SCHEMES = ("", "file", "hdfs", "s3", "s3a", "abfs", "abfss", "gs", "viewfs")

    def __init__(self, spark: SparkSession, root: str, create: bool = False, read_only: bool = False):
        if urlparse(root).scheme not in self.SCHEMES:
            raise ConfigError(f"no store at {root!r}: known schemes are {', '.join(x for x in self.SCHEMES if x)}")
        self.spark, self.files, self.read_only = spark, Files(spark), read_only
        self.root = root.rstrip("/")
        self._seen: dict[str, str] = {}  # the version of each table that plans were last made from
        if not self.files.names(f"{self.root}/_commits"):
            if not create:
                raise NotFound(f"no store at {root}")
            self.files.create(f"{self.root}/_commits/{0:010d}.json", json.dumps({"tables": {}}))

    # -- the commit log -----------------------------------------------------------------------------------------

    def version(self) -> int:
        return max(int(n.removesuffix(".json")) for n in self.files.names(f"{self.root}/_commits") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(self.files.read(f"{self.root}/_commits/{self.version() if version is None else version:010d}.json"))

    def publish(self, tables: dict, expected: int) -> int:
        """Make ``tables`` the next version if ``expected`` is still the present one."""
        if self.read_only:
            raise ConfigError("the store is read-only")
        if not self.files.create(f"{self.root}/_commits/{expected + 1:010d}.json", json.dumps({"tables": tables})):
            raise ConcurrentWrite(f"version {expected + 1} of {self.root} was published by somebody else")
        return expected + 1

    # -- tables -------------------------------------------------------------------------------------------------

    def list_tables(self) -> list[str]:
        return user_tables(self.manifest()["tables"])

    def _entry(self, name: str) -> dict:
        found = self.manifest()["tables"].get(name)
        if found is None:
            raise NotFound(f"no table {name!r} in {self.root}")
        return found

    def spec(self, name: str) -> TableSpec:
        e = self._entry(name)
        return TableSpec(name, e["pk"], e["ts_col"])

    def table(self, name: str) -> DataFrame:
        e = self._entry(name)
        self._seen[name] = e["paths"]
        return self._read(e, e["paths"])

    def _read(self, entry: dict, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(*(f"{self.root}/{p}" for p in paths))

    def rows(self, entry: dict) -> DataFrame:
        """The rows of a version."""
        return self._read(entry, entry["paths"])

    def files_of(self, entry: dict) -> list[str]:
        """The data files of a version, below the root."""
        out = []
        for p in entry["paths"]:
            out += [p] if p.endswith(".parquet") else [f"{p}/{n}" for n in self.files.names(f"{self.root}/{p}") if n.endswith(".parquet")]
        return out

    def write_version(self, spec: TableSpec, rows: DataFrame) -> dict:
        """Write rows to a new folder; they are seen once an entry of a manifest names it."""
        path = f"{spec.name}/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        return {"paths": [path], "schema": rows.schema.jsonValue(), **{k: v for k, v in asdict(spec).items() if k != "name"}}

    def replace(self, name: str, rows: DataFrame) -> None:
        """Publish rows as the table's next version.

        Fails if the table is not the one last read here, so no other writer's rows are lost; commits of
        other tables in between do no harm.
        """
        seen = self._seen.get(name, self._entry(name)["paths"])
        self._exchange(name, seen, self.write_version(self.spec(name), rows))

    def changed(self, name: str, entry: dict, rows: DataFrame, keys: DataFrame | None = None, mode: str = "preserve") -> dict:
        """A version of the table in ``entry`` with rows inserted or replaced; only files that hold their keys are written anew."""
        pk, files = entry["pk"], self.files_of(entry)
        old = self._read(entry, entry["paths"])
        wanted = (rows if keys is None else keys).select(*pk)
        held = old.select(*pk, F.col("_metadata.file_name").alias("__file")).join(wanted, pk, "left_semi")
        touched = {r[0] for r in held.select("__file").distinct().collect()}  # at most one row per file
        part = [f for f in files if f.rsplit("/", 1)[1] in touched]
        new = self.write_version(TableSpec(name, pk, entry["ts_col"]), M.upsert(self._read(entry, part) if part else old.limit(0), rows, pk, mode, keys))
        return new | {"paths": [f for f in files if f not in set(part)] + new["paths"]}

    def apply(self, name: str, rows: DataFrame, keys: DataFrame | None = None, mode: str = "preserve") -> None:
        entry = self._entry(name)
        seen = self._seen.get(name, entry["paths"])
        self._exchange(name, seen, self.changed(name, entry, rows, keys, mode))

    def compact(self, name: str) -> None:
        """Write a table of many small files anew, in ranges of its key."""
        rows, spec = self.table(name), self.spec(name)
        self.replace(name, rows.repartitionByRange(*spec.pk) if spec.pk else rows)

    def _exchange(self, name: str, seen: list[str], entry: dict) -> None:
        while True:
            expected = self.version()
            tables = self.manifest(expected)["tables"]
            if tables.get(name, {}).get("paths") != seen:
                raise ConcurrentWrite(f"table {name!r} of {self.root} was written by somebody else")
            with contextlib.suppress(ConcurrentWrite):
                self.publish(tables | {name: entry}, expected)
                self._seen[name] = entry["paths"]
                return

    def add(self, spec: TableSpec, rows: DataFrame) -> None:
        """A new table, its key in the order of its columns."""
        expected = self.version()
        tables = self.manifest(expected)["tables"]
        spec = TableSpec(spec.name, [c for c in rows.columns if c in spec.pk], spec.ts_col)
        tables[spec.name] = self.write_version(spec, rows)
        self.publish(tables, expected)

    def snapshots(self) -> list[dict]:
        """Named commits, newest first; files that are none are left out."""
        out = []
        for name in self.files.names(f"{self.root}/_snapshots"):
            try:
                one = json.loads(self.files.read(f"{self.root}/_snapshots/{name}"))
                one["meta"]["timestamp"], one["tables"].items()
                out.append(one)
            except (ValueError, KeyError, TypeError, AttributeError):
                continue
        return sorted(out, key=lambda x: x["meta"]["timestamp"], reverse=True)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders and files that none of the last ``keep`` commits and no snapshot names."""
        last = self.version()
        held = [self.manifest(v) for v in range(max(0, last - keep + 1), last + 1) if self.files.exists(f"{self.root}/_commits/{v:010d}.json")]
        held += self.snapshots()
        used = {p for m in held for e in m["tables"].values() for p in e["paths"]}
        folders = {p.rsplit("/", 1)[0] if p.endswith(".parquet") else p for p in used}
        gone = []
        for name in self.files.names(self.root):
            if not name.startswith("_"):
                for p in (f"{name}/{v}" for v in self.files.names(f"{self.root}/{name}")):
                    if p not in folders:
                        gone.append(p)
                    elif p not in used:
                        gone += [f for f in (f"{p}/{n}" for n in self.files.names(f"{self.root}/{p}") if n.endswith(".parquet")) if f not in used]
        for p in gone:
            self.files.delete(f"{self.root}/{p}")
        return gone
