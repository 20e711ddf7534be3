"""Metadata kept between runs, brought up to date from a timestamp cursor."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canon import content_columns_of, with_meta
from tidemark.operators import diff as D
from tidemark.operators.merge import latest
from tidemark.plans.config import ConcurrentWrite
from tidemark.sources.files import Files


def since(rows: DataFrame, ts_col: str, cursor, strict: bool = False) -> DataFrame:
    """Rows written after the cursor, or, unless ``strict``, at it: equal timestamps are not missed. Pushed to the scan."""
    if cursor is None:
        return rows
    return rows.filter(F.col(ts_col) > cursor) if strict else rows.filter(F.col(ts_col) >= cursor)


def cursor_of(meta: DataFrame) -> DataFrame:
    return meta.agg(F.max("ts").alias("cursor"))


def merge(cached: DataFrame, fresh: DataFrame, pk: list[str]) -> DataFrame:
    """Cached metadata overwritten by key."""
    return cached.join(fresh.select(*pk), pk, "left_anti").unionByName(fresh)


def merge_latest(parts: DataFrame, pk: list[str], ts_col: str, *tie: str) -> DataFrame:
    return latest(parts, pk, ts_col, *tie)


class MetadataCache:
    """Per table: a metadata frame in a folder, and the cursor up to which it is complete."""

    def __init__(self, spark: SparkSession, root: str, strict: bool = False):
        self.spark, self.root, self.strict, self.files = spark, root.rstrip("/"), strict, Files(spark)

    def _state(self, table: str) -> tuple[int, dict | None]:
        names = [n for n in self.files.names(f"{self.root}/{table}/_states") if n.endswith(".json")]
        return (-1, None) if not names else (int(names[-1][:-5]), json.loads(self.files.read(f"{self.root}/{table}/_states/{names[-1]}")))

    def load(self, table: str) -> DataFrame | None:
        _, state = self._state(table)
        return self.spark.read.parquet(f"{self.root}/{table}/{state['path']}") if state else None

    def cursor(self, table: str):
        return (self._state(table)[1] or {}).get("cursor")

    def refresh(self, table: str, rows: DataFrame, pk: list[str], ts_col: str | None, exclude: list[str] | tuple = ()) -> DataFrame:
        """The table's metadata now: from the cursor on where there is one and the same columns are hashed, else from a full scan.

        Null or repeated keys among the rows that are read raise. Rows that were deleted, and changed ones whose timestamp is null or
        did not grow, are seen after ``clear`` only.
        """
        _, state = self._state(table)
        hashed = [*pk, *content_columns_of(rows, ts_col, exclude)]
        can = state is not None and ts_col in rows.columns and state["cursor"] is not None and state.get("columns") == hashed
        part = since(rows, ts_col, F.lit(state["cursor"]).cast(rows.schema[ts_col].dataType), self.strict) if can else rows
        D.require_keys(part, pk)
        fresh = with_meta(part, pk, ts_col, exclude)
        return self.store(table, merge(self.load(table), fresh, pk) if can else fresh, columns=hashed)

    def absorb(self, table: str, changed: DataFrame, pk: list[str]) -> DataFrame:
        """Take in the metadata of rows that this side was sent; the cursor stays, so what others wrote meanwhile is still found."""
        _, state = self._state(table)
        return self.store(table, merge(self.load(table), changed, pk), columns=state.get("columns"), cursor=state["cursor"])

    def store(self, table: str, meta: DataFrame, columns: list[str] | None = None, cursor: str | None = None) -> DataFrame:
        """Make ``meta`` the cached frame, as after a push that changed the other side; of two writers one gets ``ConcurrentWrite``.

        Of the versions before it the last one stays, which plans may still read.
        """
        n, _ = self._state(table)
        path = f"v{n + 1}-{uuid.uuid4().hex}"
        meta.write.parquet(f"{self.root}/{table}/{path}")
        held = self.spark.read.parquet(f"{self.root}/{table}/{path}")
        top = cursor_of(held).first()["cursor"] if cursor is None else cursor
        if not self.files.create(f"{self.root}/{table}/_states/{n + 1:010d}.json", json.dumps({"cursor": None if top is None else str(top), "path": path, "columns": columns})):
            self.files.delete(f"{self.root}/{table}/{path}")
            raise ConcurrentWrite(f"the metadata of table {table!r} was refreshed by somebody else")
        for name in self.files.names(f"{self.root}/{table}"):
            if name.startswith("v") and int(name[1:].split("-")[0]) < n:
                self.files.delete(f"{self.root}/{table}/{name}")
        return held

    def clear(self, table: str | None = None) -> None:
        self.files.delete(f"{self.root}/{table}" if table else self.root)


def diff_cached(cache_a: MetadataCache, cache_b: MetadataCache, table: str, a: DataFrame, b: DataFrame, pk: list[str], ts_col: str | None, exclude: list[str] | tuple = ()) -> DataFrame:
    """A comparison that reads, of each side, what is new since the last one."""
    return D.classify(cache_a.refresh(table, a, pk, ts_col, exclude), cache_b.refresh(table, b, pk, ts_col, exclude), pk)
