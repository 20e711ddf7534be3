"""Moving rows: fetch by key, strip columns, upsert, delete, erase. All of them plans, nothing is collected."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.globs import excluded_columns


def fetch(rows: DataFrame, keys: DataFrame, pk: list[str]) -> DataFrame:
    """Whole rows of the wanted keys."""
    return rows.join(keys.select(*pk), pk, "left_semi").select(*rows.columns)


def strip(rows: DataFrame, exclude: Iterable[str]) -> DataFrame:
    """Rows without the excluded columns."""
    gone = excluded_columns(rows.columns, exclude)
    return rows.drop(*gone) if gone else rows


def upsert(target: DataFrame, incoming: DataFrame, pk: list[str], mode: str = "preserve", keys: DataFrame | None = None) -> DataFrame:
    """The target after insert-or-replace by key. ``keys``: those of the incoming rows, where they are at hand without computing the rows."""
    incoming = completed(target, incoming, pk, mode)
    gone = (incoming if keys is None else keys).select(*pk)
    return target.join(gone, pk, "left_anti").select(*target.columns).unionByName(incoming)


def completed(target: DataFrame, incoming: DataFrame, pk: list[str], mode: str = "preserve") -> DataFrame:
    """Incoming rows with the target's columns and types.

    Columns that do not come in keep the target's value with ``preserve`` and become null with
    ``replace``; columns that the target lacks are left out.
    """
    incoming = incoming.select(*[c for c in incoming.columns if c in target.columns])
    missing = [c for c in target.columns if c not in incoming.columns]
    if missing and mode == "preserve":
        held = target.select(*pk, *missing)
        incoming = incoming.join(held, pk, "left")
    else:
        incoming = incoming.select("*", *[F.lit(None).cast(target.schema[c].dataType).alias(c) for c in missing])
    return incoming.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])


def delete(target: DataFrame, keys: DataFrame, pk: list[str]) -> DataFrame:
    return target.join(keys.select(*pk), pk, "left_anti").select(*target.columns)


def erase(target: DataFrame) -> DataFrame:
    """No rows, the same schema."""
    return target.limit(0)


def latest(rows: DataFrame, pk: list[str], ts_col: str, *tie: str) -> DataFrame:
    """The last written row of each key."""
    order = [F.col(ts_col).desc_nulls_last(), *[F.col(t).desc() for t in tie]]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*pk).orderBy(*order))).filter("__n = 1").drop("__n")


def kv_latest(rows: DataFrame, key: str, value: str, ts: str, tie: str) -> DataFrame:
    """Last write per key, as an aggregate that combines before its shuffle."""
    at = F.struct(F.col(ts), F.col(tie))
    return rows.groupBy(F.col(key).alias("key")).agg(F.max_by(F.col(value), at).alias("value"), F.max(ts).alias("updated_at"))
