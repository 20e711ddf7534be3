"""Batches for SQL sinks: size estimates, count and byte limits, statements."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.canon import text_of

#: Fixed values of the wire limits.
BIND_LIMIT, STATEMENT_OVERHEAD, COLUMN_OVERHEAD = 100, 200, 5


def max_rows_per_batch(bind_limit: int, columns: int) -> int | None:
    """Rows whose parameters fit the limit, one at least; None where there is no limit."""
    return max(1, bind_limit // max(1, columns)) if bind_limit else None


def rows_by_count(batch_size: int, columns: int) -> int:
    return min(batch_size, max_rows_per_batch(BIND_LIMIT, columns))


def value_bytes(value) -> int:
    """Estimated bytes of one value in a statement."""
    if value is None:
        return 4
    if isinstance(value, bool):
        return 5
    if isinstance(value, (int, float)):
        return len(json.dumps(value))
    if isinstance(value, (list, dict)):
        return len(json.dumps(value, separators=(",", ":")).encode())
    n = len(value.encode()) if isinstance(value, str) else 2 * len(value)
    return n + n // 5 + 2


def row_bytes(row: dict, columns: list[str]) -> int:
    return sum(COLUMN_OVERHEAD + value_bytes(row[c]) for c in columns if c in row)


def row_bytes_column(schema: T.StructType, columns: list[str]) -> Column:
    """The same estimate as an expression."""
    total = F.lit(0)
    for c in columns:
        kind = schema[c].dataType
        n = F.octet_length(text_of(c, kind))
        if isinstance(kind, T.BooleanType):
            size = F.lit(5)
        elif isinstance(kind, (T.NumericType, T.ArrayType, T.StructType, T.MapType)):
            size = n
        else:
            size = n + F.floor(n / 5) + 2
        total = total + COLUMN_OVERHEAD + F.coalesce(size, F.lit(4))
    return total.cast("long")


def splitters(rows: DataFrame, order: list[str], spans: int) -> list:
    """Values of the whole order that part the rows into about equal ranges: a sample of 20 rows a range, the same whenever it is drawn."""
    drawn = rows.select(F.struct(*order).alias("x")).orderBy(F.xxhash64("x"), "x").limit(20 * spans)
    found = [r["x"] for r in drawn.orderBy("x").collect()]
    cut = [found[len(found) * k // spans] for k in range(1, spans)] if found else []
    return [x for k, x in enumerate(cut) if not k or x != cut[k - 1]]


def span_of(rows: DataFrame, order: list[str], spans: int) -> Column:
    """The number of a row's range, ascending with the order."""
    at = splitters(rows, order, spans)
    if not at:
        return F.lit(0)
    marks = F.array(*[F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, x, strict=True)]) for x in at])
    return F.size(F.filter(marks, lambda x: x <= F.struct(*order)))


def batch_numbers(rows: DataFrame, order: list[str], batch_size: int, columns: int, spans: int = 64) -> DataFrame:
    """Rows with their batch number by the count limit.

    The order is parted at fixed values, ties of its first columns too; each range is ranked by itself and shifted
    by what stands before it, so no task sees all rows.
    """
    per = rows_by_count(batch_size, columns)
    ranged = rows.withColumn("__span", span_of(rows, order, spans))
    ahead = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__span").count().select("__span", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__span").orderBy(*order)) - 1
    ranked = ranged.withColumn("__rank", rank).join(F.broadcast(starts), "__span")  # ``spans`` rows
    return ranked.withColumn("batch", F.floor((F.col("__start") + F.col("__rank")) / per)).drop("__span", "__rank", "__start")


def greedy(rows: list[dict], columns: list[str], batch_size: int, max_bytes: int) -> Iterator[tuple[list[dict], int]]:
    """Batches under both limits in the order of the rows; a row too large goes alone."""
    if not rows or not columns:
        return
    most, held, size = rows_by_count(batch_size, len(columns)), [], 0
    for row in rows:
        n = row_bytes(row, columns)
        if held and (len(held) >= most or size + n + STATEMENT_OVERHEAD > max_bytes):
            yield held, size
            held, size = [], 0
        held.append(row)
        size += n
    yield held, size


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def insert_statement(table: str, columns: list[str], rows: list[dict]) -> tuple[str, list]:
    """A multi-row insert-or-replace and its parameters; absent values are null."""
    marks = "(" + ", ".join("?" * len(columns)) + ")"
    sql = f"INSERT OR REPLACE INTO {quoted(table)} ({', '.join(map(quoted, columns))}) VALUES {', '.join([marks] * len(rows))}"
    return sql, [row.get(c) for row in rows for c in columns]


def backoff_schedule(initial_ms: Column, multiplier: float, cap_ms: int, attempt: Column) -> Column:
    return F.least(initial_ms * F.pow(F.lit(multiplier), attempt), F.lit(float(cap_ms))).cast("long")
