"""Canonical text of values, content hashes and key text, all in built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "|"


def _plain_number(text: Column) -> Column:
    """Decimal text without the zeros and the point that end it."""
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def text_of(name: str | Column, kind: T.DataType) -> Column:
    """The text a value is hashed as; null stays null."""
    x = F.col(name) if isinstance(name, str) else name
    if isinstance(kind, T.StringType):
        return x
    if isinstance(kind, T.BooleanType):
        return x.cast("int").cast("string")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(x))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # Shortest round-trip digits, written without an exponent where a decimal can hold them; a decimal has no minus zero.
        # Seventeen digits that begin at the fourth decimal end at the 20th, where Java already writes an exponent.
        short = x.cast("string")
        exact, longer = short.try_cast("decimal(38,18)"), short.try_cast("decimal(38,21)")
        whole = exact.isNotNull() & (exact.cast("double") == x.cast("double"))
        text = F.when(short == "-0.0", "-0").when(whole & ~F.isnan(x), _plain_number(exact.cast("string")))
        return text.when(F.endswith(short, F.lit("E-4")), _plain_number(longer.cast("string"))).otherwise(short)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(x)
    return x.cast("string")


def content_hash(schema: T.StructType, columns: Iterable[str], null_token: str = "", framed: bool = False) -> Column:
    """SHA-256, in lower-case hex, of each value's text followed by a separator.

    By default null and the empty text hash alike and a separator inside a value is not escaped, so
    hashes agree with other tools of this family; ``null_token`` and ``framed`` (values preceded by
    their length) take those ambiguities away.
    """
    parts = []
    for name in columns:
        text = F.coalesce(text_of(name, schema[name].dataType), F.lit(null_token))
        if framed:
            parts += [F.octet_length(text).cast("string"), F.lit(":")]
        parts += [text, F.lit(SEPARATOR)]
    return F.sha2(F.concat(*parts) if parts else F.lit(""), 256)


def key_text(schema: T.StructType, pk: Iterable[str]) -> Column:
    """A key as text: its parts joined by the separator, in the order of the table; null if a part is."""
    pk = set(pk)
    parts: list[Column] = []
    for f in schema:
        if f.name in pk:
            parts += [F.lit(SEPARATOR)] if parts else []
            parts.append(text_of(f.name, f.dataType))
    return F.concat(*parts)


def uuidv7_ms(text: Column) -> Column:
    """Milliseconds of a version 7 UUID, null for anything else."""
    plain = F.replace(text, F.lit("-"), F.lit(""))
    valid = plain.rlike("^[0-9a-fA-F]{12}7[0-9a-fA-F]{19}$")
    return F.when(valid, F.conv(F.substring(plain, 1, 12), 16, 10).cast("long"))


def with_meta(df: DataFrame, pk: list[str], ts_col: str | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """``(key columns, pk, ts, content_hash)``: all that a comparison moves of a row."""
    columns = content_columns_of(df, ts_col, exclude)
    ts = F.col(ts_col) if ts_col and ts_col in df.columns else F.lit(None).cast("string")
    return df.select(*[F.col(k) for k in pk], key_text(df.schema, pk).alias("pk"), ts.alias("ts"), content_hash(df.schema, columns).alias("content_hash"))


def content_columns_of(df: DataFrame, ts_col: str | None, exclude: Iterable[str]) -> list[str]:
    from .globs import content_columns

    return content_columns(df.columns, ts_col, exclude)
