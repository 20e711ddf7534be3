"""Sharding by jump consistent hashing (operator 5).

A stable key is mapped to one of ``shards`` buckets without a ring table; going from n to n + 1
shards moves 1 / (n + 1) of the rows, all of them into the new shard. The law kept is ``key``:
the document id and the shard count alone decide.

Slots are gapless from 0 inside each shard. They come from a two-level rank: rows are hashed to
blocks, ranked within (shard, block), and shifted by the running count of the earlier blocks, so
that no task ever holds a whole shard.

Defined cases: a null id hashes as its own key value; a null text has size 1 and the checksum of
the empty string; repeated rows get slots of their own; an empty table gives an empty result; other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)
NULL_KEY = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys that spreads runs of neighbouring ids."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bucket of each unsigned 64-bit key among ``shards``."""
    key = keys.astype(np.uint64).copy()
    bucket = np.zeros(len(key), np.int64)
    step = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = step[live]
            key[live] = key[live] * MULTIPLIER + np.uint64(1)
            step[live] = ((bucket[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[step[live] < shards]
    return bucket


def _keys(ids: pd.Series) -> np.ndarray:
    null = ids.isna().to_numpy()
    keys = mixed(ids.fillna(0).astype("int64").to_numpy().view(np.uint64))
    keys[null] = NULL_KEY
    return keys


def shard_column(column, shards: int):
    """Spark column: the shard of an id column."""

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(jump(_keys(ids), shards).astype(np.int32))

    return of(column)


def shard(docs: DataFrame, shards: int = 8, block_bits: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Assign every row a shard, a gapless slot there, and the shard it would have with one more.

    Slots follow the block (the highest ``block_bits`` of the mixed id and checksum), the id, the checksum and the size.
    """

    @F.pandas_udf("shard int, grown_shard int, block int")
    def place(ids: pd.Series, crcs: pd.Series) -> pd.DataFrame:
        keys = _keys(ids)
        block = mixed(ids.fillna(0).astype("int64").to_numpy().view(np.uint64) ^ crcs.to_numpy().astype(np.uint64)) >> np.uint64(64 - block_bits)
        return pd.DataFrame({"shard": jump(keys, shards).astype(np.int32), "grown_shard": jump(keys, shards + 1).astype(np.int32), "block": block.astype(np.int32)})

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = stored(rows.select("*", place("doc_id", "text_crc32").alias("p")).select("doc_id", "size", "text_crc32", "p.*"), "shards")
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    if shards << block_bits <= 1 << 17:  # the bound of its rows
        starts = F.broadcast(starts)
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.select("*", rank.alias("rank"))
    return ranked.join(starts, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), "grown_shard")
