"""Packing into fixed windows by minimum bin slack (operator 7).

A document's ids are cut at multiples of the capacity. Full pieces are windows of their own; the
remainders are packed. The histogram of their lengths has fewer entries than the capacity, however
many documents there are, so it is summed in Spark and planned on the driver: the longest remaining
length opens a window, and a bitset subset-sum over the multiset of the lengths left picks the
filling closest to the capacity, whose counts are read back from the sets reached on the way. A
filling is used as often as the counts allow before the next one is sought, which bounds the number
of searches by the number of lengths too.

Pieces find their places without a shuffle by length: rows are hashed to blocks, ranked within
(length, block), shifted by the count of the earlier blocks, and the rank within the length decides
window and offset from the plan. A length that a third of all rows share is spread over all blocks.

Defined cases: a null or empty text is the end id alone; a document whose length is a multiple of
the capacity has no remainder; repeated rows are packed each for itself; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_of, sliced, stored, texts

#: Blocks at least, and pieces in one on average at most.
CAPACITY, END_ID, BLOCKS, BLOCK_ROWS = 2048, 1, 256, 1_000_000
VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_ENCODERS: dict = {}


def encoder(path: str | None = None):
    """The vocabulary of ``path`` as ranks: text to ids. Strings of added tokens in a text are those tokens, as the file's library reads them."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        added = held.get("added_tokens", [])
        if any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added tokens of {path} take in what is around them")
        special = {x["content"]: x["id"] for x in added}
        of = byte_alphabet()
        ranks = {bytes(of[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Full windows and the remainder of each document: where they start, their lengths and checksums."""

    def run(batches):
        own = encoder(path)
        for batch in sliced(batches):
            out = [[] for _ in range(5)]
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.array([*own.encode(text.decode("utf-8", "replace"), allowed_special="all"), end_id], "<u4")
                raw = ids.tobytes()
                for start in range(0, len(ids), capacity):
                    length = min(capacity, len(ids) - start)
                    for column, value in zip(out, (doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(ids)), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The part of the multiset ``counts`` whose sum is closest to ``room`` from below."""
    reach, mask, trail = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length) if length <= room else 0, 1
        while left > 0:
            k = min(take, left)
            trail.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, take = left - k, take * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(trail):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(times, filling)`` pairs that use up the histogram."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if v - (k == longest) > 0}
        used = fill(rest, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, used))
    return out


def places(chosen: list[tuple[int, dict[int, int]]], first: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the rank at which each filling starts to take pieces, their number in it, its first window and their offset."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    for times, used in chosen:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.setdefault(length, []).append((taken.get(length, 0), n, first, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        first += times
    return {k: tuple(np.array(v, np.int64).T) for k, v in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, blocks: int = BLOCKS, path: str | None = None) -> DataFrame:
    """A row per piece with its window (``sequence_id``) and its offset there."""
    rows = stored(pieces(docs, capacity, end_id, path), "pieces")
    blocks = max(blocks, -(-rows.count() // BLOCK_ROWS))
    rows = rows.withColumn("block", block_of(blocks, "doc_id", "start", "ids_crc32"))
    by_block = rows.groupBy("length", "block").count()
    histogram = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    full = histogram.pop(capacity, 0)
    where = places(plan(histogram, capacity), full)
    ahead = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_block.select("length", "block", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("shift"))
    rank = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = rows.select("*", rank.alias("rank")).join(starts, ["length", "block"]).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("rank") + F.col("shift")).cast("long").alias("rank"))

    def run(batches):
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                if n < capacity:
                    at = np.flatnonzero(length == n)
                    begin, many, window, shift = where[int(n)]
                    k = np.searchsorted(begin, rank[at], side="right") - 1
                    inside = rank[at] - begin[k]
                    sequence[at] = window[k] + inside // many[k]
                    offset[at] = shift[k] + inside % many[k] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
