"""Line deduplication over cuckoo filters backed by exact reference counts (operator 6).

State is a folder of posting segments ``(digest, doc_id, delta)``: inserting documents appends +1
postings, deleting them appends -1 postings for those that are held, so every step can be undone. The exact reference
table (documents holding a key, and the largest of them) counts the pairs of key and document whose sum is positive. Keys
held often enough are also members of cuckoo filters, one per shard of the digest space; a lookup
asks its shard's filter first, and only what the filter lets through meets the exact table, which
alone decides. Filters take insertions and deletions, so a shard is updated in place.

The first reference table is made of all postings. Later steps count again only the keys that their own postings touch:
their earlier postings are picked out of the segments by a semi join, the table's other rows stay, and of the filters only
the shards are written anew whose members change. ``compact`` replaces the segments by their sums.

Scale: postings are aggregated before they are shuffled; lookups are dealt to (shard, salt) groups,
so the holders of one very common line land in many tasks; the number of shards follows the number
of keys and the cluster's parallelism, that of salts the number of postings, which bounds a filter and a group. Nothing is gathered on the driver but counts.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` code points
are never dropped; documents are told apart by ``doc_id`` (repeated rows of an id count once, and
each row loses the lines that its id loses); rows with a null id neither count nor lose lines; documents that were never
inserted can be deleted without effect, and one that was inserted twice must be deleted twice; an
empty table gives an empty result; other columns are ignored by ``digest_report``, carried by ``drop_lines``.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, fresh, map_texts, map_whole, own_columns, stored, texts, with_texts, work_dir

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Keys in a shard on average, the least number of salts that spread the holders of one key, and lookups in a (shard, salt) group on average.
SHARD_KEYS, SALTS, LOOKUPS = 20_000, 16, 250_000
DIGEST = 16


def key_of(line: bytes) -> bytes:
    """A line without white space at its ends, its ASCII letters in lower case."""
    return line.strip(SPACE).lower()


def long_enough(key: bytes, min_chars: int = MIN_CHARS) -> bool:
    return len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=DIGEST).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; two places per item; insert, delete and lookup.

    What finds no place after ``KICKS`` moves goes to an exact overflow list, so there is no false
    negative at any load.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 0, raw: bytes | None = None):
        if raw is not None:
            n, spare = np.frombuffer(raw[:16], "<i8")
            self.table = np.frombuffer(raw[16 : 16 + n * self.SLOTS * 2], "<u2").reshape(n, self.SLOTS).copy()
            rest = raw[16 + n * self.SLOTS * 2 :]
            self.overflow = [rest[i : i + DIGEST] for i in range(0, spare * DIGEST, DIGEST)]
        else:
            n = 1 << max(1, math.ceil(math.log2(max(capacity, 1) / (self.SLOTS * 0.8))))
            self.table, self.overflow = np.zeros((n, self.SLOTS), "<u2"), []
        self.mask = len(self.table) - 1

    def tobytes(self) -> bytes:
        return np.array([len(self.table), len(self.overflow)], "<i8").tobytes() + self.table.tobytes() + b"".join(self.overflow)

    def _places(self, item: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(item[8:10], "little") or 1
        one = int.from_bytes(item[:8], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def insert(self, item: bytes) -> None:
        mark, one, two = self._places(item)
        for place in (one, two):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        trail, place = [], one
        for k in range(self.KICKS):
            slot = k % self.SLOTS
            trail.append((place, slot, int(self.table[place, slot])))
            self.table[place, slot], mark = mark, trail[-1][2]
            place = self._other(place, mark)
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        for place, slot, was in reversed(trail):
            self.table[place, slot] = was
        self.overflow.append(item)

    def delete(self, item: bytes) -> bool:
        if item in self.overflow:
            self.overflow.remove(item)
            return True
        mark, one, two = self._places(item)
        for place in (one, two):
            held = np.flatnonzero(self.table[place] == mark)
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False

    def __contains__(self, item: bytes) -> bool:
        mark, one, two = self._places(item)
        return mark in self.table[one] or mark in self.table[two] or item in self.overflow

    def contains_many(self, items: np.ndarray) -> np.ndarray:
        """``items``: digests as an (n, DIGEST) array of bytes."""
        one = items[:, :8].copy().view("<u8").ravel() & np.uint64(self.mask)
        mark = items[:, 8:10].copy().view("<u2").ravel()
        mark = np.where(mark == 0, 1, mark).astype("<u2")
        two = (one ^ (mark.astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(self.mask)
        found = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        if self.overflow:
            found |= np.isin(np.array([x.tobytes() for x in items], f"S{DIGEST}"), np.array(self.overflow, f"S{DIGEST}"))
        return found


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(digest, doc_id)``: the distinct keys of each row that has an id."""

    def each(batch):
        ids, out = [], []
        for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            if i is not None:
                keys = {k for k in map(key_of, text.split(b"\n")) if long_enough(k, min_chars)}
                out += map(digest, keys)
                ids += [i] * len(keys)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.int64())], names=["digest", "doc_id"])

    return map_texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text"], each, "digest binary, doc_id long")


class LineIndex:
    """An incremental index of lines under a shared folder."""

    def __init__(self, spark, path: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.path = path or f"{work_dir(spark)}/lines-{uuid.uuid4().hex}"
        self.filters: DataFrame | None = None
        self.shards = 0
        self._refs: DataFrame | None = None
        self._paths: list[str] = []
        self._fresh: list[str] = []  # segments that the reference table does not count yet

    def _append(self, rows: DataFrame, delta: int) -> None:
        path = f"{self.path}/segments/{uuid.uuid4().hex}"
        rows.withColumn("delta", F.lit(delta).cast("int")).write.option("compression", "zstd").parquet(path)
        self._paths.append(path)
        self._fresh.append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        schema = "digest binary, doc_id long, delta int"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def insert(self, docs: DataFrame) -> None:
        self._append(postings(docs, self.min_chars), 1)

    def delete(self, docs: DataFrame) -> None:
        """Take whole documents, as they were inserted, out of the counts; what is not held is passed over."""
        gone = stored(postings(docs, self.min_chars).distinct(), "gone")
        held = self.segments().join(gone, ["digest", "doc_id"], "left_semi").groupBy("digest", "doc_id").agg(F.sum("delta").alias("n")).filter("n > 0")
        self._append(held.select("digest", "doc_id"), -1)

    def segments(self) -> DataFrame:
        return self._read(self._paths)

    def compact(self) -> None:
        """Replace the segments by one that holds the sum of each pair."""
        self.references()
        path = f"{self.path}/segments/{uuid.uuid4().hex}"
        net = self.segments().groupBy("digest", "doc_id").agg(F.sum("delta").cast("int").alias("delta")).filter("delta > 0")
        net.write.option("compression", "zstd").parquet(path)
        self._paths = [path]

    def _counted(self, some: DataFrame) -> DataFrame:
        """References of the keys of these postings."""
        held = some.groupBy("digest", "doc_id").agg(F.sum("delta").alias("n")).filter("n > 0")
        return held.groupBy("digest").agg(F.count("*").alias("holders"), F.max("doc_id").alias("last")).filter(F.col("holders") >= self.min_docs)

    def references(self) -> DataFrame:
        """Exact table of the keys held by ``min_docs`` documents or more: digest, holders, largest id."""
        if self._refs is None:
            # Digests with enough postings first: the distinct count then sees few keys.
            often = self.segments().groupBy("digest").agg(F.count_if(F.col("delta") > 0).alias("n")).filter(F.col("n") >= self.min_docs).select("digest")
            often = stored(often, "often")
            self._refs = stored(self._counted(self.segments().join(often, "digest", "left_semi")), "refs")
            self._build_filters()
        elif self._fresh:
            touched = stored(self._read(self._fresh).select("digest").distinct(), "touched")
            before = self._refs
            now = stored(self._counted(self.segments().join(touched, "digest", "left_semi")), "recounted")
            was = before.join(touched, "digest", "left_semi").select("digest")
            changes = was.join(now, "digest", "left_anti").withColumn("added", F.lit(False)).unionByName(now.select("digest").join(was, "digest", "left_anti").withColumn("added", F.lit(True)))
            changes = stored(changes, "changes")
            self._refs = stored(before.join(touched, "digest", "left_anti").unionByName(now), "refs")
            self._update_filters(changes)
        self._fresh = []
        return self._refs

    def _shard(self, column="digest"):
        return F.pmod(F.xxhash64(column), F.lit(self.shards)).cast("int")

    def _build_filters(self) -> None:
        n = self._refs.count()
        self.shards = max(4 * self.spark.sparkContext.defaultParallelism, -(-n // SHARD_KEYS))

        def build(keys: pa.Table) -> pa.Table:
            made = CuckooFilter(keys.num_rows)
            for item in keys.column("digest").to_pylist():
                made.insert(item)
            return pa.table({"shard": keys.column("shard")[:1], "filter": pa.array([made.tobytes()], pa.binary())})

        made = self._refs.select("digest", self._shard().alias("shard")).groupBy("shard").applyInArrow(build, "shard int, filter binary")
        self.filters = stored(made, "filters")

    def _update_filters(self, changes: DataFrame) -> None:
        """Take the changed keys into the filters of their shards, or out of them; build anew where the shards have become too few."""
        if self._refs.count() > 4 * self.shards * SHARD_KEYS:
            self._build_filters()
            return

        def update(keys: pa.Table, had: pa.Table) -> pa.Table:
            kept = CuckooFilter(raw=had.column("filter")[0].as_py()) if had.num_rows else CuckooFilter(keys.num_rows)
            for item, added in sorted(zip(keys.column("digest").to_pylist(), keys.column("added").to_pylist(), strict=True), key=lambda x: x[1]):
                (kept.insert if added else kept.delete)(item)
            return pa.table({"shard": keys.column("shard")[:1], "filter": pa.array([kept.tobytes()], pa.binary())})

        keys = changes.select("digest", "added", self._shard().alias("shard"))
        shards = keys.select("shard").distinct()
        made = keys.groupBy("shard").cogroup(self.filters.join(shards, "shard", "left_semi").groupBy("shard")).applyInArrow(update, "shard int, filter binary")
        self.filters = stored(self.filters.join(shards, "shard", "left_anti").unionByName(made), "filters")

    def dropped(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, drops)``: digests of the lines each document loses."""
        refs = self.references()

        def look(asked: pa.Table, had: pa.Table) -> pa.Table:
            if not asked.num_rows or not had.num_rows:
                return asked.slice(0, 0)
            held = CuckooFilter(raw=had.column("filter")[0].as_py())
            items = np.frombuffer(b"".join(asked.column("digest").to_pylist()), np.uint8).reshape(-1, DIGEST)
            return asked.filter(pa.array(held.contains_many(items)))

        asked = postings(docs, self.min_chars)
        many = max(SALTS, -(-self.segments().count() // (self.shards * LOOKUPS)))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(many)).cast("int")
        salts = F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
        asked = asked.select("digest", "doc_id", self._shard().alias("shard"), salt.alias("salt"))
        had = self.filters.select("shard", "filter", salts.alias("salt"))
        passed = asked.groupBy("shard", "salt").cogroup(had.groupBy("shard", "salt")).applyInArrow(look, asked.schema)
        exact = refs.select("digest", "last", salts.alias("salt"))
        lost = passed.join(exact, ["digest", "salt"]).filter("doc_id <> last")
        return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("drops"))


def _without(text: bytes, drops: list[bytes] | None, min_chars: int) -> tuple[list[bytes], int]:
    """The lines that stay, and how many lines there were."""
    lines = text.split(b"\n")
    if not drops:
        return lines, len(lines)
    gone = set(drops)
    return [x for x in lines if not (long_enough(k := key_of(x), min_chars) and digest(k) in gone)], len(lines)


def digest_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: its lines, how many go, and the hash of what stays."""
    index = LineIndex(docs.sparkSession, None, min_chars, min_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index.insert(rows)
    both = rows.join(index.dropped(rows).hint("merge"), "doc_id", "left")

    def each(batch):
        n, gone, sha = [], [], []
        for text, drops in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            left, all_lines = _without(text, drops, min_chars)
            n.append(all_lines)
            gone.append(all_lines - len(left))
            sha.append(hashlib.sha256(b"\n".join(left)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return map_texts(both, ["doc_id", "text", "drops"], each, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, with all their columns, without the lines that they lose."""
    index = LineIndex(docs.sparkSession, None, min_chars, min_docs)
    index.insert(docs)
    key, drops = fresh(docs, "__id"), fresh(docs, "__drops")
    lost = index.dropped(docs).select(F.col("doc_id").alias(key), F.col("drops").alias(drops))
    both = docs.join(lost.hint("merge"), F.col("doc_id").cast("long") == F.col(key), "left").select(*own_columns(docs), drops)

    at, n = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            lost = batch.column(n).to_pylist()
            out = [t if not d else b"\n".join(_without(t, d, min_chars)[0]) for t, d in zip(texts(batch.column(at)), lost, strict=True)]
            yield with_texts(batch, at, [x.decode("utf-8", "replace") for x in out], n)

    return counted(map_whole(both, docs.columns, run), docs)
