"""Exchange between peers: what each lacks, packets, order and replay of messages."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canon import with_meta
from tidemark.operators import diff as D
from tidemark.operators import merge as M
from tidemark.operators.batching import span_of
from tidemark.operators.sync import SyncResult, shared
from tidemark.plans.config import ConfigError, SyncConfig, SyncError

#: Fixed values of the protocol.
VERSION, PACKET_BYTES, MOST_BYTES, WINDOW, MOST_SOURCES, MOST_ID_BYTES, TTL_TICKS = 1, 1400, 65_507, 64, 256, 128, 3


def db_hash(path):
    """Peers whose path hashes differ do not sync."""
    return F.sha2(path, 256)


def peers(announcements: DataFrame, now, ttl_seconds: int, own_id: str, version: int = VERSION) -> DataFrame:
    """Live peers: the last announcement of each other instance of this version within the time to live."""
    seen = announcements.filter((F.col("instance_id") != own_id) & (F.col("version") == version))
    last = seen.groupBy("instance_id").agg(F.max_by("addr", "last_seen").alias("addr"), F.max_by("db_hash", "last_seen").alias("db_hash"), F.max("last_seen").alias("last_seen"))
    return last.filter(F.col("last_seen").cast("timestamp") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def responder_diff(requester: DataFrame, responder: DataFrame, pk: list[str]) -> DataFrame:
    """``(key columns, pk, missing, wanted)`` by hash alone: what the requester lacks, what the responder wants."""
    a = requester.select(*[F.col(k).alias(f"__a{i}") for i, k in enumerate(pk)], F.col("pk").alias("a_pk"), F.col("content_hash").alias("a"))
    b = responder.select(*[F.col(k).alias(f"__b{i}") for i, k in enumerate(pk)], F.col("pk").alias("b_pk"), F.col("content_hash").alias("b"))
    both = a.join(b, [F.col(f"__a{i}") == F.col(f"__b{i}") for i in range(len(pk))], "full_outer")
    differ = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") != F.col("b"))
    keys = [F.coalesce(f"__a{i}", f"__b{i}").alias(k) for i, k in enumerate(pk)]
    return both.filter(differ).select(*keys, F.coalesce("a_pk", "b_pk").alias("pk"), F.col("b").isNotNull().alias("missing"), F.col("a").isNotNull().alias("wanted"))


def exchange(initiator, responder, name: str, config: SyncConfig, hashes: tuple[str, str] | None = None) -> SyncResult:
    """One table of two stores: the initiator takes what it lacks, then sends what the other wants.

    ``hashes``: the path hashes of both sides; peers of different databases are refused. Null or repeated keys raise.
    Timestamps and policies play no part. A row that both have with different content goes to the
    initiator first and from there back, so the responder's version holds on both sides.
    """
    if hashes and hashes[0] != hashes[1]:
        raise SyncError("the peer has another database")
    pk = initiator.spec(name).pk
    ts_col = initiator.spec(name).ts_col or config.timestamp_column
    mine, theirs = shared(initiator.table(name), responder.table(name), pk, name)
    D.require_keys(mine, pk)
    D.require_keys(theirs, pk)
    found = responder_diff(with_meta(mine, pk, ts_col, config.exclude_columns), with_meta(theirs, pk, ts_col, config.exclude_columns), pk).persist()
    try:
        n = found.agg(F.count_if("missing").alias("received"), F.count_if(F.col("wanted")).alias("sent")).first()
        if n["received"]:
            keys = found.filter("missing").select(*pk)
            initiator.apply(name, M.strip(M.fetch(theirs, keys, pk), config.exclude_columns), keys, config.merge_mode)
            mine = initiator.table(name).select(*mine.columns)
        if n["sent"]:
            keys = found.filter("wanted").select(*pk)
            responder.apply(name, M.strip(M.fetch(mine, keys, pk), config.exclude_columns), keys, config.merge_mode)
        return SyncResult(name, n["sent"], n["received"])
    finally:
        found.unpersist()


# -- packets --------------------------------------------------------------------------------------------------------


def packet(source: str, seq: int, table: str, upserts: list[dict], deletes: list[str], part: int = 0, total: int = 1) -> dict:
    return {"version": VERSION, "source_id": source, "seq": seq, "part": part, "total_parts": total, "table": table, "upserts": upserts, "deletes": deletes}


def packet_bytes(p: dict) -> int:
    return len(json.dumps(p, separators=(",", ":"), ensure_ascii=False, default=str).encode())


def split(source: str, seq: int, table: str, upserts: Iterable[dict], deletes: list[str], target: int = PACKET_BYTES) -> list[dict]:
    """Greedy packets of about ``target`` bytes, a row each at least; deletions go with the first."""
    upserts = list(upserts)
    whole = packet(source, seq, table, upserts, deletes)
    if not upserts or packet_bytes(whole) <= target:
        parts = [(upserts, deletes)]
    else:
        # Adding a row adds its bytes and a comma, so sizes are sums and nothing is encoded twice.
        base = packet_bytes(packet(source, seq, table, [], [], 0, 0))
        extra = packet_bytes(packet(source, seq, table, [], deletes, 0, 0)) - base
        parts, held, size = [], [], base + extra
        for row in upserts:
            n = len(json.dumps(row, separators=(",", ":"), ensure_ascii=False, default=str).encode()) + bool(held)
            n += len(str(len(parts))) - 1 if not held else 0
            if held and size + n > target:
                parts.append((held, deletes if not parts else []))
                held, size, n = [], base + len(str(len(parts))) - 1, n - 1
            held.append(row)
            size += n
        parts.append((held, deletes if not parts else []))
    out = [packet(source, seq, table, u, d, k, len(parts)) for k, (u, d) in enumerate(parts)]
    if large := [n for n in map(packet_bytes, out) if n > MOST_BYTES]:
        raise SyncError(f"a row of table {table!r} makes a packet of {large[0]} bytes")
    return out


PACKET_SCHEMA = "version int, source_id string, seq long, part int, total_parts int, table string, upserts array<map<string,string>>, deletes array<string>"


def packets(rows: DataFrame, source: str, seq: int = 0, table: str = "table") -> DataFrame:
    """Packets of each table's rows as a frame; ``rows`` has the table's name and a map ``row``, in the order of ``ord``.

    Splitting is greedy, so a table is cut in one task; tables are cut at the same time.
    """

    def cut(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ord")
        return pd.DataFrame(split(source, seq, pdf["table"].iloc[0], [dict(r) for r in pdf["row"]], []))

    return rows.select(F.col(table).alias("table"), "ord", "row").groupBy("table").applyInPandas(cut, PACKET_SCHEMA)


def reassemble(parts: DataFrame) -> DataFrame:
    """Deltas all of whose parts are there, in the order of the parts."""
    one = F.sort_array(F.collect_list(F.struct("part", "upserts_json", "deletes")))
    held = parts.withColumn("upserts_json", F.transform("upserts", lambda m: F.to_json(m))).groupBy("source_id", "table", "seq").agg(F.max("total_parts").alias("total_parts"), F.countDistinct("part").alias("n"), one.alias("parts"))
    rows = F.transform(F.flatten(F.col("parts.upserts_json")), lambda x: F.from_json(x, "map<string,string>"))
    return held.filter("n = total_parts").select("source_id", "table", "seq", rows.alias("upserts"), F.flatten(F.col("parts.deletes")).alias("deletes"))


def sequence_numbers(messages: DataFrame, table: str, order: list[str], spans: int = 64) -> DataFrame:
    """Messages numbered per table from 0.

    Ranges of table and order are ranked by themselves and shifted by what stands before them, so a table of most rows is many tasks.
    """
    ranged = messages.withColumn("__span", span_of(messages, [table, *order], spans))
    ahead = Window.partitionBy(table).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(table, "__span").count().select(F.col(table).alias("__table"), F.col("__span").alias("__at"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy(table, "__span").orderBy(*order)) - 1
    ranked = ranged.withColumn("__rank", rank).join(starts, F.col(table).eqNullSafe(F.col("__table")) & (F.col("__span") == F.col("__at")))
    return ranked.withColumn("seq", (F.col("__start") + F.col("__rank")).cast("long")).select(*[c for c in messages.columns if c != "seq"], "seq")


# -- replay ---------------------------------------------------------------------------------------------------------


class ReplayGuard:
    """Accepts each number of a source once, no more than a window behind the highest."""

    def __init__(self, highest: int | None = None, seen: int = 0):
        self.highest, self.seen = highest, seen

    def accept(self, seq: int) -> bool:
        if self.highest is None:
            self.highest, self.seen = seq, 0
            return True
        gap = seq - self.highest
        if gap > 0:
            self.seen = ((self.seen << gap) | 1 << (gap - 1)) & ((1 << WINDOW) - 1) if gap < WINDOW else 0
            self.highest = seq
            return True
        bit = -gap - 1
        if gap == 0 or -gap >= WINDOW or self.seen >> bit & 1:
            return False
        self.seen |= 1 << bit
        return True


class ReplayGuards:
    """Guards of a bounded number of sources; ids that are too long are refused."""

    def __init__(self, most: int = MOST_SOURCES):
        self.most, self.guards = most, OrderedDict()

    def accept(self, source: str, seq: int) -> bool:
        if len(source.encode()) > MOST_ID_BYTES:
            return False
        if source not in self.guards:
            if len(self.guards) >= self.most:
                return False
            self.guards[source] = ReplayGuard()
        return self.guards[source].accept(seq)

    def prune(self, live: set[str]) -> None:
        for source in [s for s in self.guards if s not in live]:
            del self.guards[source]


def replay_accepted(messages: DataFrame, source: str, seq: str, arrival: str, spans: int = 64) -> DataFrame:
    """The same over whole sources: first of its number, and within the window of the highest before it.

    The highest comes from within a range of source and arrival, and from the ranges before it, so a source of most messages is many tasks.
    """
    ranged = messages.withColumn("__span", span_of(messages, [source, arrival], spans))
    ahead = Window.partitionBy(source).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy(source, "__span").agg(F.max(seq).alias("__top")).select(F.col(source).alias("__source"), F.col("__span").alias("__at"), F.max("__top").over(ahead).alias("__before"))
    within = F.max(seq).over(Window.partitionBy(source, "__span").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(Window.partitionBy(source, seq).orderBy(arrival)) == 1
    held = ranged.withColumn("__within", within).withColumn("__first", first)
    high = F.greatest("__within", "__before")
    judged = held.join(tops, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__span") == F.col("__at")))
    return judged.withColumn("accepted", F.col("__first") & (high.isNull() | (F.col(seq) > high) | (high - F.col(seq) < WINDOW))).select(*messages.columns, "accepted")


def encryption_key(text: str | None) -> bytes | None:
    """32 bytes from 64 hex digits."""
    if text is None:
        return None
    try:
        key = bytes.fromhex(text)
    except ValueError:
        key = b""
    if len(key) != 32:
        raise ConfigError("a secret is 64 hex digits")
    return key
