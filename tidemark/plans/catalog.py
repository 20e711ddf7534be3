"""Registered queries of the diff engine, each with its DuckDB counterpart.

Two sides of a table are made from one by the key modulo ten: 0 is on the remote side only, 1 on the
local side only; for 2, 3 and 4 the remote content differs with a later, an earlier and an equal
timestamp; 5 has no timestamp there and other content; 6 has another timestamp and equal content.
"""

from __future__ import annotations

import contextlib
import os
import sqlite3
from collections.abc import Callable
from datetime import datetime, timedelta
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import canon, globs
from tidemark.operators import batching, cache, merge, peer
from tidemark.operators import diff as D
from tidemark.operators import sync as S
from tidemark.plans.config import ConflictPolicy, SyncConfig
from tidemark.sources import relay as relay_ops
from tidemark.sources.files import work_dir
from tidemark.sources.relay import as_of
from tidemark.sources.sqlite import SqliteStore
from tidemark.sources.store import MemoryStore, ParquetStore, TableSpec
from tidemark.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- the two sides, in Spark and in SQL -----------------------------------------------------------------------------


class Sides:
    """How a table is split and changed; ``changed`` is (column, SQL value), kinds are for the SQL hash."""

    def __init__(self, table: str, pk: list[str], ts: str | None, changed: tuple[str, str], kinds: dict[str, str], columns: list[str]):
        self.table, self.pk, self.ts, self.changed, self.kinds, self.columns = table, pk, ts, changed, kinds, columns

    def spark(self, spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
        df = read(spark, sf, self.table)
        k = F.col(self.pk[0]) % 10
        remote = df.filter(k != 1).withColumn(self.changed[0], F.when(k.between(2, 5), F.expr(self.changed[1])).otherwise(F.col(self.changed[0])))
        if self.ts:
            t = F.col(self.ts)
            remote = remote.withColumn(self.ts, F.when(k.isin(2, 6), t + F.expr("INTERVAL 1 DAY")).when(k == 3, t - F.expr("INTERVAL 1 DAY")).when(k == 5, None).otherwise(t))
        return df.filter(k != 0), remote

    @property
    def ctes(self) -> str:
        k = f"({self.pk[0]} % 10)"
        cols = []
        for c in self.columns:
            if c == self.changed[0]:
                cols.append(f"CASE WHEN {k} BETWEEN 2 AND 5 THEN {self.changed[1]} ELSE {c} END AS {c}")
            elif c == self.ts:
                cols.append(f"CASE WHEN {k} IN (2, 6) THEN {c} + INTERVAL 1 DAY WHEN {k} = 3 THEN {c} - INTERVAL 1 DAY WHEN {k} = 5 THEN NULL ELSE {c} END AS {c}")
            else:
                cols.append(c)
        return f"l AS (SELECT * FROM {self.table} WHERE {k} <> 0), r AS (SELECT {', '.join(cols)} FROM {self.table} WHERE {k} <> 1)"

    def text(self, c: str) -> str:
        return {"int": f"CAST({c} AS VARCHAR)", "double": rf"regexp_replace(CAST({c} AS VARCHAR), '\.0$', '')", "string": c, "ts": f"CAST({c} AS VARCHAR)"}[self.kinds[c]]

    def hash(self, exclude: tuple[str, ...] = ()) -> str:
        parts = [f"coalesce({self.text(c)}, '') || '|'" for c in globs.content_columns(self.columns, self.ts, exclude)]
        return f"sha256({' || '.join(parts)})" if parts else "sha256('')"

    @property
    def key(self) -> str:
        return " || '|' || ".join(self.text(c) for c in self.columns if c in self.pk)

    def diff(self, exclude: tuple[str, ...] = (), ts: bool = True) -> str:
        """CTEs up to ``d``: key columns, pk, bucket."""
        when = self.ts if ts and self.ts else "NULL"
        meta = f"SELECT {', '.join(self.pk)}, {self.key} AS pk, {self.hash(exclude)} AS h, {when} AS ts FROM"
        on = " AND ".join(f"a.{k} = b.{k}" for k in self.pk)
        keys = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in self.pk)
        return (
            f"WITH {self.ctes}, a AS ({meta} l), b AS ({meta} r), d AS (SELECT {keys}, coalesce(a.pk, b.pk) AS pk, CASE WHEN b.h IS NULL THEN 'local_only' WHEN a.h IS NULL THEN 'remote_only'"
            f" WHEN a.h = b.h THEN 'identical' WHEN a.ts > b.ts THEN 'local_newer' WHEN b.ts > a.ts THEN 'remote_newer' ELSE 'content_differs' END AS bucket FROM a FULL OUTER JOIN b ON {on})"
        )

    def found(self, spark: SparkSession, sf: str, exclude: tuple[str, ...] = ()) -> DataFrame:
        l, r = self.spark(spark, sf)
        return D.diff_table(l, r, self.pk, self.ts, exclude)


ORDERS = Sides("orders", ["o_orderkey"], "o_orderdate", ("o_orderstatus", "'X'"), {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "ts", "o_orderpriority": "string"}, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
CUSTOMER = Sides("customer", ["c_custkey"], None, ("c_mktsegment", "'X'"), {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
EVENTS = Sides("events", ["event_id"], "ts", ("event_type", "'X'"), {"event_id": "int", "ts": "ts", "user_id": "int", "event_type": "string", "value": "double", "props": "string"}, ["event_id", "ts", "user_id", "event_type", "value", "props"])
TALKS = Sides("conversations", ["conv_id", "turn"], None, ("role", "'X'"), {"conv_id": "int", "turn": "int", "role": "string", "text": "string"}, ["conv_id", "turn", "role", "text"])
VECTORS = Sides("embeddings", ["vec_id"], None, ("embedding", "NULL"), {"vec_id": "int", "embedding": "string", "label": "int"}, ["vec_id", "embedding", "label"])
ALL = (ORDERS, CUSTOMER, EVENTS, TALKS)
COUNTS = ", ".join(f"CAST(count(*) FILTER (bucket = '{b}') AS BIGINT) AS {b}" for b in D.BUCKETS)


# -- metadata -------------------------------------------------------------------------------------------------------


@query(f"SELECT {ORDERS.key} AS pk, o_orderdate AS ts, {ORDERS.hash()} AS content_hash FROM orders")
def row_metadata(spark, sf):
    return canon.with_meta(read(spark, sf, "orders"), ["o_orderkey"], "o_orderdate").select("pk", "ts", "content_hash")


@query(f"SELECT c_custkey, {CUSTOMER.hash(('c_acct*', '*segment'))} AS content_hash FROM customer")
def content_hash_excluded(spark, sf):
    return canon.with_meta(read(spark, sf, "customer"), ["c_custkey"], None, ["c_acct*", "*segment"]).select("c_custkey", "content_hash")


@query(f"SELECT {TALKS.key} AS pk, {TALKS.hash()} AS content_hash FROM conversations")
def pk_text_composite(spark, sf):
    return canon.with_meta(read(spark, sf, "conversations"), ["conv_id", "turn"]).select("pk", "content_hash")


@query(f"SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr({CUSTOMER.hash()}, 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint FROM customer")
def table_fingerprint(spark, sf):
    return D.fingerprint(canon.with_meta(read(spark, sf, "customer"), ["c_custkey"]))


_UUID = "printf('%08x-%04x-7%03x-8000-000000000000', (1700000000000 + event_id) // 65536, (1700000000000 + event_id) % 65536, event_id % 4096)"


@query(f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(1700000000000 + event_id AS BIGINT) END AS ms FROM events")
def uuidv7_ms(spark, sf):
    t = F.lit(1700000000000) + F.col("event_id")
    text = F.format_string("%08x-%04x-%s%03x-8000-000000000000", F.expr("(1700000000000 + event_id) div 65536"), t % 65536, F.when(F.col("event_id") % 7 == 0, "4").otherwise("7"), F.col("event_id") % 4096)
    return read(spark, sf, "events").select("event_id", canon.uuidv7_ms(text).alias("ms"))


# -- comparison -----------------------------------------------------------------------------------------------------


@query(f"WITH {ORDERS.ctes} SELECT o_orderkey FROM l ANTI JOIN r USING (o_orderkey)")
def diff_local_only(spark, sf):
    return D.local_only(*ORDERS.spark(spark, sf), ["o_orderkey"])


@query(f"WITH {ORDERS.ctes} SELECT o_orderkey FROM r ANTI JOIN l USING (o_orderkey)")
def diff_remote_only(spark, sf):
    return D.remote_only(*ORDERS.spark(spark, sf), ["o_orderkey"])


@query(f"WITH {ORDERS.ctes} SELECT o_orderkey FROM l JOIN r USING (o_orderkey)")
def diff_common(spark, sf):
    return D.common(*ORDERS.spark(spark, sf), ["o_orderkey"])


for _side in ALL:

    def _buckets(spark, sf, s=_side):
        return s.found(spark, sf).select("pk", "bucket")

    def _stats(spark, sf, s=_side):
        return D.stats(s.found(spark, sf))

    query(f"{_side.diff()} SELECT pk, bucket FROM d", f"diff_buckets_{_side.table}")(_buckets)
    query(f"{_side.diff()} SELECT {COUNTS} FROM d", f"diff_stats_{_side.table}")(_stats)


@query(" UNION ALL ".join(f"(SELECT * FROM ({s.diff()} SELECT '{s.table}' AS \"table\", {COUNTS} FROM d))" for s in ALL))
def diff_stats_all_tables(spark, sf):
    return D.stats(D.diff_all({s.table: (*s.spark(spark, sf), s.pk, s.ts) for s in ALL}), "table")


@query(f"{ORDERS.diff()} SELECT count(*) FILTER (bucket <> 'identical') > 0 AS has_changes FROM d")
def diff_has_changes(spark, sf):
    return D.has_changes(ORDERS.found(spark, sf))


_SUMMARY = "concat_ws(', ', " + ", ".join(f"CASE WHEN {b} > 0 THEN '{x}' || {b} || '{y}' END" for b, x, y in (("local_only", "+", " local only"), ("remote_only", "+", " remote only"), ("local_newer", "", " local newer"), ("remote_newer", "", " remote newer"), ("content_differs", "", " conflicts"), ("identical", "", " identical"))) + ")"


@query(f"{EVENTS.diff()}, s AS (SELECT {COUNTS} FROM d) SELECT CASE WHEN {_SUMMARY} = '' THEN 'no data' ELSE {_SUMMARY} END AS summary FROM s")
def diff_summary(spark, sf):
    return D.summary(EVENTS.found(spark, sf))


@query(f"{ORDERS.diff()}, n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY pk) AS n FROM d WHERE bucket <> 'identical') SELECT bucket, string_agg(pk, ',' ORDER BY pk) AS pks FROM n WHERE n <= 5 GROUP BY bucket")
def diff_detail_preview5(spark, sf):
    return D.detail(ORDERS.found(spark, sf), 5).select("bucket", F.array_join("pks", ",").alias("pks"))


@query(f"{ORDERS.diff(ts=False)} SELECT pk, bucket FROM d")
def diff_null_timestamp(spark, sf):
    l, r = (x.withColumn("none", F.lit(None).cast("timestamp_ntz")).withColumnRenamed("o_orderdate", "created_at") for x in ORDERS.spark(spark, sf))
    return D.diff_table(l, r, ["o_orderkey"], "none").select("pk", "bucket")


@query(f"{VECTORS.diff(('embed*',))} SELECT pk, bucket FROM d")
def diff_exclude_glob(spark, sf):
    return VECTORS.found(spark, sf, ("embed*",)).select("pk", "bucket")


_ALIKE = "'identical', 'local_only', 'remote_only'"
for _policy in ConflictPolicy:
    for _way, _set, _of in (("push", D.rows_to_push, D.push_buckets), ("pull", D.rows_to_pull, D.pull_buckets)):

        def _rows(spark, sf, p=_policy, f=_set):
            return f(ORDERS.found(spark, sf), p).select("pk", "bucket")

        _list = ", ".join(f"'{b}'" for b in _of(_policy))
        query(f"{ORDERS.diff()} SELECT pk, bucket FROM d WHERE bucket IN ({_list})", f"{_way}_set_{_policy.value}")(_rows)


@query(f"{ORDERS.diff()} SELECT pk FROM d WHERE false")
def delete_set(spark, sf):
    return D.rows_to_delete(ORDERS.found(spark, sf)).select("pk")


# -- moving rows ----------------------------------------------------------------------------------------------------

_COLS = ", ".join(ORDERS.columns)


@query(f"{ORDERS.diff()} SELECT {', '.join('r.' + c for c in ORDERS.columns)} FROM r JOIN d USING (o_orderkey) WHERE bucket IN ('remote_only', 'remote_newer')")
def fetch_rows(spark, sf):
    l, r = ORDERS.spark(spark, sf)
    return merge.fetch(r, D.rows_to_pull(ORDERS.found(spark, sf), ConflictPolicy.NEWER_WINS), ["o_orderkey"])


@query("SELECT vec_id, label FROM embeddings")
def strip_columns(spark, sf):
    return merge.strip(read(spark, sf, "embeddings"), ["*edd*"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def rows_dup_pk(spark, sf):
    return D.bad_keys(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _stores(spark, sf, s=ORDERS) -> tuple[MemoryStore, MemoryStore]:
    l, r = s.spark(spark, sf)
    spec = {s.table: TableSpec(s.table, s.pk, s.ts)}
    return MemoryStore({s.table: l}, spec), MemoryStore({s.table: r}, spec)


def _after(spark, sf, policy: ConflictPolicy, direction: str, side: int) -> DataFrame:
    l, r = ORDERS.spark(spark, sf)
    config = SyncConfig(conflict_resolution=policy, timestamp_column="o_orderdate")
    found = ORDERS.found(spark, sf)
    if side:
        return S.moved(l, r, D.rows_to_push(found, policy), ORDERS.pk, config) if direction != "pull" else r
    return S.moved(r, l, D.rows_to_pull(found, policy), ORDERS.pk, config) if direction != "push" else l


def _merged(source: str, target: str, buckets: list[str]) -> str:
    some = ", ".join(f"'{b}'" for b in buckets)
    return f"{ORDERS.diff()}, k AS (SELECT o_orderkey FROM d WHERE bucket IN ({some})) SELECT {_COLS} FROM {target} ANTI JOIN k USING (o_orderkey) UNION ALL SELECT {_COLS} FROM {source} SEMI JOIN k USING (o_orderkey)"


for _policy in ConflictPolicy:

    def _pushed(spark, sf, p=_policy):
        return _after(spark, sf, p, "sync", 1)

    def _pulled(spark, sf, p=_policy):
        return _after(spark, sf, p, "sync", 0)

    query(_merged("l", "r", D.push_buckets(_policy)), f"push_result_{_policy.value}")(_pushed)
    query(_merged("r", "l", D.pull_buckets(_policy)), f"pull_result_{_policy.value}")(_pulled)


_N = "(SELECT count(*) FROM d WHERE bucket IN ({}))"


@query(f"{ORDERS.diff()} SELECT CAST(0 AS BIGINT) AS local_only, CAST(0 AS BIGINT) AS remote_only, CAST(0 AS BIGINT) AS local_newer, CAST(0 AS BIGINT) AS remote_newer, count(*) FILTER (bucket = 'content_differs') AS content_differs, count(*) FILTER (bucket <> 'content_differs') AS identical FROM d")
def sync_convergence(spark, sf):
    """What still differs after a sync under newer_wins: the rows that differ with no newer side, on both sides."""
    a, b = (_after(spark, sf, ConflictPolicy.NEWER_WINS, "sync", i) for i in (0, 1))
    return D.stats(D.diff_table(a, b, ORDERS.pk, ORDERS.ts))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def upsert_replace(spark, sf):
    df = read(spark, sf, "customer")
    return merge.upsert(df, df.filter("c_custkey % 10 = 0").withColumn("c_name", F.lit("renamed")).drop("c_acctbal"), ["c_custkey"], "replace")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def upsert_preserve(spark, sf):
    df = read(spark, sf, "customer")
    return merge.upsert(df, df.filter("c_custkey % 10 = 0").withColumn("c_name", F.lit("renamed")).drop("c_acctbal"), ["c_custkey"], "preserve")


@query("SELECT * FROM customer WHERE c_custkey % 3 <> 0")
def delete_keys(spark, sf):
    df = read(spark, sf, "customer")
    return merge.delete(df, df.filter("c_custkey % 3 = 0"), ["c_custkey"])


@query("SELECT * FROM customer WHERE false")
def erase(spark, sf):
    return merge.erase(read(spark, sf, "customer"))


# -- reports --------------------------------------------------------------------------------------------------------


@query(f"{ORDERS.diff()} SELECT 'orders' AS \"table\", {COUNTS}, {_N.format(chr(39) + (chr(39) + ', ' + chr(39)).join(D.push_buckets(ConflictPolicy.LOCAL_WINS)) + chr(39))} AS rows_to_push, {_N.format(chr(39) + (chr(39) + ', ' + chr(39)).join(D.pull_buckets(ConflictPolicy.LOCAL_WINS)) + chr(39))} AS rows_to_pull FROM d")
def dry_run_report(spark, sf):
    a, b = _stores(spark, sf)
    report = S.dry_run_output("sync", S.sync_all(a, b, SyncConfig(timestamp_column="o_orderdate"), dry_run=True))
    rows = [{("table" if k == "name" else k): v for k, v in t.items()} for t in report["tables"]]
    return spark.createDataFrame(rows, "`table` string, " + ", ".join(f"{b} long" for b in D.BUCKETS) + ", rows_to_push long, rows_to_pull long")


@query(f"{CUSTOMER.diff()} SELECT 'customer' AS name, count(*) FILTER (bucket IN ('local_only', 'content_differs')) AS rows_pushed, count(*) FILTER (bucket = 'remote_only') AS rows_pulled FROM d")
def command_output(spark, sf):
    a, b = _stores(spark, sf, CUSTOMER)
    return spark.createDataFrame(S.command_output("sync", S.sync_all(a, b, SyncConfig()))["tables"], "name string, rows_pushed long, rows_pulled long")


@query("SELECT 'local' AS side, 'customer' AS \"table\", count(*) AS n_rows FROM customer UNION ALL SELECT 'local', 'orders', count(*) FROM orders UNION ALL SELECT 'remote', 'nation', count(*) FROM nation")
def status_counts(spark, sf):
    local = MemoryStore({n: read(spark, sf, n) for n in ("orders", "customer")}, {})
    return S.status({"local": local, "remote": MemoryStore({"nation": read(spark, sf, "nation")}, {})})


@query("SELECT * FROM (VALUES ('customer'), ('orders')) t(\"table\")")
def syncable_tables(spark, sf):
    names = ("orders", "customer", "nation", "region", "sqlite_sequence")
    specs = {n: TableSpec(n, ["key"]) for n in ("orders", "customer", "region", "sqlite_sequence")}
    a = MemoryStore(dict.fromkeys(names), specs)
    b = MemoryStore(dict.fromkeys((*names[:3], "events")), specs)
    return spark.createDataFrame([(n,) for n in S.tables_to_sync(a, b, SyncConfig())], "`table` string")


@query(f"{ORDERS.diff()} SELECT 'orders' AS \"table\", pk, CASE WHEN bucket = 'remote_only' THEN 'insert' ELSE 'update' END AS op, 'pull' AS source FROM d WHERE bucket IN ('remote_only', 'remote_newer', 'content_differs')")
def table_changed_feed(spark, sf):
    return S.change_feed(ORDERS.found(spark, sf), "orders", ConflictPolicy.REMOTE_WINS, "pull")


# -- relay and snapshots --------------------------------------------------------------------------------------------


@query(_merged("l", "r", D.push_buckets(ConflictPolicy.NEWER_WINS)))
def stash_result(spark, sf):
    """The relay, which holds the right side, after a stash from the local one."""
    local, remote = ORDERS.spark(spark, sf)
    relay = _stored(spark, remote)
    relay_ops.stash(spark, _held(local), relay.root, SyncConfig(conflict_resolution=ConflictPolicy.NEWER_WINS))
    return relay.table("orders")


def _stored(spark, df: DataFrame) -> ParquetStore:
    """A store in a new folder that holds ``df`` as the orders."""
    store = ParquetStore(spark, work_dir(spark), create=True)
    store.add(TableSpec("orders", ORDERS.pk, ORDERS.ts), df)
    return store


def _held(df: DataFrame) -> MemoryStore:
    return MemoryStore({"orders": df}, {"orders": TableSpec("orders", ORDERS.pk, ORDERS.ts)})


@query(f"{ORDERS.diff()}, k AS (SELECT o_orderkey FROM d WHERE bucket IN ('remote_only', 'remote_newer')) SELECT {_COLS} FROM l ANTI JOIN k USING (o_orderkey) UNION ALL SELECT {_COLS} FROM r SEMI JOIN k USING (o_orderkey)")
def retrieve_result(spark, sf):
    """The local side after a retrieve with remote_wins: the relay plays the local part, so rows that differ stay."""
    local, remote = ORDERS.spark(spark, sf)
    store = _held(local)
    relay_ops.retrieve(spark, store, _stored(spark, remote).root, SyncConfig(conflict_resolution=ConflictPolicy.REMOTE_WINS))
    return store.table("orders")


@query(f"WITH {ORDERS.ctes} SELECT {_COLS} FROM r")
def snapshot_restored(spark, sf):
    """A store after a snapshot, a push that changed it, and the restore of the snapshot."""
    local, remote = ORDERS.spark(spark, sf)
    store = _stored(spark, remote)
    relay_ops.snapshot(store, "2024-01-01T00:00:00.000Z")
    S.push_table(_held(local), store, "orders", SyncConfig(conflict_resolution=ConflictPolicy.LOCAL_WINS))
    relay_ops.snapshot(store, "2024-01-03T00:00:00.000Z")
    relay_ops.restore(store, "2024-01-02T00:00:00.000Z")
    return store.table("orders")


@query(f"WITH {ORDERS.ctes} SELECT '2024-01-03T00:00:00.000Z' AS timestamp, 'orders' AS name, (SELECT count(*) FROM l) + (SELECT count(*) FROM r WHERE o_orderkey % 10 = 0) AS row_count UNION ALL SELECT '2024-01-01T00:00:00.000Z', 'orders', count(*) FROM r")
def snapshots_listed(spark, sf):
    """Snapshots before and after a push, with their counts."""
    local, remote = ORDERS.spark(spark, sf)
    store = _stored(spark, remote)
    relay_ops.snapshot(store, "2024-01-01T00:00:00.000Z")
    S.push_table(_held(local), store, "orders", SyncConfig())
    relay_ops.snapshot(store, "2024-01-03T00:00:00.000Z")
    listed = [(m["timestamp"], t["name"], t["row_count"]) for m in relay_ops.list_snapshots(store) for t in m["tables"]]
    return spark.createDataFrame(listed, "timestamp string, name string, row_count long")


@query(_merged("l", "r", D.push_buckets(ConflictPolicy.LOCAL_WINS)))
def store_pushed(spark, sf):
    """A store of files after a push, which writes the files of changed keys."""
    local, remote = ORDERS.spark(spark, sf)
    store = _stored(spark, remote)
    S.push_table(_held(local), store, "orders", SyncConfig(conflict_resolution=ConflictPolicy.LOCAL_WINS))
    return store.table("orders")


@query(f"WITH {CUSTOMER.ctes} SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM l UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM r WHERE c_custkey % 10 = 0")
def sqlite_pushed(spark, sf):
    """A SQLite file that holds the right side of customer after a push under local_wins."""
    local, remote = CUSTOMER.spark(spark, sf)
    path = os.path.join(urlparse(work_dir(spark)).path, "customer.db")
    os.makedirs(os.path.dirname(path))
    with contextlib.closing(sqlite3.connect(path)) as con, con:
        con.execute("CREATE TABLE customer (c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_nationkey INTEGER, c_acctbal REAL, c_mktsegment TEXT)")
    store = SqliteStore(spark, path)
    columns = store.table("customer").columns
    store.replace("customer", remote.select(*columns))
    local = MemoryStore({"customer": _typed_like(local.select(*columns), store.table("customer"))}, {"customer": TableSpec("customer", CUSTOMER.pk)})
    S.push_table(local, store, "customer", SyncConfig(conflict_resolution=ConflictPolicy.LOCAL_WINS))
    return _typed_like(store.table("customer"), remote)


def _typed_like(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast(like.schema[c].dataType).alias(c) for c in rows.columns])


_DAYS = "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS timestamp, count(*) AS n_rows, CAST(sum(octet_length(encode(props))) AS BIGINT) AS size_bytes FROM events GROUP BY 1"


def _snapshots(spark, sf) -> DataFrame:
    return read(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("timestamp")).agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("props")).alias("size_bytes"))


@query(_DAYS)
def snapshot_manifest(spark, sf):
    return _snapshots(spark, sf)


@query(f"WITH s AS ({_DAYS}), m AS (SELECT max(timestamp) AS top FROM s), t AS (SELECT * FROM s WHERE timestamp < (SELECT top FROM m)) SELECT * FROM t ORDER BY timestamp DESC LIMIT 1")
def snapshot_asof(spark, sf):
    s = _snapshots(spark, sf)
    top = s.agg(F.date_format(F.date_sub(F.max("timestamp").cast("date"), 1), "yyyy-MM-dd")).first()[0]
    return as_of(s, top).select("timestamp", "n_rows", "size_bytes")


# -- incremental ----------------------------------------------------------------------------------------------------

_MID = "(SELECT make_timestamp(CAST((epoch_us(min(ts)) + epoch_us(max(ts))) // 2000000 * 1000000 AS BIGINT)) FROM events)"


def _mid(df: DataFrame):
    """The whole second half-way between the first and the last event."""
    zero = datetime(1970, 1, 1)
    a, b = df.agg(F.min("ts"), F.max("ts")).first()
    return F.lit(zero + timedelta(seconds=((a - zero) + (b - zero)) // timedelta(seconds=2))).cast("timestamp_ntz")


@query(f"SELECT {EVENTS.key} AS pk, ts, {EVENTS.hash()} AS content_hash FROM events WHERE ts >= CAST({_MID} AS TIMESTAMP)")
def incremental_meta(spark, sf):
    df = read(spark, sf, "events")
    return canon.with_meta(cache.since(df, "ts", _mid(df)), ["event_id"], "ts").select("pk", "ts", "content_hash")


@query("WITH p AS (SELECT event_id, ts, event_type, 0 AS side FROM events UNION ALL SELECT event_id, ts + INTERVAL 1 HOUR, 'X', 1 FROM events WHERE event_id % 4 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, side DESC) AS n FROM p) SELECT event_id, ts, event_type FROM n WHERE n = 1")
def incremental_merge_latest(spark, sf):
    df = read(spark, sf, "events").select("event_id", "ts", "event_type", F.lit(0).alias("side"))
    late = df.filter("event_id % 4 = 0").select("event_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit("X").alias("event_type"), F.lit(1).alias("side"))
    return cache.merge_latest(df.unionByName(late), ["event_id"], "ts", "side").drop("side")


@query("SELECT max(ts) AS cursor FROM events")
def cursor_max_ts(spark, sf):
    return cache.cursor_of(read(spark, sf, "events"))


_REPLAY = """WITH m AS (SELECT event_type AS source, event_id % 200 AS seq, event_id AS arrival FROM events),
h AS (SELECT *, row_number() OVER (PARTITION BY source, seq ORDER BY arrival) AS n, max(seq) OVER (PARTITION BY source ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM m)
SELECT source, seq, arrival, n = 1 AND (hi IS NULL OR seq > hi OR hi - seq < 64) AS accepted FROM h"""


def _messages(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select(F.col("event_type").alias("source"), (F.col("event_id") % 200).alias("seq"), F.col("event_id").alias("arrival"))


@query(_REPLAY)
def replay_guard(spark, sf):
    return peer.replay_accepted(_messages(spark, sf), "source", "seq", "arrival")


@query(_REPLAY)
def replay_guard_fold(spark, sf):
    return stream.replay_fold(_messages(spark, sf), "source", "seq", "arrival")


# -- peers ----------------------------------------------------------------------------------------------------------


def _peer(spark, sf) -> DataFrame:
    l, r = (canon.with_meta(x, ORDERS.pk, ORDERS.ts) for x in ORDERS.spark(spark, sf))
    return peer.responder_diff(l, r, ORDERS.pk)


@query(f"{ORDERS.diff()} SELECT pk FROM d WHERE bucket NOT IN ('identical', 'local_only')")
def peer_missing(spark, sf):
    return _peer(spark, sf).filter("missing").select("pk")


@query(f"{ORDERS.diff()} SELECT pk FROM d WHERE bucket NOT IN ('identical', 'remote_only')")
def peer_wanted(spark, sf):
    return _peer(spark, sf).filter("wanted").select("pk")


@query(f"{ORDERS.diff()}, k AS (SELECT o_orderkey FROM d WHERE bucket NOT IN ('identical', 'local_only')) SELECT {_COLS} FROM l ANTI JOIN k USING (o_orderkey) UNION ALL SELECT {_COLS} FROM r SEMI JOIN k USING (o_orderkey)")
def peer_final_state(spark, sf):
    a, b = _stores(spark, sf)
    peer.exchange(a, b, "orders", SyncConfig(timestamp_column="o_orderdate"))
    return a.table("orders")


@query("SELECT o_custkey AS \"table\", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, o_orderkey FROM orders")
def message_sequence(spark, sf):
    return peer.sequence_numbers(read(spark, sf, "orders").select(F.col("o_custkey").alias("table"), "o_orderkey"), "table", ["o_orderkey"])


@query("SELECT c_nationkey AS \"table\", count(*) AS n_rows, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM customer GROUP BY 1")
def packets_reassembled(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("table"), F.col("c_custkey").alias("ord"), F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("name"), F.col("c_name")).alias("row"))
    whole = peer.reassemble(peer.packets(rows, "peer"))
    ids = F.transform("upserts", lambda m: m["id"].cast("long"))
    return whole.select(F.col("table").cast("int").alias("table"), F.size("upserts").cast("long").alias("n_rows"), F.array_min(ids).alias("first_key"), F.array_max(ids).alias("last_key"))


# -- batches and delays ---------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 20 AS batch FROM customer) SELECT batch, count(*) AS n_rows, min(c_custkey) AS first_key FROM n GROUP BY batch")
def batch_plan_count(spark, sf):
    df = batching.batch_numbers(read(spark, sf, "customer"), ["c_custkey"], 100, 5)
    return df.groupBy("batch").agg(F.count("*").alias("n_rows"), F.min("c_custkey").alias("first_key"))


@query(rf"SELECT c_custkey, CAST(5 + length(CAST(c_custkey AS VARCHAR)) + 5 + strlen(c_name) + strlen(c_name) // 5 + 2 + 5 + length(CAST(c_nationkey AS VARCHAR)) + 5 + length({CUSTOMER.text('c_acctbal')}) + 5 + strlen(c_mktsegment) + strlen(c_mktsegment) // 5 + 2 AS BIGINT) AS n_bytes FROM customer")
def estimate_row_bytes(spark, sf):
    df = read(spark, sf, "customer")
    return df.select("c_custkey", batching.row_bytes_column(df.schema, df.columns).alias("n_bytes"))


@query("SELECT n AS attempt, CAST(least(100 * pow(2, n), 30000) AS BIGINT) AS delay_ms FROM range(12) t(n)")
def backoff_schedule(spark, sf):
    return spark.range(12).select(F.col("id").alias("attempt"), batching.backoff_schedule(F.lit(100), 2.0, 30_000, F.col("id")).alias("delay_ms"))


@query("SELECT user_id AS key, max_by(event_type, (ts, event_id)) AS value, max(ts) AS updated_at FROM events GROUP BY user_id")
def kv_last_write(spark, sf):
    return merge.kv_latest(read(spark, sf, "events"), "user_id", "event_type", "ts", "event_id")
