"""A relay store between sides that never meet, and snapshots of it."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import diff as D
from tidemark.operators import merge as M
from tidemark.operators.sync import SyncResult, shared, sync_table, tables_to_sync, validated
from tidemark.plans.config import NotFound, SyncConfig

from .store import ParquetStore, Store


def _settings(config: SyncConfig) -> SyncConfig:
    """The relay carries whole rows of all tables: neither column nor table filters hold."""
    return SyncConfig(timestamp_column=config.timestamp_column, conflict_resolution=config.conflict_resolution, exclude_tables=config.exclude_tables, merge_mode=config.merge_mode)


def stash(spark: SparkSession, local: Store, root: str, config: SyncConfig, table: str | None = None, dry_run: bool = False) -> list[SyncResult]:
    """Push the local rows to the relay; the first time, make it. One commit takes all tables or none."""
    relay = ParquetStore(spark, root, create=not dry_run)
    config, expected = _settings(config), relay.version()
    names = [validated(table, local.list_tables())] if table else [n for n in local.list_tables() if config.should_sync_table(n) and local.spec(n).pk]
    tables, out, changed = relay.manifest(expected)["tables"], [], False
    for name in names:
        spec, rows = local.spec(name), local.table(name)
        if name not in tables:
            n = rows.count()
            out.append(SyncResult(name, n))
            if not dry_run:
                tables[name], changed = relay.write_version(spec, rows), True
            continue
        # Columns that the relay lacks are added to it, null in the rows that it has.
        entry = tables[name]
        known = {f["name"] for f in entry["schema"]["fields"]}
        if more := [f.jsonValue() for f in rows.schema if f.name not in known]:
            entry = tables[name] = entry | {"schema": entry["schema"] | {"fields": entry["schema"]["fields"] + [f | {"nullable": True} for f in more]}}
            changed = not dry_run
        D.require_keys(rows, spec.pk)
        held = relay.rows(entry)
        D.require_keys(held, spec.pk)
        left, right = shared(rows, held, spec.pk, name)
        found = D.diff_table(left, right, spec.pk, spec.ts_col or config.timestamp_column, config.exclude_columns).persist()
        try:
            counts = D.stats(found).first().asDict()
            n = sum(counts[b] for b in D.push_buckets(config.conflict_resolution))
            out.append(SyncResult(name, n, 0, counts if dry_run else None))
            if n and not dry_run:
                keys = D.rows_to_push(found, config.conflict_resolution)
                tables[name] = relay.changed(name, tables[name], M.fetch(rows, keys, spec.pk), keys, config.merge_mode)
                changed = True
        finally:
            found.unpersist()
    if changed:
        relay.publish(tables, expected)
    return out


def retrieve(spark: SparkSession, local: Store, root: str, config: SyncConfig, table: str | None = None, dry_run: bool = False) -> list[SyncResult]:
    """Push the relay's rows to the local side.

    The relay plays the local part, so policies read from its side: with ``remote_wins`` rows that
    differ stay as they are here. Rows that came in are reported as pulled.
    """
    relay = ParquetStore(spark, root, read_only=True)
    config = _settings(config)
    names = [validated(table, relay.list_tables())] if table else tables_to_sync(relay, local, config)
    out = [sync_table(relay, local, n, config, "push", dry_run=dry_run) for n in names]
    return [SyncResult(r.table, 0, r.pushed, r.stats, r.detail) for r in out]


# -- snapshots ------------------------------------------------------------------------------------------------------


def stamp(now: datetime | None = None) -> str:
    """UTC time to the millisecond as sortable text."""
    now = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    return now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"


def snapshot(store: ParquetStore, at: str | None = None) -> dict:
    """Name the present version. Its folders are immutable, so nothing is copied, whatever the size."""
    tables = store.manifest()["tables"]
    counts = [{"name": n, "row_count": store.row_count(n)} for n in store.list_tables()]
    size = sum(store.files.size(f"{store.root}/{p}") for e in tables.values() for p in e["paths"])
    meta = {"timestamp": at or stamp(), "size_bytes": size, "tables": counts}
    held = {"meta": meta, "tables": tables}
    if not store.files.create(f"{store.root}/_snapshots/{meta['timestamp'].replace(':', '-')}.json", json.dumps(held)):
        raise NotFound(f"there is a snapshot at {meta['timestamp']} already")
    return meta


def list_snapshots(store: ParquetStore) -> list[dict]:
    """Descriptions, newest first; what cannot be read is left out."""
    return [x["meta"] for x in store.snapshots()]


def restore(store: ParquetStore, at: str) -> dict:
    """Publish the snapshot of that time, or the last one before it, as the next version."""
    held = store.snapshots()
    found = next((x for x in held if x["meta"]["timestamp"] <= at), None)
    if found is None:
        raise NotFound(f"no snapshot at or before {at}; the earliest is {held[-1]['meta']['timestamp'] if held else 'none'}")
    for name, e in found["tables"].items():
        if not all(store.files.exists(f"{store.root}/{p}") for p in e["paths"]):
            raise NotFound(f"the rows of table {name!r} in snapshot {found['meta']['timestamp']} are gone")
    store.publish(found["tables"], store.version())
    return found["meta"]


def as_of(snapshots: DataFrame, at: str, by: list[str] | None = None) -> DataFrame:
    """The last row at or before a time, per group."""
    found = snapshots.filter(F.col("timestamp") <= at)
    return found.groupBy(*(by or [])).agg(*[F.max_by(c, "timestamp").alias(c) for c in snapshots.columns if c not in (by or [])])


SNAPSHOT_SCHEMA = "timestamp string, size_bytes long, tables array<struct<name string, row_count long>>"
