"""Command line: ``python -m tidemark.cli [--config FILE] [--output text|json] COMMAND``."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import sys

from pyspark.sql import SparkSession

from tidemark.operators import diff as D
from tidemark.operators import sync as S
from tidemark.plans.config import Config, ConfigError, SyncError, detect_local_db, exit_code
from tidemark.sources import relay as R
from tidemark.sources.httpsql import Client, HttpStore, PluginClient, PluginStore, plugin_path
from tidemark.sources.sqlite import SqliteStore
from tidemark.sources.store import ParquetStore, Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description="Compare and replicate tables.")
    top.add_argument("--config", default="tidemark.toml")
    top.add_argument("--output", choices=("text", "json"), default="text")
    top.add_argument("--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("push", "pull", "sync", "stash", "retrieve"):
        one = commands.add_parser(name)
        one.add_argument("--table")
        one.add_argument("--dry-run", action="store_true")
    commands.add_parser("diff").add_argument("--table")
    commands.add_parser("status")
    commands.add_parser("snapshot")
    commands.add_parser("snapshots")
    commands.add_parser("restore").add_argument("timestamp")
    watch = commands.add_parser("watch")
    watch.add_argument("--interval", type=float, default=30)
    watch.add_argument("--ticks", type=int)
    watch.add_argument("--state", help="a file that holds the time of the last sync")
    watch.add_argument("--lock", help="a file that keeps a second instance away")
    exchange = commands.add_parser("broadcast")
    exchange.add_argument("--once", action="store_true")
    return top


def local_store(spark: SparkSession, config: Config) -> Store:
    path = config.local or detect_local_db(".")
    if os.path.isfile(path):
        return SqliteStore(spark, path, config.sync.timestamp_column)
    return ParquetStore(spark, path)


def target_store(spark: SparkSession, config: Config) -> Store:
    t = config.resolved_target()
    if t["type"] == "sqlite":
        return SqliteStore(spark, t["path"], config.sync.timestamp_column)
    if t["type"] == "parquet":
        return ParquetStore(spark, t["path"])
    if t["type"] == "http":
        if not t.get("url"):
            raise ConfigError("an HTTP target needs a url")
        return HttpStore(spark, Client(t["url"], t.get("profile", "generic"), t.get("auth_token"), config.sync.retry), config.sync.timestamp_column)
    path = t.get("path") or plugin_path(t["name"], [os.path.expanduser("~/.tidemark/plugins")])
    return PluginStore(spark, PluginClient([path]), {k: v for k, v in t.items() if k not in ("type", "name", "path")}, config.sync.timestamp_column, config.sync.batch_size)


def run(spark: SparkSession, args: argparse.Namespace, config: Config) -> dict:
    """The report of a command."""
    c, command = config.sync, args.command
    if command in ("push", "pull", "sync"):
        out = S.sync_all(local_store(spark, config), target_store(spark, config), c, command, table=args.table, dry_run=args.dry_run, verbose=args.verbose)
        return S.dry_run_output(command, out) if args.dry_run else S.command_output(command, out)
    if command == "diff":
        a, b = local_store(spark, config), target_store(spark, config)
        names = [S.validated(args.table, a.list_tables())] if args.table else S.tables_to_sync(a, b, c)
        tables = []
        for n in names:
            found = S.diff_of(a, b, n, c, check_keys=True).persist()
            preview = {r["bucket"]: r["pks"] for r in D.detail(found, 5).collect()}
            tables.append({"name": n, **D.stats(found).first().asDict(), "preview": preview, "summary": D.summary(found).first()["summary"]})
            found.unpersist()
        return {"command": command, "status": "ok", "tables": tables}
    if command == "status":
        sides, errors = {}, {}
        for side, make in (("local", local_store), ("remote", target_store)):
            try:
                sides[side] = make(spark, config)
            except SyncError as e:
                errors[side] = str(e)
        rows = [r.asDict() for r in S.status(sides).collect()] if sides else []
        return {"command": command, "status": "ok", "tables": rows, "errors": errors}
    if command in ("stash", "retrieve"):
        url = config.stash.get("url") or ""
        if not url:
            raise ConfigError("the configuration names no relay")
        out = getattr(R, command)(spark, local_store(spark, config), url, c, args.table, args.dry_run)
        return S.command_output(command, out, args.dry_run)
    if command in ("snapshot", "snapshots", "restore"):
        store = ParquetStore(spark, config.stash.get("url") or config.local or "")
        found = R.snapshot(store) if command == "snapshot" else R.restore(store, args.timestamp) if command == "restore" else R.list_snapshots(store)
        return {"command": command, "status": "ok", "snapshots" if command == "snapshots" else "snapshot": found}
    if command == "broadcast":
        from tidemark.operators.peer import exchange

        a, b = local_store(spark, config), target_store(spark, config)
        return S.command_output(command, [exchange(a, b, n, c) for n in S.tables_to_sync(a, b, c)])
    from tidemark.streaming.stream import PidLock, watch

    a, b = local_store(spark, config), target_store(spark, config)
    with PidLock(args.lock) if args.lock else contextlib.nullcontext():
        n = watch(lambda: S.sync_all(a, b, c), args.interval, args.state, retry=c.retry, report=lambda line: print(json.dumps(line), flush=True), ticks=args.ticks)
    return {"command": command, "status": "ok", "ticks": n}


def text(report: dict) -> str:
    lines = [f"{report['command']}: {report['status']}"]
    for t in report.get("tables", []):
        lines.append("  " + ", ".join(f"{k} {v}" for k, v in t.items()))
    return "\n".join(lines + [json.dumps(report[k]) for k in ("snapshot", "snapshots", "errors") if report.get(k)])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config = Config.load(args.config)
        spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
        report = run(spark, args, config)
        print(json.dumps(report) if args.output == "json" else text(report))
        return 0
    except Exception as e:
        code = exit_code(e)
        print(json.dumps({"command": args.command, "status": "error", "error": str(e), "exit_code": code}) if args.output == "json" else f"error: {e}", file=sys.stderr)
        return code


if __name__ == "__main__":
    sys.exit(main())
