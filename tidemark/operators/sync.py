"""Push, pull and two-way sync of tables between stores, with dry runs, reports and a change feed."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cache as K
from tidemark.operators import diff as D
from tidemark.operators import merge as M
from tidemark.plans.config import ConfigError, ConflictPolicy, NoPrimaryKey, NotFound, SyncConfig

log = logging.getLogger("tidemark")


@dataclass
class SyncResult:
    table: str
    pushed: int = 0
    pulled: int = 0
    stats: dict | None = None
    detail: dict | None = None

    @property
    def has_changes(self) -> bool:
        return self.pushed + self.pulled > 0


@dataclass
class Progress:
    """Callbacks of a transfer; the defaults do nothing."""

    start: Callable[[str, int], None] = lambda table, rows: None
    batch: Callable[[str, int], None] = lambda table, rows: None
    finish: Callable[[str], None] = lambda table: None


def validated(name: str, known: Iterable[str]) -> str:
    """A table name as it is listed, case and all."""
    known = sorted(known)
    if name not in known:
        raise NotFound(f"no table {name!r}; there are: {', '.join(known) or 'none'}")
    return name


def tables_to_sync(a, b, config: SyncConfig) -> list[str]:
    """Sorted names on both sides that the settings allow and that have a key."""
    left, right = set(a.list_tables()), set(b.list_tables())
    for one in sorted(left ^ right):
        if config.should_sync_table(one):
            log.warning("table %s is on one side only", one)
    out = []
    for name in sorted(left & right):
        if config.should_sync_table(name):
            if a.spec(name).pk:
                out.append(name)
            else:
                log.warning("table %s has no key", name)
    return out


def _pair(a, b, name: str, config: SyncConfig) -> tuple[DataFrame, DataFrame, list[str], str]:
    spec = a.spec(name)
    if not spec.pk:
        raise NoPrimaryKey(name)
    left, right = shared(a.table(name), b.table(name), spec.pk, name)
    return left, right, spec.pk, spec.ts_col or config.timestamp_column


def shared(left: DataFrame, right: DataFrame, pk: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns that both have; others are neither compared nor moved, which is logged. The key must be on both sides."""
    if lost := [k for k in pk if k not in left.columns or k not in right.columns]:
        raise ConfigError(f"table {name!r}: key column {lost[0]!r} is on one side only")
    both = [c for c in left.columns if c in right.columns]
    if len(both) < max(len(left.columns), len(right.columns)):
        log.warning("table %s: columns on one side only are left out: %s", name, ", ".join(sorted({*left.columns} ^ {*right.columns})))
        return left.select(*both), right.select(*both)
    return left, right


def diff_of(a, b, name: str, config: SyncConfig, check_keys: bool = False) -> DataFrame:
    """The comparison of one table of two stores."""
    left, right, pk, ts_col = _pair(a, b, name, config)
    if check_keys:
        D.require_keys(left, pk)
        D.require_keys(right, pk)
    return D.diff_table(left, right, pk, ts_col, config.exclude_columns)


def cached_diff_of(a, b, name: str, config: SyncConfig, caches: tuple[K.MetadataCache, K.MetadataCache]) -> DataFrame:
    """The same from the metadata that is kept of both sides, after what is new since the last run was read."""
    left, right, pk, ts_col = _pair(a, b, name, config)
    return K.diff_cached(*caches, name, left, right, pk, ts_col, config.exclude_columns)


def moved(source: DataFrame, target: DataFrame, keys: DataFrame, pk: list[str], config: SyncConfig) -> DataFrame:
    """The target after the wanted rows of the source came in."""
    return M.upsert(target, M.strip(M.fetch(source, keys, pk), config.exclude_columns), pk, config.merge_mode, keys)


def _report(diff: DataFrame, config: SyncConfig, verbose: bool) -> tuple[dict, dict | None]:
    counts = D.stats(diff).first().asDict()
    return counts, {r["bucket"]: r["pks"] for r in D.detail(diff).collect()} if verbose else None


def alike(a, b, name: str, config: SyncConfig) -> bool:
    """Whether both sides have equal fingerprints: two aggregates, no shuffle of rows. Worth it where most tables do not change."""
    left, right, pk, ts_col = _pair(a, b, name, config)
    marks = [D.fingerprint(D.with_meta(x, pk, ts_col, config.exclude_columns)).first() for x in (left, right)]
    return marks[0] == marks[1]


def sync_table(a, b, name: str, config: SyncConfig, direction: str = "sync", dry_run: bool = False, verbose: bool = False, progress: Progress | None = None, tell: Callable[[str, int, Iterator[str]], None] | None = None, caches: tuple[K.MetadataCache, K.MetadataCache] | None = None) -> SyncResult:
    """Compare once, then write the sides that the direction and the policy change.

    After rows were pulled, ``tell`` gets the table, their number and all their keys, which come to the driver a partition at a time.

    The comparison is held while both sides are written, so that the second one does not see the first. What is written is the changed
    rows, and in a store of files the files that hold their keys. With ``caches``, the metadata kept of both sides, only rows from their
    cursors on are read to compare, and a side that was written is brought up to date there.
    """
    progress = progress or Progress()
    left, right, pk, _ = _pair(a, b, name, config)
    if not caches:
        D.require_keys(left, pk)
        D.require_keys(right, pk)
        if config.fingerprint_first and not dry_run and alike(a, b, name, config):
            return SyncResult(name)
    policy = config.conflict_resolution
    found = (cached_diff_of(a, b, name, config, caches) if caches else diff_of(a, b, name, config)).persist()
    try:
        counts, detail = _report(found, config, verbose and dry_run)
        push = sum(counts[x] for x in D.push_buckets(policy)) if direction in ("push", "sync") else 0
        pull = sum(counts[x] for x in D.pull_buckets(policy)) if direction in ("pull", "sync") else 0
        if counts[D.CONTENT_DIFFERS] and policy in (ConflictPolicy.NEWER_WINS, ConflictPolicy.UUID_V7_WINS):
            log.warning("table %s: %d rows differ and none is newer; they stay", name, counts[D.CONTENT_DIFFERS])
        if dry_run:
            return SyncResult(name, push, pull, counts, detail)
        for n, side, source, keys, of, to in ((push, b, left, D.rows_to_push(found, policy), "local", 1), (pull, a, right, D.rows_to_pull(found, policy), "remote", 0)):
            if n:
                progress.start(name, n)
                side.apply(name, M.strip(M.fetch(source, keys, pk), config.exclude_columns), keys.select(*pk), config.merge_mode)
                if caches:
                    caches[to].absorb(name, keys.select(*pk, "pk", F.col(f"{of}_ts").alias("ts"), F.col(f"{of}_hash").alias("content_hash")), pk)
                progress.batch(name, n)
                progress.finish(name)
        if pull and tell:
            tell(name, pull, (r["pk"] for r in D.rows_to_pull(found, policy).select("pk").toLocalIterator()))
        return SyncResult(name, push, pull)
    finally:
        found.unpersist()


def push_table(a, b, name: str, config: SyncConfig, **more) -> SyncResult:
    return sync_table(a, b, name, config, "push", **more)


def pull_table(a, b, name: str, config: SyncConfig, **more) -> SyncResult:
    return sync_table(a, b, name, config, "pull", **more)


def sync_all(a, b, config: SyncConfig, direction: str = "sync", table: str | None = None, parallel: int = 1, **more) -> list[SyncResult]:
    """All tables that both sides share, or one that both must have; ``parallel`` of them at a time as jobs of their own."""
    if table is not None:
        validated(table, a.list_tables())
        validated(table, b.list_tables())
        names = [table]
    else:
        names = tables_to_sync(a, b, config)
    if parallel > 1:
        with ThreadPoolExecutor(parallel) as pool:
            return list(pool.map(lambda n: sync_table(a, b, n, config, direction, **more), names))
    return [sync_table(a, b, n, config, direction, **more) for n in names]


def push_all(a, b, config: SyncConfig, **more) -> list[SyncResult]:
    return sync_all(a, b, config, "push", **more)


def pull_all(a, b, config: SyncConfig, **more) -> list[SyncResult]:
    return sync_all(a, b, config, "pull", **more)


def command_output(command: str, results: list[SyncResult], dry_run: bool = False) -> dict:
    """Report of a run: tables with changes only, without zero counts."""
    rows = []
    for r in results:
        if r.has_changes:
            rows.append({"name": r.table} | {k: v for k, v in (("rows_pushed", r.pushed), ("rows_pulled", r.pulled)) if v})
    return {"command": command, "status": "ok", "tables": rows} | ({"dry_run": True} if dry_run else {})


def dry_run_output(command: str, results: list[SyncResult]) -> dict:
    """Report of a dry run: counts per bucket, or the keys where they were asked for."""
    rows = []
    for r in results:
        stats = r.stats or dict.fromkeys(D.BUCKETS, 0)
        shown = {b: (r.detail or {}).get(b, []) if r.detail is not None else stats[b] for b in D.BUCKETS if b != D.IDENTICAL}
        rows.append({"name": r.table} | shown | {"identical": stats[D.IDENTICAL], "rows_to_push": r.pushed, "rows_to_pull": r.pulled})
    return {"command": command, "status": "dry_run", "tables": rows, "total_rows_to_push": sum(r.pushed for r in results), "total_rows_to_pull": sum(r.pulled for r in results), "exit_code": 0}


def status(stores: dict) -> DataFrame:
    """``(side, table, n_rows)`` of all stores."""
    out = None
    for side, store in stores.items():
        for name in store.list_tables():
            one = store.table(name).agg(F.count("*").alias("n_rows")).select(F.lit(side).alias("side"), F.lit(name).alias("table"), "n_rows")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise NotFound("no tables on any side")
    return out


def change_feed(diff: DataFrame, table: str, policy: ConflictPolicy, source: str = "sync") -> DataFrame:
    """``(table, pk, op, source)`` of the rows that a pull brings in."""
    op = F.when(F.col("bucket") == D.REMOTE_ONLY, "insert").otherwise("update")
    return D.rows_to_pull(diff, policy).select(F.lit(table).alias("table"), "pk", op.alias("op"), F.lit(source).alias("source"))


@dataclass
class Engine:
    """A local store and an optional target, with the calls of an application: push, pull, sync, diff, events.

    An event names at most ``most_keys`` keys; a table with more changed keys is told in consecutive events. With ``caches``, one of
    each side, runs read what is new since the last one; ``clear_cache`` makes the next run a full scan.
    """

    local: object
    remote: object | None = None
    config: SyncConfig = field(default_factory=SyncConfig)
    most_keys: int = 1000
    caches: tuple[K.MetadataCache, K.MetadataCache] | None = None

    def __post_init__(self):
        if self.most_keys < 1:
            raise ConfigError("most_keys must be positive")
        self._listeners: list[Callable[[dict], None]] = []
        self._telling = threading.RLock()

    def on(self, event: str, call: Callable[[dict], None]) -> Callable[[], None]:
        """Hear of ``table-changed``; the answer ends it.

        After a pull or sync wrote a table, events follow that together name all of its changed keys: ``part`` counts from
        1 to ``parts``, ``rows`` is the number of all keys. Events come one at a time; an error of a listener is logged.
        """
        if event != "table-changed":
            raise NotFound(f"no event {event!r}")
        self._listeners.append(call)
        return lambda: self._listeners.remove(call) if call in self._listeners else None

    def _run(self, direction: str, **more) -> list[SyncResult]:
        if self.remote is None:
            raise NotFound("there is no target")

        def tell(table: str, rows: int, keys: Iterator[str]) -> None:
            parts = -(-rows // self.most_keys)
            with self._telling:
                for part, some in enumerate(batched(keys, self.most_keys), 1):
                    for call in list(self._listeners):
                        try:
                            call({"table": table, "rows": rows, "changedPks": list(some), "removedPks": [], "source": direction, "part": part, "parts": parts})
                        except Exception:
                            log.exception("a listener failed on table %s", table)

        return sync_all(self.local, self.remote, self.config, direction, tell=tell if self._listeners else None, caches=self.caches, **more)

    def push(self, **more) -> list[SyncResult]:
        return self._run("push", **more)

    def pull(self, **more) -> list[SyncResult]:
        return self._run("pull", **more)

    def sync(self, **more) -> list[SyncResult]:
        return self._run("sync", **more)

    def diff(self) -> dict[str, dict]:
        """Counts per bucket and table; without a target all rows are on the local side only."""
        if self.remote is None:
            return {n: dict.fromkeys(D.BUCKETS, 0) | {D.LOCAL_ONLY: self.local.row_count(n)} for n in self.local.list_tables() if self.config.should_sync_table(n)}
        found = (lambda n: cached_diff_of(self.local, self.remote, n, self.config, self.caches)) if self.caches else (lambda n: diff_of(self.local, self.remote, n, self.config))
        return {n: D.stats(found(n)).first().asDict() for n in tables_to_sync(self.local, self.remote, self.config)}

    def erase_local(self) -> list[str]:
        """Empty the tables of the local side; their schemas stay."""
        names = [n for n in self.local.list_tables() if self.config.should_sync_table(n)]
        for n in names:
            self.local.replace(n, M.erase(self.local.table(n)))
        self.clear_cache()
        return names

    def update_target(self, remote) -> None:
        """Another target; what was kept of the one before is dropped, what was kept of the local side stays."""
        self.remote = remote
        if self.caches:
            self.caches[1].clear()

    def update_auth(self, token: str) -> None:
        """Another token for the target's service; the kept metadata stays."""
        if self.remote is None:
            raise NotFound("there is no target")
        if not hasattr(self.remote, "set_token"):
            raise ConfigError("the target is no HTTP service")
        self.remote.set_token(token)

    def clear_cache(self) -> None:
        """Forget the metadata of both sides, as after deletions or a change of the schema."""
        for one in self.caches or ():
            one.clear()


def as_dict(result: SyncResult) -> dict:
    return asdict(result)
