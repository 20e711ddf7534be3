"""Configuration, conflict policies, errors with exit codes, retry delays."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from enum import Enum
from pathlib import Path

from tidemark.functions.globs import excluded_columns


class SyncError(Exception):
    """Base of the engine's errors; ``exit_code`` is what the command line returns."""

    exit_code = 1
    transient = False


class ConfigError(SyncError):
    exit_code = 2


class NetworkError(SyncError):
    """An HTTP answer or a failed connection."""

    exit_code = 3
    transient = True

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None, timeout: bool = False):
        super().__init__(message)
        self.status, self.retry_after, self.timeout = status, retry_after, timeout

    @property
    def retryable(self) -> bool:
        return self.timeout or self.status is None or self.status == 429 or self.status >= 500

    @property
    def retry_after_ms(self) -> int | None:
        return None if self.retry_after is None else min(int(self.retry_after * 1000), (1 << 64) - 1)


class ConcurrentWrite(SyncError):
    """Somebody else published a newer version first."""

    exit_code = 4
    transient = True


class ConflictError(SyncError):
    exit_code = 4


class NotFound(SyncError):
    exit_code = 5


class PluginError(SyncError):
    exit_code = 6


class NoPrimaryKey(SyncError):
    """A table without a key cannot be compared."""


class DuplicateKey(SyncError):
    """A key that is null or stands for several rows."""


class ConflictPolicy(str, Enum):
    """Who gets the rows that differ with no newer side; newer rows always travel."""

    LOCAL_WINS = "local_wins"
    REMOTE_WINS = "remote_wins"
    NEWER_WINS = "newer_wins"
    UUID_V7_WINS = "uuid_v7_wins"

    @classmethod
    def parse(cls, name: str) -> ConflictPolicy:
        try:
            return cls(name)
        except ValueError:
            raise ConfigError(f"unknown conflict policy {name!r}; known: {', '.join(p.value for p in cls)}") from None


@dataclass
class Retry:
    """Exponential back-off: ``min(initial * multiplier ** attempt, cap)``."""

    max_retries: int = 5
    initial_ms: int = 100
    cap_ms: int = 30_000
    multiplier: float = 2.0

    def __post_init__(self):
        self.max_retries = min(self.max_retries, 100)
        self.multiplier = max(self.multiplier, 1.0)

    def delay_ms(self, attempt: int) -> int:
        try:
            return int(min(self.initial_ms * self.multiplier**attempt, self.cap_ms))
        except OverflowError:
            return self.cap_ms


@dataclass
class SyncConfig:
    """What is compared and how; the defaults hold where a file says nothing."""

    tables: list[str] = field(default_factory=list)
    exclude_tables: list[str] = field(default_factory=lambda: ["sqlite_sequence", "_cf_KV", "__drizzle_migrations"])
    exclude_columns: list[str] = field(default_factory=list)
    timestamp_column: str = "updated_at"
    conflict_resolution: ConflictPolicy = ConflictPolicy.LOCAL_WINS
    max_retries: int = 5
    initial_retry_delay_ms: int = 100
    max_retry_delay_ms: int = 30_000
    backoff_multiplier: float = 2.0
    batch_size: int = 100
    max_statement_bytes: int = 92_160
    merge_mode: str = "preserve"
    fingerprint_first: bool = False

    @classmethod
    def from_dict(cls, values: dict) -> SyncConfig:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values) - known):
            raise ConfigError(f"unknown settings: {', '.join(unknown)}")
        values = dict(values)
        if "conflict_resolution" in values:
            values["conflict_resolution"] = ConflictPolicy.parse(values["conflict_resolution"])
        if values.get("merge_mode", "preserve") not in ("preserve", "replace"):
            raise ConfigError("merge_mode is preserve or replace")
        return cls(**values)

    @property
    def retry(self) -> Retry:
        return Retry(self.max_retries, self.initial_retry_delay_ms, self.max_retry_delay_ms, self.backoff_multiplier)

    def should_sync_table(self, table: str) -> bool:
        """The exclude list beats the include list; an empty include list is all tables."""
        return table not in self.exclude_tables and (not self.tables or table in self.tables)

    def excluded(self, columns: list[str]) -> list[str]:
        return excluded_columns(columns, self.exclude_columns)


@dataclass
class Config:
    """A configuration file: the local side, the target, the relay, and the sync settings."""

    local: str | None = None
    target: dict = field(default_factory=dict)
    stash: dict = field(default_factory=dict)
    broadcast: dict = field(default_factory=dict)
    sync: SyncConfig = field(default_factory=SyncConfig)

    @classmethod
    def from_toml(cls, text: str) -> Config:
        try:
            held = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(str(e)) from None
        return cls(
            local=held.get("local_db") or held.get("local"),
            target=held.get("target") or {k: held[k] for k in ("remote_db", "url", "auth_token", "profile", "database_id", "account_id", "api_token") if k in held},
            stash=held.get("stash", {}),
            broadcast=held.get("broadcast", {}),
            sync=SyncConfig.from_dict(held.get("sync", {})),
        )

    @classmethod
    def load(cls, path: str) -> Config:
        try:
            return cls.from_toml(Path(path).read_text())
        except FileNotFoundError:
            raise ConfigError(f"no configuration file at {path}") from None

    def resolved_target(self) -> dict:
        """The target with its kind: a store folder, an SQLite file, an HTTP profile or a plugin."""
        t = dict(self.target)
        kind = t.pop("type", None) or ("d1" if "database_id" in t else "http" if "url" in t else "sqlite" if "remote_db" in t or "path" in t else None)
        if kind == "d1":
            return {"type": "http", "profile": "d1", "auth_token": t.pop("api_token", t.pop("auth_token", None)), **t}
        if kind == "plugin" and not (t.get("name") or t.get("path")):
            raise ConfigError("a plugin target needs a name or a path")
        if kind == "sqlite":
            return {"type": "sqlite", "path": t.get("path") or t.get("remote_db")}
        if kind in ("http", "plugin", "parquet"):
            return {"type": kind, **t}
        raise ConfigError("the configuration names no target")


def detect_local_db(folder: str) -> str:
    """The largest non-empty ``*.sqlite`` file of a folder."""
    found = [(p.stat().st_size, str(p)) for p in Path(folder).glob("**/*.sqlite") if p.stat().st_size > 0]
    if not found:
        raise ConfigError(f"no SQLite file in {folder}")
    return max(found)[1]


def is_transient(error: BaseException) -> bool:
    """Whether a watch loop goes on after an error."""
    return isinstance(error, SyncError) and error.transient or isinstance(error, (ConnectionError, TimeoutError))


def exit_code(error: BaseException) -> int:
    return error.exit_code if isinstance(error, SyncError) else 3 if isinstance(error, (ConnectionError, TimeoutError)) else 1


def instance_id(setting: str | None = None) -> str:
    return setting or os.uname().nodename or "unknown"
