"""Selection of columns and tables by name."""

from __future__ import annotations

from collections.abc import Iterable

#: Columns that never count as content.
BOOKKEEPING = ("updated_at", "created_at")


def matches(pattern: str, name: str) -> bool:
    """``*`` at either end is any text; anywhere else it is a plain character."""
    if pattern == "*":
        return True
    head, tail = pattern.startswith("*"), pattern.endswith("*")
    core = pattern[head : len(pattern) - tail if len(pattern) > head else None]
    if head and tail:
        return core in name
    return name.endswith(core) if head else name.startswith(core) if tail else name == core


def excluded_columns(columns: Iterable[str], patterns: Iterable[str]) -> list[str]:
    patterns = list(patterns)
    return [c for c in columns if any(matches(p, c) for p in patterns)]


def content_columns(columns: Iterable[str], ts_col: str | None, exclude: Iterable[str] = ()) -> list[str]:
    """Columns whose values make the content hash, in the order of the table."""
    columns = list(columns)
    left_out = {*BOOKKEEPING, ts_col, *excluded_columns(columns, exclude)}
    return [c for c in columns if c not in left_out]


def user_tables(names: Iterable[str], hidden: tuple[str, ...] = ("sqlite_", "_cf_")) -> list[str]:
    """Sorted names without the system's own, which are known by a literal beginning."""
    return sorted(n for n in names if not n.startswith(hidden))
