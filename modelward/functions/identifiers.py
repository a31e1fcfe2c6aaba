"""Checks on names that users hand to the public API."""

from __future__ import annotations

import re

# Accepted name patterns.
TABLE_NAME = re.compile(r"[A-Za-z0-9_]+(\.[A-Za-z0-9_]+){0,2}")
COLUMN_NAME = re.compile(r"[A-Za-z0-9_]+")
ALIAS_NAME = re.compile(r"[A-Za-z0-9_\-]+")


class UnsafeName(ValueError):
    """A table or column name that the API refuses."""


def check_table(name: str) -> str:
    if not name or not TABLE_NAME.fullmatch(name):
        raise UnsafeName(f"unsafe table name: {name!r}")
    return name


def check_column(name: str) -> str:
    if not name or not COLUMN_NAME.fullmatch(name):
        raise UnsafeName(f"unsafe column name: {name!r}")
    return name


def usable_columns(names: list[str]) -> list[str]:
    """Columns with an acceptable name; the others are skipped, not refused."""
    return [n for n in names if n and COLUMN_NAME.fullmatch(n)]
