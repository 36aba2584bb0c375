"""Column names for helper columns beside whatever columns a caller's table has."""

from __future__ import annotations

from collections.abc import Sequence


def spare(columns: Sequence[str], name: str) -> str:
    """A column name like ``name`` that ``columns`` has not."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
