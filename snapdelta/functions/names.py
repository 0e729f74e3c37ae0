"""Column names with characters of any kind."""

from __future__ import annotations


def quoted(name: str) -> str:
    """A column name as one name, whatever its dots and quotes."""
    return "`" + name.replace("`", "``") + "`"
