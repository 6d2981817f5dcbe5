"""Column names of any kind."""

from __future__ import annotations


def quoted(name: str) -> str:
    """Column name as Spark reads it whatever it holds, dots too."""
    return "`" + name.replace("`", "``") + "`"
