"""Column names that clash with none of a table's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores after it as long as a column has that name."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(names: Iterable[str]) -> list[Column]:
    return [F.col(quoted(c)) for c in names]
