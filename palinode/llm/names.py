"""Input columns whose names an operator needs for itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def set_aside(df: DataFrame, names: Iterable[str], used: str = "") -> tuple[DataFrame, str]:
    """The table with every column named like one of `names` (without case, as Spark compares) renamed by appending `_in` until
    the name is free, and the name that the column `used` then has. No column is lost."""
    taken, out = {n.lower() for n in names}, []
    free = taken | {c.lower() for c in df.columns}
    for c in df.columns:
        new = c
        if c.lower() in taken:
            while new.lower() in free:
                new += "_in"
            free.add(new.lower())
        out.append(new)
    return (df if out == df.columns else df.toDF(*out)), dict(zip(df.columns, out)).get(used, used)
