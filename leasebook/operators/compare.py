"""Column comparison and row replacement shared by the change operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differs(pairs: list[tuple[Column, Column]], null_safe: bool = False) -> Column:
    """True where any pair differs. As first written, a NULL on either side is no difference."""
    def one(old: Column, new: Column) -> Column:
        return ~old.eqNullSafe(new) if null_safe else F.coalesce(old != new, F.lit(False))

    return reduce(lambda a, b: a | b, [one(old, new) for old, new in pairs])


def differs_or_null(pairs: list[tuple[Column, Column]]) -> Column:
    """True where any pair differs or has a NULL on either side."""
    return reduce(lambda a, b: a | b, [o.isNull() | n.isNull() | (o != n) for o, n in pairs])


def for_packages(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """Only the rows of the given packages."""
    return rows.join(packages.select("PackageID"), "PackageID", "left_semi")


def replace_packages(current: DataFrame, packages: DataFrame, rows: DataFrame) -> DataFrame:
    """Current rows with those of the given packages replaced."""
    kept = current.join(packages.select("PackageID"), "PackageID", "left_anti")
    return kept.select(*rows.columns).unionByName(rows)


def next_id(rows: DataFrame, keys: list[str], id_column: str, out: str) -> DataFrame:
    """Per key the highest id plus one."""
    return rows.groupBy(*keys).agg((F.max(id_column) + 1).alias(out))
