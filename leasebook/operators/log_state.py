"""State of the second schema from its logs alone: each log row holds all values after a change, so the latest row is the state.

Per key the row with the highest ChangeID counts; NULL is the lowest. Of rows with equal ids, which only a damaged
log has, the greatest by its values counts, so the result does not depend on the order of rows. The maximum is combined
before the shuffle: a key with very many versions reaches it as one row a task, and no window is sorted. Removed lines,
partners and notes stay as rows with Inactive = 1, as in the current tables. Rows without a PackageID are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.model import CURRENT_TABLES, SOFT_COLUMNS

KEYS = {"header": ["PackageID"], "detail": ["PackageID", "ItemID"], "partner": ["PackageID"], "note": ["PackageID"]}


def current_from_log(log: DataFrame, name: str, until: Column | None = None) -> DataFrame:
    """The current table `name` from the rows of its log; `until` is a condition on the rows to fold, such as a highest ChangeID."""
    keys, columns = KEYS[name], SOFT_COLUMNS[name]
    values = [c for c in columns if c not in keys and c != "ChangeID"]
    rows = log.where("PackageID IS NOT NULL")
    rows = rows if until is None else rows.where(until)
    latest = rows.groupBy(*keys).agg(F.max(F.struct("ChangeID", *values)).alias("_latest"))
    return latest.select(*[F.col(c) if c in keys else F.col("_latest").getField(c).alias(c) for c in columns])


def state_from_logs(logs: dict[str, DataFrame], names: list[str] = CURRENT_TABLES) -> DataFrame:
    """Rows of all current tables in one frame, with their table in `Part`; columns a table lacks are NULL."""
    parts = [current_from_log(logs[f"{n}_log"], n).select(F.lit(n).alias("Part"), *SOFT_COLUMNS[n]) for n in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drift(current: DataFrame, log: DataFrame, name: str) -> DataFrame:
    """Keys whose current row differs from their log's state, with what is wrong: 'no log', 'no row' or 'differs'.

    NULL equals NULL here. Both sides are tagged rows of one frame, grouped once by key.
    """
    keys = KEYS[name]
    values = F.struct(*[c for c in SOFT_COLUMNS[name] if c not in keys])
    tagged = (
        current.select(*keys, values.alias("row"), F.lit(None).cast(current.select(values.alias("v")).schema["v"].dataType).alias("logged"))
        .union(current_from_log(log, name).select(*keys, F.lit(None).alias("row"), values.alias("logged")))
    )
    wrong = F.when(F.col("logged").isNull(), "no log").when(F.col("row").isNull(), "no row").when(~F.col("row").eqNullSafe(F.col("logged")), "differs")
    return (
        tagged.groupBy(*keys).agg(F.max("row").alias("row"), F.max("logged").alias("logged"))
        .select(*keys, wrong.alias("Fault")).where("Fault IS NOT NULL")
    )
