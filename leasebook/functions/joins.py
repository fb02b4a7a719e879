"""Joins to dimensions that stay balanced when one key, or no key, holds most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Hash values that rows without a key are dealt over; they match nothing, so the number changes no result.
SPREAD = 1 << 16


def lookup_join(fact: DataFrame, dim: DataFrame, on: list[str], spread_by: list[str],
                how: str = "left") -> DataFrame:
    """Join fact rows to a dimension with unique `on` keys, as "left" or "inner".

    The dimension has one row a key, so adaptive execution can split a hot key's fact rows over as
    many tasks as their bytes ask for, or broadcast a small dimension. Rows without a key would all
    hash alike; a second key, 0 wherever a key is there, deals them out by a hash of `spread_by`.
    """
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    dealt = F.when(missing, F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)) + 1).otherwise(0)
    return fact.withColumn("_dealt", dealt).join(dim.withColumn("_dealt", F.lit(0).cast("long")), [*on, "_dealt"], how).drop("_dealt")
