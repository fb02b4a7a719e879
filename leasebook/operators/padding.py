"""Blank rows appended to item lists so that a form has room for new entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Number of blank rows, the key marking the end of a list, the item columns.
BLANK_ROWS = 5
END_OF_LIST = "END_OF_LIST"
ITEM_COLUMNS = ["ItemName", "ItemPrice", "Quantity", "ItemDiscount", "LicenseFactor"]


def _repeat(keys: DataFrame, n: int) -> DataFrame:
    return keys.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_n")).drop("_n")


def pad_blank_rows(rows: DataFrame, keys: DataFrame, n: int = BLANK_ROWS) -> DataFrame:
    """Append n rows per key with an empty item name and NULL in the other columns."""
    blank = _repeat(keys, n).withColumn("ItemName", F.lit(""))
    return rows.unionByName(blank, allowMissingColumns=True)


def pad_empty_text_rows(rows: DataFrame, keys: DataFrame, n: int = BLANK_ROWS) -> DataFrame:
    """Append n rows per key with every item column an empty text; values are returned as text."""
    other = [c for c in rows.columns if c not in ITEM_COLUMNS]
    as_text = rows.select(*other, *[F.col(c).cast("string").alias(c) for c in ITEM_COLUMNS])
    blank = _repeat(keys, n).select("*", *[F.lit("").alias(c) for c in ITEM_COLUMNS])
    return as_text.unionByName(blank, allowMissingColumns=True)


def end_of_list_rows(keys: DataFrame, n: int = BLANK_ROWS) -> DataFrame:
    """n rows per key of empty texts, marked as the end of the list."""
    return _repeat(keys, n).select(
        "*", F.lit(END_OF_LIST).alias("EndOfListKey"), *[F.lit("").alias(c) for c in ITEM_COLUMNS]
    )
