"""Billing tables written in buckets of PackageID, so that package reports join without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leasebook.model import BillingTables

PACKAGE_TABLES = ["header", "detail", "partner", "note", "header_log", "detail_log", "partner_log", "note_log", "change_log"]


def write_bucketed(tables: BillingTables, prefix: str, buckets: int) -> None:
    """Save the package tables under `prefix`, each in the same number of buckets, sorted by PackageID.

    Rows are dealt by PackageID once, so a bucket is one file and a reader need not sort. A package with a large
    share of all rows makes one large bucket: keep such tables unbucketed, where adaptive execution splits the key.
    """
    for name in PACKAGE_TABLES:
        table = getattr(tables, name)
        (table.repartition(buckets, "PackageID").sortWithinPartitions("PackageID").write.mode("overwrite")
         .bucketBy(buckets, "PackageID").sortBy("PackageID").saveAsTable(f"{prefix}_{name}"))


def bucketed_tables(spark: SparkSession, prefix: str, tables: BillingTables) -> BillingTables:
    """`tables` with the package tables read from their buckets."""
    read: dict[str, DataFrame] = {name: spark.table(f"{prefix}_{name}") for name in PACKAGE_TABLES}
    return BillingTables(**{name: read.get(name, getattr(tables, name)) for name in vars(tables)})
