"""Billing tables in Parquet, by buckets of packages: a batch overwrites the buckets it touches and appends to the logs.

A batch reads only the buckets of its submissions. All new current rows are written aside before any table changes;
then logs are appended, and current tables follow, so current rows never name a log row that is missing. Each write is
whole or absent, but a batch is no transaction over tables: keep a table format below where that is needed. There is
one writer at a time. Frames of a saved batch stay readable, but for `new_table`, which reads the tables as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasebook.model import COLUMNS, CURRENT_TABLES, DIMENSION_TABLES, LOG_TABLES, SOFT_COLUMNS, BillingTables, SoftTables
from leasebook.operators.compare import replace_packages
from leasebook.plans.save import CheckedBatch, SaveBatch, SoftSaveBatch
from leasebook.session import tune_session
from leasebook.sources.staging import stage

MOST_BUCKETS = 1 << 16  # the list of touched buckets is broadcast, so their number is bounded


class PackageStore:
    """First schema."""

    columns = {name: COLUMNS[name] for name in (*CURRENT_TABLES, *LOG_TABLES)}

    def __init__(self, spark: SparkSession, root: str, buckets: int = 1024):
        if not 1 <= buckets <= MOST_BUCKETS:
            raise ValueError(f"buckets must be between 1 and {MOST_BUCKETS}")
        self.spark, self.root, self.buckets = tune_session(spark), root.rstrip("/"), buckets

    def _bucketed(self, rows: DataFrame, key: str = "PackageID") -> DataFrame:
        # A long, so that a key's type does not move it.
        return rows.withColumn("pkg_bucket", F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(self.buckets)).cast("int"))

    def _touched(self, packages: DataFrame) -> DataFrame:
        # The condition always holds; with a condition on this side, Spark prunes the folders of the other.
        return self._bucketed(packages).where("pkg_bucket >= 0").select("pkg_bucket").distinct()

    def _write(self, name: str, rows: DataFrame, mode: str, partitions: str = "dynamic") -> None:
        # Rebalancing keeps a bucket's files together and splits a bucket that is too large.
        (rows.select(*self.columns[name], "pkg_bucket").hint("rebalance", "pkg_bucket").write.mode(mode)
         .option("partitionOverwriteMode", partitions).partitionBy("pkg_bucket").parquet(f"{self.root}/{name}"))

    def create(self, tables, dimensions: BillingTables | None = None) -> None:
        """Write every table; `dimensions` holds client and item tables if `tables` does not."""
        for name in DIMENSION_TABLES:
            getattr(dimensions or tables, name).write.mode("overwrite").parquet(f"{self.root}/{name}")
        for name, columns in self.columns.items():
            self._write(name, self._bucketed(getattr(tables, name), columns[0]), "overwrite", "static")

    def _read(self, name: str, touched: DataFrame | None = None) -> DataFrame:
        """Rows of a table, or of its touched buckets: these prune folders before files are read."""
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        if touched is not None:
            rows = rows.join(F.broadcast(touched), "pkg_bucket", "left_semi")
        columns = self.columns.get(name, rows.columns)
        return rows.select(*columns).where(F.col(columns[0]).isNotNull()) if name in CURRENT_TABLES else rows.select(*columns)

    def tables(self, touched: DataFrame | None = None):
        """All tables, or their rows in the touched buckets."""
        return BillingTables(**{n: self._read(n) for n in DIMENSION_TABLES}, **{n: self._read(n, touched) for n in self.columns})

    def _batch(self, tables, submissions, lines, as_of, **options) -> CheckedBatch:
        return SaveBatch(tables, submissions, lines, as_of, **options)

    def save(self, submissions: DataFrame, lines: DataFrame | None, as_of=None, **options) -> CheckedBatch:
        """Check and apply a batch; the returned plans give messages, refusals and figures."""
        asked = self._touched(submissions.where("PackageID IS NOT NULL"))
        highest = self._read("header").agg(F.coalesce(F.max("PackageID"), F.lit(0))).first()[0]
        batch = self._batch(self.tables(asked), submissions, lines, as_of, highest=highest, **options)
        touched = self._touched(batch.accepted)
        # A row of NULLs for each touched bucket, so that a bucket left without rows is overwritten too.
        after = {
            name: stage(self._bucketed(replace_packages(self._read(name, touched), batch.accepted, rows))
                        .unionByName(touched, allowMissingColumns=True))
            for name, rows in batch.current_rows.items()
        }
        for name, rows in batch.all_log_rows.items():
            self._write(name, self._bucketed(rows, self.columns[name][0]), "append")
        for name, rows in after.items():
            self._write(name, rows, "overwrite")
        return batch


class SoftPackageStore(PackageStore):
    """Second schema: rows are marked inactive, logs hold the new values."""

    columns = SOFT_COLUMNS

    def tables(self, touched: DataFrame | None = None) -> SoftTables:
        return SoftTables(**{n: self._read(n, touched) for n in self.columns})

    def _batch(self, tables, submissions, lines, as_of, **options) -> CheckedBatch:
        return SoftSaveBatch(self._read("client"), self._read("item"), tables, submissions, lines, as_of, **options)
