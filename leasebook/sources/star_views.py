"""Billing tables derived from the TPC-H-like star schema, as SQL views.

One SQL text per view, run unchanged by Spark and by the checking engine. Views are
joined into a WITH clause holding only what a query needs, so nothing is registered in
the session. FIXTURES.md says which case each rule brings about.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from leasebook.model import BillingTables, SoftTables
from leasebook.session import plan_bytes, size_shuffles, tune_session

BASE_TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem"]

VIEWS: dict[str, str] = {}

VIEWS["client"] = """
SELECT c_custkey AS ClientID, c_name AS ClientName, concat(c_mktsegment, ' desk') AS BillingContactName,
  concat('billing', CAST(c_custkey AS VARCHAR(20)), '@example.com') AS BillingEmail,
  concat(CAST(c_custkey % 900 + 100 AS VARCHAR(20)), ' Main St') AS BillingAddress1,
  CAST(5550000 + c_custkey AS VARCHAR(20)) AS BillingPhoneNumber
FROM customer"""

VIEWS["item"] = """
SELECT p_partkey AS ItemID, concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS ItemName,
  CAST(p_retailprice AS DECIMAL(19,4)) AS DefaultPrice, p_partkey AS ItemChangeID
FROM part"""

VIEWS["item_log"] = """
SELECT p_partkey AS ItemChangeID, DATE '2019-06-01' AS Updated FROM part WHERE p_size > 16"""

VIEWS["header"] = """
SELECT o_orderkey AS PackageID, o_custkey AS ClientID, CASE WHEN o_orderkey % 101 <> 7 THEN n_name END AS Location,
  CAST(o_orderdate AS DATE) AS LicenseStartDate,
  CAST(CASE WHEN o_orderkey % 211 = 3 THEN DATE '9999-12-31' WHEN o_orderkey % 223 = 4 THEN NULL ELSE CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) + INTERVAL '1' MONTH
    WHEN 1 THEN CAST(o_orderdate AS DATE) + INTERVAL '3' MONTH
    WHEN 2 THEN CAST(o_orderdate AS DATE) + INTERVAL '12' MONTH
    ELSE CAST(o_orderdate AS DATE) + INTERVAL '24' MONTH END END AS DATE) AS LicenseExpirationDate,
  CAST(CASE WHEN o_orderkey % 199 = 6 THEN -9.5 ELSE (o_orderkey % 5) * 0.02 END AS DECIMAL(5,4)) AS PackageDiscount,
  CAST(o_orderkey % 50 AS INT) AS UserMinimum,
  CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 3
    WHEN o_orderpriority IN ('2-HIGH', '5-LOW') THEN 2 ELSE 1 END AS HeaderChangeID,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS Inactive
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

VIEWS["merged_lines"] = """
SELECT l_orderkey AS PackageID, l_partkey AS ItemID, CAST(sum(l_quantity) AS INT) AS Quantity,
  CAST(max(l_discount) AS DECIMAL(5,4)) AS Discount, CAST(max(l_tax) AS DECIMAL(5,4)) AS LicenseFactor
FROM lineitem GROUP BY l_orderkey, l_partkey"""

VIEWS["detail"] = """
SELECT m.PackageID, m.ItemID, CAST(CASE WHEN (m.PackageID + m.ItemID) % 97 <> 3 THEN p_retailprice END AS DECIMAL(19,4)) AS Price,
  CASE WHEN (m.PackageID + m.ItemID) % 89 <> 4 THEN Quantity END AS Quantity, Discount, LicenseFactor,
  CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND Discount < 0.05 THEN 3
    WHEN o_orderpriority <> '4-NOT SPECIFIED' AND LicenseFactor >= 0.04 THEN 2
    ELSE 1 END AS DetailItemChangeID
FROM merged_lines m JOIN part ON m.ItemID = p_partkey JOIN orders ON m.PackageID = o_orderkey"""

VIEWS["partner"] = """
SELECT o_orderkey AS PackageID, o_custkey - 1 AS ClientPartnerID,
  CAST((o_orderkey % 4) * 0.05 AS DECIMAL(5,4)) AS PartnerSplitPercentage, 1 AS ClientPartnerChangeID
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey > 0"""

VIEWS["note"] = """
SELECT o_orderkey AS PackageID, concat('note ', o_orderpriority) AS Note, 1 AS NoteChangeID
FROM orders WHERE o_orderstatus = 'P'"""

VIEWS["version"] = """
SELECT o_orderkey AS PackageID, 1 AS k FROM orders
UNION ALL
SELECT o_orderkey, 2 FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'
UNION ALL
SELECT o_orderkey, 3 FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')"""

VIEWS["header_log"] = """
SELECT h.PackageID, k AS HeaderChangeID, ClientID, Location, LicenseStartDate, LicenseExpirationDate,
  CASE WHEN k = HeaderChangeID THEN PackageDiscount ELSE CAST(k * 0.01 AS DECIMAL(5,4)) END AS PackageDiscount,
  UserMinimum, CASE WHEN k = HeaderChangeID THEN Inactive ELSE 0 END AS Inactive,
  CASE WHEN k = 1 THEN 'INSERT' ELSE 'UPDATE' END AS Operation
FROM header h JOIN version v ON h.PackageID = v.PackageID"""

VIEWS["detail_log"] = """
SELECT d.PackageID, k AS DetailItemChangeID, ItemID, k AS DetailGroupChangeID, Price, Quantity + k - 1 AS Quantity,
  Discount, LicenseFactor, CASE WHEN k = 1 THEN 'INSERT' ELSE 'UPDATE' END AS Operation
FROM detail d JOIN version v ON d.PackageID = v.PackageID
WHERE k = 1 OR (k = 2 AND LicenseFactor >= 0.04) OR (k = 3 AND Discount < 0.05)
UNION ALL
SELECT o_orderkey, 2, 5, 1, CAST(1 AS DECIMAL(19,4)), 1, CAST(0 AS DECIMAL(5,4)), CAST(0 AS DECIMAL(5,4)), 'DELETE'
FROM orders LEFT JOIN merged_lines m ON o_orderkey = m.PackageID AND m.ItemID = 5
WHERE m.PackageID IS NULL AND o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0"""

VIEWS["partner_log"] = """
SELECT PackageID, ClientPartnerChangeID, ClientPartnerID, PartnerSplitPercentage, 'INSERT' AS Operation FROM partner
UNION ALL
SELECT o_orderkey, 4, o_custkey, CAST(0.05 AS DECIMAL(5,4)), 'DELETE' FROM orders WHERE o_orderpriority = '3-MEDIUM'"""

VIEWS["note_log"] = """
SELECT PackageID, NoteChangeID, Note, 'INSERT' AS Operation, 1 AS LicPackageChangeID, DATE '2019-06-01' AS Updated,
  'loader' AS UpdatedBy
FROM note"""

VIEWS["change_log"] = """
SELECT v.PackageID, k AS ChangeID, k AS HeaderChangeID, k AS DetailGroupChangeID, p.ClientPartnerChangeID,
  n.NoteChangeID, DATE '2019-06-01' AS Updated, 'loader' AS UpdatedBy
FROM version v LEFT JOIN partner p ON v.PackageID = p.PackageID LEFT JOIN note n ON v.PackageID = n.PackageID"""

VIEWS["change_items"] = """
SELECT v.PackageID AS LicensePackageID, v.k AS LicensePackageChangeID, l.ItemID,
  max(l.DetailGroupChangeID) AS LatestDetailGroupChangeID
FROM version v JOIN detail_log l ON v.PackageID = l.PackageID AND l.DetailGroupChangeID <= v.k
GROUP BY v.PackageID, v.k, l.ItemID"""

VIEWS["requests"] = """
SELECT o_orderkey AS request_id, o_orderkey AS PackageID,
  CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 200000 THEN 2 WHEN o_totalprice < 300000 THEN 0
    WHEN o_totalprice < 400000 THEN NULL ELSE 9 END AS ChangeID
FROM orders
UNION ALL
SELECT -1 - c_custkey, -1 - c_custkey, 0 FROM customer"""

VIEWS["renewal_requests"] = """
SELECT o_orderkey AS request_id, o_orderkey AS LicensePackageID, o_orderkey - 1 AS PrevPackageID,
  CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 200000 THEN 2 WHEN o_totalprice < 300000 THEN 0
    WHEN o_totalprice < 400000 THEN NULL ELSE 9 END AS PrevChangeID,
  CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'Y' ELSE 'no' END AS AutofillHeader,
  CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN 'no' ELSE 'YES' END AS AutofillItems,
  CASE WHEN o_totalprice > 250000 THEN 'yes' ELSE '' END AS EditingMode
FROM orders"""

VIEWS["name_searches"] = """
SELECT s_suppkey AS search_id, CASE s_suppkey % 6 WHEN 0 THEN concat('R#', lpad(CAST(s_suppkey AS VARCHAR(9)), 9, '0'))
    WHEN 1 THEN concat('0_', CAST(s_suppkey AS VARCHAR(9)), '%') WHEN 2 THEN concat('[0-4]', CAST(s_suppkey AS VARCHAR(9)))
    WHEN 3 THEN CASE WHEN s_suppkey = 3 THEN ' ' WHEN s_suppkey = 9 THEN NULL ELSE 'none.of these' END
    WHEN 4 THEN CAST(s_suppkey AS VARCHAR(9)) ELSE concat('CUST%[^', CAST(s_suppkey % 10 AS VARCHAR(9)), ']_', CAST(s_suppkey AS VARCHAR(9))) END AS SearchText
FROM supplier"""

VIEWS["expiring_searches"] = """
SELECT s_suppkey AS search_id, CASE s_suppkey % 8 WHEN 7 THEN '' WHEN 6 THEN '1996.05' ELSE concat(CAST(1993 + s_suppkey % 5 AS VARCHAR(4)), '-0', CAST(1 + s_suppkey % 9 AS VARCHAR(1))) END AS StartYM,
  CASE s_suppkey % 7 WHEN 6 THEN NULL ELSE concat(CAST(1994 + s_suppkey % 11 AS VARCHAR(4)), '/1', CAST(s_suppkey % 3 AS VARCHAR(1))) END AS EndYM,
  concat('#%', CAST(s_suppkey AS VARCHAR(9))) AS ClientText, CASE s_suppkey % 3 WHEN 0 THEN 'omer' ELSE '' END AS PartnerText
FROM supplier"""

VIEWS["submissions"] = """
SELECT h.PackageID AS submission_id, h.PackageID, c.ClientName,
  CASE WHEN o_totalprice > 480000 THEN 'Unknown partner' WHEN h.Inactive = 1 THEN ''
    WHEN pc.ClientName IS NOT NULL THEN pc.ClientName WHEN o_orderpriority = '3-MEDIUM' THEN c.ClientName
    ELSE '' END AS ClientPartnerName,
  CASE WHEN o_orderpriority = '5-LOW' THEN Location || ' NORTH' ELSE Location END AS Location,
  CASE WHEN o_totalprice > 400000 THEN UserMinimum + 5 ELSE UserMinimum END AS UserMinimum,
  PackageDiscount, CAST(0.1 AS DECIMAL(5,4)) AS PartnerSplit, LicenseStartDate, LicenseExpirationDate,
  CASE o_orderstatus WHEN 'P' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'NOTE 1-urgent ' WHEN '5-LOW' THEN ''
      ELSE 'renewed' END
    WHEN 'F' THEN 'renewal agreed' ELSE '' END AS Note, 'clerk' AS LoginName
FROM header h JOIN orders ON h.PackageID = o_orderkey JOIN client c ON h.ClientID = c.ClientID
  LEFT JOIN partner p ON h.PackageID = p.PackageID LEFT JOIN client pc ON p.ClientPartnerID = pc.ClientID
UNION ALL
SELECT -1 - ClientID, 0, ClientName, '', 'HEAD OFFICE', 1, CAST(0 AS DECIMAL(5,4)), CAST(0 AS DECIMAL(5,4)),
  DATE '2002-01-01', DATE '2002-12-31', 'first package', 'clerk'
FROM client
UNION ALL
SELECT -1000000000000 - s_suppkey, 0, s_name, '', 'DOCK', 1, CAST(0 AS DECIMAL(5,4)), CAST(0 AS DECIMAL(5,4)),
  DATE '2002-01-01', DATE '2002-12-31', '', 'clerk'
FROM supplier
UNION ALL
SELECT -2000000000000 - o_orderkey, o_orderkey, ClientName, '', 'AGAIN', 1, CAST(0 AS DECIMAL(5,4)), CAST(0 AS DECIMAL(5,4)),
  DATE '2002-01-01', DATE '2002-12-31', '', 'clerk'
FROM orders JOIN client ON o_custkey = ClientID WHERE o_orderkey % 307 = 8"""

VIEWS["submission_lines"] = """
SELECT l_orderkey AS submission_id, l_partkey AS RowNo,
  CASE WHEN l_quantity = 25 AND l_discount = 0.1 THEN concat(ItemName, ' (old)') ELSE ItemName END AS ItemName,
  CASE WHEN l_quantity = 1 AND l_tax = 0 THEN NULL ELSE DefaultPrice END AS ItemPrice,
  CAST(CASE WHEN l_quantity = 50 AND l_discount = 0 THEN 0 WHEN l_tax = 0.08 THEN l_quantity + 1
    ELSE l_quantity END AS INT) AS Quantity,
  CAST(l_discount AS DECIMAL(5,4)) AS ItemDiscount, CAST(l_tax AS DECIMAL(5,4)) AS LicenseFactor
FROM lineitem JOIN item ON l_partkey = ItemID
WHERE l_discount > 0 OR l_quantity = 50
UNION ALL
SELECT o_orderkey, ItemID, ItemName, DefaultPrice, 10, CAST(0 AS DECIMAL(5,4)), CAST(0 AS DECIMAL(5,4))
FROM orders JOIN item ON ItemID = CASE WHEN o_orderpriority = '1-URGENT' THEN 5 END
UNION ALL
SELECT -1 - ClientID, 1, ItemName, DefaultPrice, 10, CAST(0 AS DECIMAL(5,4)), CAST(0 AS DECIMAL(5,4))
FROM client JOIN item ON ClientID = ItemID
UNION ALL
SELECT -1000000000000 - s_suppkey, 1, ItemName, DefaultPrice, 10, CAST(0 AS DECIMAL(5,4)), CAST(0 AS DECIMAL(5,4))
FROM supplier JOIN item ON s_suppkey = ItemID"""

# The second schema: soft deletes and logs of new values.
VIEWS["soft_header"] = """
SELECT PackageID, ClientID, Location, LicenseStartDate, LicenseExpirationDate, PackageDiscount, UserMinimum,
  Inactive, HeaderChangeID AS ChangeID
FROM header"""

VIEWS["soft_detail"] = """
SELECT PackageID, ItemID, Price, Quantity, Discount, LicenseFactor,
  CASE WHEN Discount = 0.09 THEN 1 ELSE 0 END AS Inactive, DetailItemChangeID AS ChangeID
FROM detail"""

VIEWS["soft_partner"] = """
SELECT PackageID, ClientPartnerID, PartnerSplitPercentage,
  CASE WHEN PartnerSplitPercentage = 0.15 THEN 1 ELSE 0 END AS Inactive, ClientPartnerChangeID AS ChangeID
FROM partner"""

VIEWS["soft_note"] = """
SELECT PackageID, Note, CASE WHEN Note = 'note 2-HIGH' THEN 1 ELSE 0 END AS Inactive, NoteChangeID AS ChangeID
FROM note"""

VIEWS["soft_header_log"] = """
SELECT PackageID, HeaderChangeID AS ChangeID, ClientID, Location, LicenseStartDate, LicenseExpirationDate,
  PackageDiscount, UserMinimum, Inactive, Operation
FROM header_log"""

VIEWS["soft_detail_log"] = """
SELECT PackageID, DetailItemChangeID AS ChangeID, ItemID, Price, Quantity, Discount, LicenseFactor, 0 AS Inactive,
  Operation
FROM detail_log"""

VIEWS["soft_partner_log"] = """
SELECT PackageID, ChangeID, ClientPartnerID, PartnerSplitPercentage, Inactive, 'INSERT' AS Operation
FROM soft_partner"""

VIEWS["soft_note_log"] = """
SELECT PackageID, ChangeID, Note, 'INSERT' AS Operation, Inactive FROM soft_note"""

VIEWS["soft_change_log"] = """
SELECT PackageID, ChangeID, HeaderChangeID, ClientPartnerChangeID, NoteChangeID, Updated, UpdatedBy FROM change_log"""


def needed_views(sql: str, views: dict[str, str] | None = None) -> list[str]:
    """Names of the views a statement reads, directly or through other views, in view order."""
    views = VIEWS if views is None else views
    pattern = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)", re.IGNORECASE)
    found: set[str] = set()
    pending = [sql]
    while pending:
        for name in pattern.findall(pending.pop()):
            if name in views and name not in found:
                found.add(name)
                pending.append(views[name])
    return [name for name in views if name in found]


def with_views(sql: str, before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> str:
    """The statement behind a WITH clause of the views it reads, from `before`, VIEWS and `after`."""
    views = {**(before or {}), **VIEWS, **(after or {})}
    ctes = [f"{name} AS ({views[name].strip()})" for name in needed_views(sql, views)]
    return f"WITH {', '.join(ctes)} {sql}" if ctes else sql


class StarSource:
    """Reads the star schema of one directory and derives billing tables from it, each when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune_session(spark)
        self._sf_dir = sf_dir
        self._base: dict[str, str] = {}
        self._bytes = 0
        self._views: dict[str, DataFrame] = {}

    def _read_base(self, name: str) -> None:
        """Name a base table for SQL and fit the number of shuffle partitions to the bytes read."""
        table = self.spark.read.parquet(f"{self._sf_dir}/{name}.parquet")
        view = f"star_{uuid.uuid4().hex}_{name}"
        table.createOrReplaceTempView(view)
        self._base[name] = f"SELECT * FROM {view}"
        self._bytes += plan_bytes(table)
        size_shuffles(self.spark, self._bytes)

    def query(self, sql: str) -> DataFrame:
        for name in needed_views(sql, {**VIEWS, **dict.fromkeys(BASE_TABLES, "")}):
            if name in BASE_TABLES and name not in self._base:
                self._read_base(name)
        return self.spark.sql(with_views(sql, self._base))

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            self._views[name] = self.query(f"SELECT * FROM {name}")
        return self._views[name]

    def keep(self, name: str, rows: DataFrame) -> None:
        """Take `rows` for a view from now on, such as its rows written to a file."""
        self._views[name] = rows

    def tables(self) -> BillingTables:
        return _LazyTables(self, "")

    def soft_tables(self) -> SoftTables:
        return _LazyTables(self, "soft_")


class _LazyTables:
    """Stands in for BillingTables or SoftTables; a table is planned when it is asked for."""

    def __init__(self, source: StarSource, prefix: str):
        self._source, self._prefix = source, prefix

    def __getattr__(self, name: str) -> DataFrame:
        return self._source.view(self._prefix + name)
