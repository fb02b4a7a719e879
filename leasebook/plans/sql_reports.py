"""Reports and rules as SQL functions of a session, for users who call them from SQL.

`register_reports` makes temporary views of the reports over all packages and table functions that filter them. A function
is a part of the statement that calls it, so its filters reach the scans, as those of the DataFrame reports do.

    SELECT * FROM expiring_packages('2020/01', '2020-12', partner_text => 'bolt')
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasebook.functions.dates import DATE_FORM_HINT
from leasebook.functions.text import YES_TEXTS
from leasebook.model import BASE_ITEM_ID, BillingTables
from leasebook.operators import versions
from leasebook.operators.expiring import BAD_END, BAD_START, expiring_finder

_YES = ", ".join(f"'{text}'" for text in YES_TEXTS)

# name: (arguments, result type, body)
RULES = {
    "month_difference": ("start_day DATE, end_day DATE", "INT",
                         "CAST((year(end_day) - year(start_day)) * 12 + month(end_day) - month(start_day) AS INT)"),
    "year_month": ("text STRING", "DATE", "CAST(try_to_date(concat(substring(text, 1, 4), substring(text, 6, 2), '01'), 'yyyyMMdd') AS DATE)"),
    "year_month_error": ("text STRING", "BOOLEAN",
                         "coalesce(length(rtrim(text)) > 0 AND (substring(text, 5, 1) NOT IN ('-', '/') OR year_month(text) IS NULL), false)"),
    "is_yes": ("text STRING", "BOOLEAN", f"coalesce(lower(rtrim(text)) IN ({_YES}), false)"),
    "is_blank": ("text STRING", "BOOLEAN", "coalesce(rtrim(text) = '', true)"),
    # In a search text % _ [set] [^set] are wildcards; all else stands for itself.
    "search_pattern": ("text STRING", "STRING", r"""concat('(?s)', array_join(transform(
        regexp_extract_all(lower(text), r'(?s)\[[^\]]+\]|.', 0),
        c -> CASE WHEN c = '%' THEN '.*' WHEN c = '_' THEN '.' WHEN char_length(c) > 3 AND startswith(c, '[^')
            THEN concat('[^', regexp_replace(substring(c, 3, char_length(c) - 3), r'([\\\[\]^&])', r'\\$1'), ']')
          WHEN char_length(c) > 1 THEN concat('[', regexp_replace(substring(c, 2, char_length(c) - 2), r'([\\\[\]^&])', r'\\$1'), ']')
          ELSE concat(r'\Q', c, r'\E') END), ''))"""),
    "contains_text": ("value STRING, text STRING", "BOOLEAN", "is_blank(text) OR coalesce(regexp_like(lower(value), search_pattern(text)), false)"),
}

_RANGE = "start_month STRING DEFAULT '', end_month STRING DEFAULT ''"
_BAD_RANGE = (f"concat(concat_ws(', ', CASE WHEN year_month_error(start_month) THEN '{BAD_START}' END,"
              f" CASE WHEN year_month_error(end_month) THEN '{BAD_END}' END), '{DATE_FORM_HINT}')")
_IN_RANGE = (f"CASE WHEN year_month_error(start_month) OR year_month_error(end_month) THEN CAST(raise_error({_BAD_RANGE}) AS BOOLEAN)"
             " ELSE true END AND (year_month(start_month) IS NULL OR year_month(end_month) IS NULL"
             " OR LicenseExpirationDate BETWEEN year_month(start_month) AND year_month(end_month))")


def register_rules(spark: SparkSession) -> None:
    """Month difference, year-month, yes/no and search texts as SQL functions."""
    for name, (arguments, kind, body) in RULES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")


def _table_function(name: str, arguments: str, rows: DataFrame, where: str, shown: list[str] | None = None) -> None:
    spark, view = rows.sparkSession, f"{name}_rows"
    rows.createOrReplaceTempView(view)
    fields = [f for f in rows.schema if shown is None or f.name in shown]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    names = ", ".join(f"`{f.name}`" for f in fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN SELECT {names} FROM {view} WHERE {where}")


def _every_version(t: BillingTables) -> DataFrame:
    """One request for each package as it is and one for each of its versions."""
    current = t.header.select("PackageID", F.lit(None).cast("long").alias("ChangeID"))
    versions_ = t.change_log.where("ChangeID <> 0").select("PackageID", F.col("ChangeID").cast("long").alias("ChangeID"))
    asked = current.unionByName(versions_)
    return asked.select(F.struct("PackageID", "ChangeID").alias("request_id"), "PackageID", "ChangeID")


def register_reports(spark: SparkSession, t: BillingTables, base_item_id: int = BASE_ITEM_ID) -> None:
    """The rules, and these table functions over `t`:

    expiring_packages(start_month, end_month, client_text, partner_text), expiring_clients(start_month, end_month, partner_text),
    package_view(package, change) for the head of a package or of one of its versions, and package_lines(package, change) for
    its items. Unreadable months raise the notice of the reports; an unknown package or version gives no rows.
    """
    register_rules(spark)
    packages = expiring_finder(t, base_item_id=base_item_id, sort=False)
    by_client, by_partner = "contains_text(ClientName, client_text)", "contains_text(ClientPartnerName, partner_text)"
    texts = "client_text STRING DEFAULT '', partner_text STRING DEFAULT ''"
    _table_function("expiring_packages", f"{_RANGE}, {texts}", packages, f"{_IN_RANGE} AND {by_client} AND {by_partner}")
    clients = packages.join(t.header.select("PackageID", F.col("ClientID")), "PackageID").select(
        F.concat(F.col("ClientID").cast("string"), F.lit("-"), F.col("Location")).alias("ClientLocationKey"), "ClientID",
        "ClientName", "ClientPartnerName", "Location", "BillingContactName", "BillingEmail", "LicenseExpirationDate")
    shown = [c for c in clients.columns if c not in ("ClientID", "LicenseExpirationDate")]
    # One row an expiry date, as in the report.
    clients = clients.distinct()
    _table_function("expiring_clients", f"{_RANGE}, partner_text STRING DEFAULT ''", clients, f"{_IN_RANGE} AND {by_partner}", shown)
    asked = _every_version(t)
    wanted = "request_id.PackageID = package AND request_id.ChangeID <=> nullif(change, 0)"
    for name, rows in (("package_view", versions.viewer_header(asked, t)), ("package_lines", versions.viewer_items(asked, t))):
        _table_function(name, "package BIGINT, change BIGINT DEFAULT 0", rows, wanted, [c for c in rows.columns if c != "request_id"])
