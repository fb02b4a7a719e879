"""Reports on packages that expire in a range of months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasebook.functions.dates import month_diff, read_date_range
from leasebook.functions.joins import lookup_join
from leasebook.functions.money import COST
from leasebook.functions.text import is_blank
from leasebook.model import BASE_ITEM_ID, BillingTables
from leasebook.operators.costs import package_summary, term_cost
from leasebook.operators.shared import named_partners, with_client

# Notices for unreadable dates.
BAD_START = "the start date filter entered could not be interpreted"
BAD_END = "the end date filter entered could not be interpreted"

NO_CLIENT = -(2**63)  # groups packages without a client


def _in_range(header: DataFrame, start, end) -> DataFrame:
    """Both bounds or no date filter. A year-month bound is the first of its month."""
    if start is None or end is None:
        return header
    return header.where(F.col("LicenseExpirationDate").between(F.lit(start), F.lit(end)))


def _read_range(start_ym: str, end_ym: str):
    return read_date_range([(start_ym, BAD_START), (end_ym, BAD_END)])


def expiring_finder(t: BillingTables, start_ym: str = "", end_ym: str = "", client_text: str = "",
                    partner_text: str = "", base_item_id: int = BASE_ITEM_ID, sort: bool = True) -> DataFrame:
    """Packages expiring in the range with client, partner, users, term and renewal cost."""
    start, end = _read_range(start_ym, end_ym)
    header = _in_range(t.header, start, end)
    named = with_client(header, t.client, ["ClientName", "BillingContactName", "BillingEmail"], client_text)
    rows = (
        named.join(named_partners(t.partner, t.client, partner_text), "PackageID",
                   "left" if is_blank(partner_text) else "inner")
        .join(package_summary(t.detail, base_item_id), "PackageID", "left")
        .select(
            "ClientName", "ClientPartnerName", "Location", "BillingContactName", "BillingEmail", "PackageID",
            F.coalesce("LicensedUsers", F.lit(0)).alias("LicensedUsers"), "UserMinimum", "BasePrice",
            "LicenseStartDate", "LicenseExpirationDate",
            month_diff(F.col("LicenseStartDate"), F.col("LicenseExpirationDate")).alias("DurationMonths"),
            F.coalesce(term_cost(), F.lit(0).cast(COST)).alias("CalculatedRenewalCost"),
        )
    )
    # PackageID breaks ties, so one very frequent date does not end in a single sort partition.
    return rows.orderBy("LicenseExpirationDate", "PackageID") if sort else rows


def expiring_client_info(t: BillingTables, start_ym: str = "", end_ym: str = "", partner_text: str = "",
                         sort: bool = True) -> DataFrame:
    """Clients and locations with packages expiring in the range, one row per expiry date."""
    start, end = _read_range(start_ym, end_ym)
    header = _in_range(t.header, start, end).select("PackageID", "ClientID", "Location", "LicenseExpirationDate")
    groups = (
        header.join(named_partners(t.partner, t.client, partner_text), "PackageID",
                    "left" if is_blank(partner_text) else "inner")
        .drop("PackageID")
        .distinct()
    )
    rows = with_client(groups, t.client, ["ClientName", "BillingContactName", "BillingEmail"],
                       spread_by=["Location", "LicenseExpirationDate", "ClientPartnerName"])
    if sort:
        rows = rows.orderBy("LicenseExpirationDate", "ClientID", "Location", "ClientPartnerName")
    return rows.select(
        F.concat(F.col("ClientID").cast("string"), F.lit("-"), F.col("Location")).alias("ClientLocationKey"),
        "ClientName", "ClientPartnerName", "Location", "BillingContactName", "BillingEmail",
    )


def expiring_package_info(t: BillingTables, start_ym: str = "", end_ym: str = "", partner_text: str = "",
                          base_item_id: int = BASE_ITEM_ID, sort: bool = True) -> DataFrame:
    """Earlier package report, ordered by each client's latest expiry.

    As first written, a blank partner text also switches the date filter off.
    """
    start, end = _read_range(start_ym, end_ym)
    header = t.header
    if not is_blank(partner_text):
        header = _in_range(header, start, end).join(
            named_partners(t.partner, t.client, partner_text).select("PackageID"), "PackageID", "left_semi"
        )
    rows = header.join(package_summary(t.detail, base_item_id), "PackageID", "left")
    if sort:
        # The latest expiry per client is grouped and joined back rather than taken over a
        # window, because a window would hold all packages of the largest client in one task.
        client_key = F.coalesce("ClientID", F.lit(NO_CLIENT)).alias("_client")
        latest = header.groupBy(client_key).agg(F.max("LicenseExpirationDate").alias("_latest"))
        rows = lookup_join(rows.select("*", client_key), latest, ["_client"], ["PackageID"])
        rows = rows.orderBy(F.desc("_latest"), "ClientID", F.desc("LicenseExpirationDate"), "PackageID")
    return rows.select(
        F.concat(F.col("ClientID").cast("string"), F.lit("-"), F.col("Location")).alias("ClientLocationKey"),
        "PackageID", F.coalesce("LicensedUsers", F.lit(0)).alias("LicensedUsers"), "UserMinimum", "BasePrice",
        "LicenseStartDate", "LicenseExpirationDate",
        month_diff(F.col("LicenseStartDate"), F.col("LicenseExpirationDate")).alias("DurationMonths"),
        F.coalesce(term_cost(), F.lit(0).cast(COST)).alias("CalculatedRenewalCost"),
    )
