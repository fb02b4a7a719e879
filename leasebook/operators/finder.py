"""Search over current packages and over every logged version."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasebook.functions.dates import add_years, month_diff, read_date_range
from leasebook.functions.text import is_blank, where_text, yes_no_arg
from leasebook.model import BASE_ITEM_ID, BillingTables
from leasebook.operators.costs import history_cost, history_cost_v0, package_summary, term_cost, version_cost
from leasebook.operators.shared import base_item_rows, named_partners, with_client
from leasebook.sources.staging import stage

# Notices, provenance and status texts, sort order.
BAD_DATES = [
    "date entered as FROM date on Start date range filter could not be interpreted",
    "date entered as TO date in the Start date range filter could not be interpreted",
    "date entered as FROM date in the Expiration date range filter could not be interpreted",
    "date entered as TO date in the Expiration date range filter could not be interpreted",
]
CURRENT_TEXT = "Current Version"
HISTORY_TEXT = "Previous version from cache"
SORT_KEYS = ["ClientName", "ClientPartnerName", "Location", "PackageID", "ChangeID"]

VERSION_KEY = ["PackageID", "HeaderChangeID"]


@dataclass(frozen=True)
class FinderSearch:
    """The search form. Blank fields do not restrict the result."""

    client_text: str = ""
    partner_text: str = ""
    location_text: str = ""
    start_from: str = ""
    start_to: str = ""
    end_from: str = ""
    end_to: str = ""
    note_text: str = ""
    history: str = ""
    inactive: str = ""
    base_item_id: int = BASE_ITEM_ID
    as_of: dt.date | None = None
    open_years: int | None = None  # as first written 100: a missing bound is so many years from the day of the search

    def dates(self) -> list[dt.date | None]:
        texts = [self.start_from, self.start_to, self.end_from, self.end_to]
        return read_date_range(list(zip(texts, BAD_DATES)))

    def bounds(self) -> list[dt.date | None]:
        """The dates; a missing one bounds nothing, unless `open_years` is set."""
        if self.open_years is None:
            return self.dates()
        today = self.as_of or dt.date.today()
        spans = [-self.open_years, self.open_years] * 2
        return [d or add_years(today, y) for d, y in zip(self.dates(), spans)]


def _where_header(header: DataFrame, s: FinderSearch) -> DataFrame:
    """The filters on header columns, applied at the scan."""
    rows = where_text(header, "Location", s.location_text)
    columns = ["LicenseStartDate", "LicenseStartDate", "LicenseExpirationDate", "LicenseExpirationDate"]
    for place, (column, day) in enumerate(zip(columns, s.bounds())):
        if day:
            rows = rows.where(F.col(column) <= F.lit(day) if place % 2 else F.col(column) >= F.lit(day))
    return rows if yes_no_arg(s.inactive) else rows.where("Inactive = 0")


def _where_header_v0(header: DataFrame, s: FinderSearch) -> DataFrame:
    """Earlier rule: a range applies only with both bounds; rows without a location drop out."""
    a, b, c, d = s.dates()
    rows = where_text(header, "Location", s.location_text).where("Location IS NOT NULL")
    if a and b:
        rows = rows.where(F.col("LicenseStartDate").between(F.lit(a), F.lit(b)))
    if c and d:
        rows = rows.where(F.col("LicenseExpirationDate").between(F.lit(c), F.lit(d)))
    return rows if yes_no_arg(s.inactive) else rows.where("Inactive = 0")


def _how(text: str) -> str:
    return "left" if is_blank(text) else "inner"


def _report(rows: DataFrame, source: str) -> DataFrame:
    return rows.select(
        "ClientName", "ClientPartnerName", "Location", "PackageID", "LicensedUsers", "UserMinimum", "BasePrice",
        "LicenseStartDate", "LicenseExpirationDate",
        month_diff(F.col("LicenseStartDate"), F.col("LicenseExpirationDate")).alias("DurationMonths"),
        "TotalPackageCost",
        F.when(F.col("Inactive") == 1, "Inactive").otherwise("Active").alias("Status"),
        F.lit(source).alias("FromCacheOrCurrentText"), "ChangeID", "Note",
    )


def _current_rows(t: BillingTables, header: DataFrame, s: FinderSearch) -> DataFrame:
    """Joins of current packages. All are on PackageID, so each table is shuffled once."""
    notes = where_text(t.note, "Note", s.note_text).select("PackageID", "Note")
    return (
        header.join(named_partners(t.partner, t.client, s.partner_text), "PackageID", _how(s.partner_text))
        .join(notes, "PackageID", _how(s.note_text))
        .join(package_summary(t.detail, s.base_item_id), "PackageID", "left")
        .withColumn("TotalPackageCost", term_cost())
    )


def finder_current(t: BillingTables, s: FinderSearch = FinderSearch(), sort: bool = True) -> DataFrame:
    """Current packages that have at least one version, with their latest ChangeID."""
    header = with_client(_where_header(t.header, s), t.client, ["ClientName"], s.client_text)
    latest = t.change_log.groupBy("PackageID").agg(F.max("ChangeID").alias("ChangeID"))
    rows = _report(_current_rows(t, header.join(latest, "PackageID"), s), CURRENT_TEXT)
    return rows.orderBy(*SORT_KEYS) if sort else rows


def _history_rows(t: BillingTables, versions: DataFrame, s: FinderSearch, costs: DataFrame,
                  cost_keys: list[str]) -> DataFrame:
    """Join the parts of each version by their version ids.

    Each join is hashed on PackageID together with a version id, so that a package with very
    many versions is spread over all partitions.
    """
    base = base_item_rows(t.detail_log, s.base_item_id, ["PackageID", "DetailGroupChangeID"])
    partners = named_partners(t.partner_log, t.client, s.partner_text, ["PackageID", "ClientPartnerChangeID"])
    notes = where_text(t.note_log, "Note", s.note_text).select(
        "PackageID", F.col("LicPackageChangeID").alias("ChangeID"), "Note"
    )
    return (
        versions.join(base, ["PackageID", "DetailGroupChangeID"], "left")
        .join(partners, ["PackageID", "ClientPartnerChangeID"], _how(s.partner_text))
        .join(notes, ["PackageID", "ChangeID"], _how(s.note_text))
        .join(costs, cost_keys, "left")
    )


def _versions(t: BillingTables, header_log: DataFrame) -> DataFrame:
    ids = t.change_log.select("PackageID", "ChangeID", "HeaderChangeID", "DetailGroupChangeID",
                              "ClientPartnerChangeID")
    return header_log.join(ids, ["PackageID", "HeaderChangeID"])


def finder_history(t: BillingTables, s: FinderSearch = FinderSearch(), by_version_cost: bool = True,
                   sort: bool = True) -> DataFrame:
    """One row per logged version; base item and note show only in the version that set them.

    The cost is that of the version. As first written (`by_version_cost=False`) it comes from
    `history_cost`, whose rows a version meets on PackageID alone, so that a version repeats
    once per distinct cost of its package. Costs, and rows before they are sorted, are staged: the
    shuffles of a step are gone before the next one begins.
    """
    header_log = with_client(_where_header(t.header_log, s), t.client, ["ClientName"], s.client_text, VERSION_KEY)
    if by_version_cost:
        costs = stage(version_cost(t.change_log, t.change_items, t.detail_log, t.header_log))
        keys = ["PackageID", "ChangeID"]
    else:
        costs = history_cost(t.detail_log, t.header_log).select("PackageID", "TotalPackageCost").distinct()
        keys = ["PackageID"]
    rows = stage(_report(_history_rows(t, _versions(t, header_log), s, costs, keys), HISTORY_TEXT).distinct())
    return rows.orderBy(*SORT_KEYS) if sort else rows


def finder_all(t: BillingTables, s: FinderSearch = FinderSearch(), by_version_cost: bool = True,
               sort: bool = True) -> DataFrame:
    """Current packages and, when history is asked for, their versions.

    The provenance text differs between the two, so rows can only repeat within the history.
    """
    rows = finder_current(t, s, sort=False)
    if yes_no_arg(s.history):
        rows = rows.unionByName(finder_history(t, s, by_version_cost, sort=False))
    return rows.orderBy(*SORT_KEYS) if sort else rows


def finder_v0(t: BillingTables, s: FinderSearch = FinderSearch(), sort: bool = True) -> DataFrame:
    """The superseded finder: current rows carry ChangeID 0, unnamed clients drop out."""
    client = t.client.where("ClientName IS NOT NULL")

    def headers(rows: DataFrame) -> DataFrame:
        spread_by = [c for c in VERSION_KEY if c in rows.columns]
        named = with_client(_where_header_v0(rows, s), client, ["ClientName"], s.client_text, spread_by)
        return named.where("ClientName IS NOT NULL")

    current = _report(_current_rows(t, headers(t.header), s).withColumn("ChangeID", F.lit(0)), CURRENT_TEXT)
    rows = current.distinct()
    if yes_no_arg(s.history):
        versions = _versions(t, headers(t.header_log)).where("ChangeID <> 0")
        costs = history_cost_v0(t.detail_log, t.header_log)
        history = _report(_history_rows(t, versions, s, costs, ["PackageID"]), HISTORY_TEXT)
        rows = current.unionByName(history).distinct()
    return rows.orderBy(*SORT_KEYS) if sort else rows
