"""The billing data model: one DataFrame per table, keyed as the comments say."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Fixed value: the item whose quantity is the number of licensed users.
BASE_ITEM_ID = 5

MONEY = "decimal(19,4)"
RATE = "decimal(5,4)"


@dataclass(frozen=True)
class BillingTables:
    """Current state, append-only logs and the two dimensions."""

    client: DataFrame  # ClientID
    item: DataFrame  # ItemID
    item_log: DataFrame  # ItemChangeID
    header: DataFrame  # PackageID
    detail: DataFrame  # PackageID, ItemID
    partner: DataFrame  # PackageID (0-1 rows each)
    note: DataFrame  # PackageID (0-1 rows each)
    header_log: DataFrame  # PackageID, HeaderChangeID
    detail_log: DataFrame  # PackageID, ItemID, DetailGroupChangeID
    partner_log: DataFrame  # PackageID, ClientPartnerChangeID
    note_log: DataFrame  # PackageID, NoteChangeID
    change_log: DataFrame  # PackageID, ChangeID
    change_items: DataFrame  # LicensePackageID, LicensePackageChangeID, ItemID


@dataclass(frozen=True)
class SoftTables:
    """The second schema: rows carry Inactive and ChangeID, logs hold the new values."""

    header: DataFrame
    detail: DataFrame
    partner: DataFrame
    note: DataFrame
    header_log: DataFrame
    detail_log: DataFrame
    partner_log: DataFrame
    note_log: DataFrame
    change_log: DataFrame


# Column order of each current-state and log table, used by the writers.
COLUMNS = {
    "header": ["PackageID", "ClientID", "Location", "LicenseStartDate", "LicenseExpirationDate",
               "PackageDiscount", "UserMinimum", "HeaderChangeID", "Inactive"],
    "detail": ["PackageID", "ItemID", "Price", "Quantity", "Discount", "LicenseFactor",
               "DetailItemChangeID"],
    "partner": ["PackageID", "ClientPartnerID", "PartnerSplitPercentage", "ClientPartnerChangeID"],
    "note": ["PackageID", "Note", "NoteChangeID"],
    "header_log": ["PackageID", "HeaderChangeID", "ClientID", "Location", "LicenseStartDate",
                   "LicenseExpirationDate", "PackageDiscount", "UserMinimum", "Inactive", "Operation"],
    "detail_log": ["PackageID", "DetailItemChangeID", "ItemID", "DetailGroupChangeID", "Price",
                   "Quantity", "Discount", "LicenseFactor", "Operation"],
    "partner_log": ["PackageID", "ClientPartnerChangeID", "ClientPartnerID",
                    "PartnerSplitPercentage", "Operation"],
    "note_log": ["PackageID", "NoteChangeID", "Note", "Operation", "LicPackageChangeID", "Updated",
                 "UpdatedBy"],
    "change_log": ["PackageID", "ChangeID", "HeaderChangeID", "DetailGroupChangeID",
                   "ClientPartnerChangeID", "NoteChangeID", "Updated", "UpdatedBy"],
    "change_items": ["LicensePackageID", "LicensePackageChangeID", "ItemID",
                     "LatestDetailGroupChangeID"],
}
_HEADER_VALUES = ["ClientID", "Location", "LicenseStartDate", "LicenseExpirationDate", "PackageDiscount", "UserMinimum"]
SOFT_COLUMNS = {
    "header": ["PackageID", *_HEADER_VALUES, "Inactive", "ChangeID"],
    "detail": ["PackageID", "ItemID", "Price", "Quantity", "Discount", "LicenseFactor", "Inactive", "ChangeID"],
    "partner": ["PackageID", "ClientPartnerID", "PartnerSplitPercentage", "Inactive", "ChangeID"],
    "note": ["PackageID", "Note", "Inactive", "ChangeID"],
    "header_log": ["PackageID", "ChangeID", *_HEADER_VALUES, "Inactive", "Operation"],
    "detail_log": ["PackageID", "ChangeID", "ItemID", "Price", "Quantity", "Discount", "LicenseFactor", "Inactive", "Operation"],
    "partner_log": ["PackageID", "ChangeID", "ClientPartnerID", "PartnerSplitPercentage", "Inactive", "Operation"],
    "note_log": ["PackageID", "ChangeID", "Note", "Operation", "Inactive"],
    "change_log": ["PackageID", "ChangeID", "HeaderChangeID", "ClientPartnerChangeID", "NoteChangeID", "Updated", "UpdatedBy"],
}
CURRENT_TABLES = ["header", "detail", "partner", "note"]
LOG_TABLES = ["header_log", "detail_log", "partner_log", "note_log", "change_log", "change_items"]
DIMENSION_TABLES = ["client", "item", "item_log"]
