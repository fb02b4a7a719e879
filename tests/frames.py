"""A small hand-made set of billing tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from leasebook.model import BillingTables

D = Decimal
JAN1, DEC31 = dt.date(2019, 1, 1), dt.date(2019, 12, 31)

SCHEMAS = {
    "client": "ClientID bigint, ClientName string, BillingContactName string, BillingEmail string,"
              " BillingAddress1 string, BillingPhoneNumber string",
    "item": "ItemID bigint, ItemName string, DefaultPrice decimal(19,4), ItemChangeID bigint",
    "item_log": "ItemChangeID bigint, Updated date",
    "header": "PackageID bigint, ClientID bigint, Location string, LicenseStartDate date, LicenseExpirationDate date,"
              " PackageDiscount decimal(5,4), UserMinimum int, HeaderChangeID int, Inactive int",
    "detail": "PackageID bigint, ItemID bigint, Price decimal(19,4), Quantity int, Discount decimal(5,4),"
              " LicenseFactor decimal(5,4), DetailItemChangeID int",
    "partner": "PackageID bigint, ClientPartnerID bigint, PartnerSplitPercentage decimal(5,4), ClientPartnerChangeID int",
    "note": "PackageID bigint, Note string, NoteChangeID int",
    "header_log": "PackageID bigint, HeaderChangeID int, ClientID bigint, Location string, LicenseStartDate date,"
                  " LicenseExpirationDate date, PackageDiscount decimal(5,4), UserMinimum int, Inactive int, Operation string",
    "detail_log": "PackageID bigint, DetailItemChangeID int, ItemID bigint, DetailGroupChangeID int,"
                  " Price decimal(19,4), Quantity int, Discount decimal(5,4), LicenseFactor decimal(5,4), Operation string",
    "partner_log": "PackageID bigint, ClientPartnerChangeID int, ClientPartnerID bigint,"
                   " PartnerSplitPercentage decimal(5,4), Operation string",
    "note_log": "PackageID bigint, NoteChangeID int, Note string, Operation string, LicPackageChangeID int,"
                " Updated date, UpdatedBy string",
    "change_log": "PackageID bigint, ChangeID int, HeaderChangeID int, DetailGroupChangeID int,"
                  " ClientPartnerChangeID int, NoteChangeID int, Updated date, UpdatedBy string",
    "change_items": "LicensePackageID bigint, LicensePackageChangeID int, ItemID bigint, LatestDetailGroupChangeID int",
}
SUBMISSION = ("submission_id bigint, PackageID bigint, ClientName string, ClientPartnerName string, Location string,"
              " UserMinimum int, PackageDiscount decimal(5,4), PartnerSplit decimal(5,4), LicenseStartDate date,"
              " LicenseExpirationDate date, Note string, LoginName string")
LINE = ("submission_id bigint, RowNo int, ItemName string, ItemPrice decimal(19,4), Quantity int,"
        " ItemDiscount decimal(5,4), LicenseFactor decimal(5,4)")

ROWS = {
    "client": [(1, "Acme", "Ann", "ann@acme", "1 Main St", "555"), (2, "Bolt", "Bob", "bob@bolt", "2 Main St", "556"),
               (300, "Core", "Cy", "cy@core", "3 Main St", "557")],
    "item": [(5, "Base", D(10), 1), (6, "Reports", D(20), 2), (7, "50%_[x]", D(30), 3)],
    "item_log": [(1, dt.date(2019, 6, 1))],
    "header": [(10, 1, "North", JAN1, DEC31, D("0.1"), 5, 1, 0), (11, 2, None, dt.date(2019, 10, 31), dt.date(2020, 1, 31), D(0), 1, 2, 1)],
    "detail": [(10, 5, D(10), 2, D(0), D("0.05"), 1), (10, 6, D(20), 1, D("0.5"), D(0), 1), (11, 6, None, 3, D(0), D(0), 1)],
    "partner": [(10, 2, D("0.2"), 1)],
    "note": [(10, "first", 1)],
    "header_log": [(10, 1, 1, "North", JAN1, DEC31, D("0.1"), 5, 0, "INSERT"),
                   (11, 1, 2, None, JAN1, dt.date(2019, 10, 30), D(0), 1, 0, "INSERT"),
                   (11, 2, 2, None, dt.date(2019, 10, 31), dt.date(2020, 1, 31), D(0), 1, 0, "UPDATE")],
    "detail_log": [(10, 1, 5, 1, D(10), 2, D(0), D("0.05"), "INSERT"), (10, 1, 6, 1, D(20), 1, D("0.5"), D(0), "INSERT"),
                   (11, 1, 6, 1, None, 3, D(0), D(0), "INSERT"), (11, 1, 7, 1, D(30), 1, D(0), D(0), "INSERT"),
                   (11, 2, 7, 2, D(30), 1, D(0), D(0), "DELETE")],
    "partner_log": [(10, 1, 2, D("0.2"), "INSERT")],
    "note_log": [(10, 1, "first", "INSERT", 1, JAN1, "x")],
    "change_log": [(10, 1, 1, 1, 1, 1, JAN1, "x"), (11, 1, 1, 1, None, None, JAN1, "x"), (11, 2, 2, 2, None, None, JAN1, "x")],
    "change_items": [(10, 1, 5, 1), (10, 1, 6, 1), (11, 1, 6, 1), (11, 1, 7, 1), (11, 2, 6, 1), (11, 2, 7, 1)],
}


def tables(spark, **changes) -> BillingTables:
    rows = {**ROWS, **changes}
    return BillingTables(**{n: spark.createDataFrame(rows[n], s) for n, s in SCHEMAS.items()})


def submission(sid, package, client="Acme", partner="Bolt", location="North", minimum=5, discount=D("0.1"),
               split=D("0.2"), start=JAN1, end=DEC31, note="first", login="me"):
    return (sid, package, client, partner, location, minimum, discount, split, start, end, note, login)


def same_lines(sid=1):
    """The lines of package 10 as they are."""
    return [(sid, 1, "Base", D(10), 2, D(0), D("0.05")), (sid, 2, "Reports", D(20), 1, D("0.5"), D(0))]


def batch(spark, submissions, lines):
    return spark.createDataFrame(submissions, SUBMISSION), spark.createDataFrame(lines, LINE)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)
