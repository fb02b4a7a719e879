"""Reports over a table of requests, each naming a package and optionally a version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasebook.functions.dates import month_diff
from leasebook.functions.joins import lookup_join
from leasebook.functions.money import UNIT, renewal_item_price
from leasebook.functions.text import yes_no
from leasebook.model import BASE_ITEM_ID, BillingTables
from leasebook.operators.padding import pad_blank_rows
from leasebook.operators.shared import base_item_rows, named_partners, with_client

# Notices for requests that cannot be answered.
NOT_FOUND = ("Previous license package ID entered (\"", "\") does not exist."
             " Please search for an existing package using the LicensePackageFinder and try again.")
NO_VERSION = ("Previous license package ID entered (\"", "\") does not have a history entry #",
              ". Please use the LicensePackageFinder to search for a valid ChangeID for this Package.")

PART_IDS = ["HeaderChangeID", "DetailGroupChangeID", "ClientPartnerChangeID"]
ITEM_VALUES = ["ItemPrice", "Quantity", "ItemDiscount", "LicenseFactor"]


def _with_version(requests: DataFrame, change_log: DataFrame, package: str = "PackageID",
                  change: str = "ChangeID") -> DataFrame:
    """Add the version's part ids; `_in_history` tells whether the request names a version."""
    versions = change_log.where("ChangeID <> 0").select(
        F.col("PackageID").alias(package), F.col("ChangeID").alias(change), *PART_IDS, F.lit(True).alias("_found")
    )
    return (
        requests.join(versions, [package, change], "left")
        .withColumn("_in_history", F.coalesce("_found", F.lit(False)))
        .drop("_found")
    )


def _answerable(requests: DataFrame, t: BillingTables) -> tuple[DataFrame, DataFrame]:
    """Requests answered from a version and from current state; those in error are in neither.

    The package must exist, except for id 0, which is never reported missing.
    """
    packages = t.header.select("PackageID", F.lit(True).alias("_package"))
    routed = (
        _with_version(requests.select("request_id", "PackageID", "ChangeID"), t.change_log)
        .join(packages, "PackageID", "left")
        .where("_package OR PackageID = 0")
        .drop("_package")
    )
    return routed.where("_in_history"), routed.where("NOT _in_history AND (ChangeID IS NULL OR ChangeID = 0)")


def _term():
    return month_diff(F.col("LicenseStartDate"), F.col("LicenseExpirationDate"))


def request_errors(requests: DataFrame, t: BillingTables) -> DataFrame:
    """The requests that cannot be answered, with the notice for the user.

    A missing package is reported first; a request without ChangeID is never wrong.
    """
    packages = t.header.select("PackageID", F.lit(True).alias("_package"))
    versions = t.change_log.select("PackageID", "ChangeID", F.lit(True).alias("_version"))
    package, change = F.col("PackageID").cast("string"), F.col("ChangeID").cast("string")
    no_package = F.col("_package").isNull() & (F.col("PackageID") != 0)
    no_version = F.col("_version").isNull() & (F.col("ChangeID") != 0)
    text = F.when(no_package, F.concat(F.lit(NOT_FOUND[0]), package, F.lit(NOT_FOUND[1]))).when(
        no_version, F.concat(F.lit(NO_VERSION[0]), package, F.lit(NO_VERSION[1]), change, F.lit(NO_VERSION[2]))
    )
    return (
        requests.join(packages, "PackageID", "left")
        .join(versions, ["PackageID", "ChangeID"], "left")
        .where(no_package | no_version)
        .select("request_id", "PackageID", "ChangeID", text.alias("ErrorText"))
    )


def viewer_header(requests: DataFrame, t: BillingTables) -> DataFrame:
    """Dates, client and billing contact of a package or version; e-mail only for current ones."""
    history, current = _answerable(requests, t)
    columns = ["request_id", "ClientID", "LicenseStartDate", "LicenseExpirationDate", "PackageDiscount"]
    versions = history.join(t.header_log, ["PackageID", "HeaderChangeID"], "left").select(
        *columns, F.lit(False).alias("_current")
    )
    packages = current.join(t.header.drop("HeaderChangeID"), "PackageID").select(*columns, F.lit(True).alias("_current"))
    contact = ["ClientName", "BillingAddress1", "BillingContactName", "BillingPhoneNumber", "BillingEmail"]
    return with_client(versions.unionByName(packages), t.client, contact, spread_by=["request_id"]).select(
        "request_id", "LicenseStartDate", "LicenseExpirationDate", "ClientName",
        F.col("BillingAddress1").alias("ClientAddress"), "BillingContactName", "BillingPhoneNumber",
        F.when(F.col("_current"), F.col("BillingEmail")).alias("BillingEmail"),
        _term().alias("PackageTerm"), "PackageDiscount",
    )


def _version_lines(history: DataFrame, t: BillingTables, how: str, package: str = "PackageID",
                   change: str = "ChangeID") -> DataFrame:
    """Lines of the requested versions: membership of the version, then each line's logged values."""
    members = t.change_items.select(
        F.col("LicensePackageID").alias(package), F.col("LicensePackageChangeID").alias(change),
        F.col("ItemID").alias("_item"), F.col("LatestDetailGroupChangeID").alias("_group"),
    )
    logged = t.detail_log.select(
        F.col("PackageID").alias(package), F.col("ItemID").alias("_item"),
        F.col("DetailGroupChangeID").alias("_group"), F.col("ItemID"), *_line_values(),
    )
    return (
        history.select("request_id", package, change).join(members, [package, change])
        .join(logged, [package, "_group", "_item"], how)
        .select("request_id", "ItemID", *ITEM_VALUES)
    )


def _line_values():
    return [F.col("Price").alias("ItemPrice"), F.col("Quantity"), F.col("Discount").alias("ItemDiscount"),
            F.col("LicenseFactor")]


def _current_lines(requests: DataFrame, detail: DataFrame, package: str = "PackageID") -> DataFrame:
    lines = detail.select(F.col("PackageID").alias(package), "ItemID", *_line_values())
    return requests.select("request_id", package).join(lines, package).select("request_id", "ItemID", *ITEM_VALUES)


def _name_items(lines: DataFrame, t: BillingTables, how: str) -> DataFrame:
    named = lookup_join(lines, t.item.select("ItemID", "ItemName"), ["ItemID"], ["request_id", "Quantity"], how)
    return named.select("request_id", "ItemName", *ITEM_VALUES)


def viewer_items(requests: DataFrame, t: BillingTables) -> DataFrame:
    """Items of a package or version; lines with an unknown item are left out."""
    history, current = _answerable(requests, t)
    lines = _version_lines(history, t, "inner").unionByName(_current_lines(current, t.detail))
    return _name_items(lines, t, "inner")


def previous_items(requests: DataFrame, t: BillingTables) -> DataFrame:
    """As `viewer_items`, but unknown items stay with a NULL name."""
    history, current = _answerable(requests, t)
    lines = _version_lines(history, t, "left").unionByName(_current_lines(current, t.detail))
    return _name_items(lines, t, "left")


def package_line_items(requests: DataFrame, t: BillingTables) -> DataFrame:
    """Current lines of each requested package."""
    return _name_items(_current_lines(requests, t.detail), t, "left")


HEADER_VALUES = ["UserMinimum", "PackageDiscount", "LicenseStartDate", "LicenseExpirationDate"]
PART_VALUES = ["LicensedUsers", "BasePrice", "PartnerSplitPercentage", "Note"]


def _version_parts(history: DataFrame, t: BillingTables, base_item_id: int, package: str = "PackageID",
                   change: str = "ChangeID") -> DataFrame:
    """Header, base item, partner and note of each requested version, found by its part ids."""
    as_package = F.col("PackageID").alias(package)
    headers = t.header_log.select(as_package, "HeaderChangeID", "ClientID", "Location", *HEADER_VALUES)
    base = base_item_rows(t.detail_log, base_item_id, ["PackageID", "DetailGroupChangeID"])
    partners = t.partner_log.select(as_package, "ClientPartnerChangeID", "ClientPartnerID", "PartnerSplitPercentage")
    notes = t.note_log.select(as_package, F.col("LicPackageChangeID").alias(change), "Note")
    return (
        history.join(headers, [package, "HeaderChangeID"], "left")
        .join(base.withColumnRenamed("PackageID", package), [package, "DetailGroupChangeID"], "left")
        .join(partners, [package, "ClientPartnerChangeID"], "left")
        .join(notes, [package, change], "left")
    )


def _current_parts(requests: DataFrame, t: BillingTables, base_item_id: int, package: str = "PackageID") -> DataFrame:
    as_package = F.col("PackageID").alias(package)
    headers = t.header.select(as_package, "ClientID", "Location", *HEADER_VALUES)
    base = base_item_rows(t.detail, base_item_id, ["PackageID"]).withColumnRenamed("PackageID", package)
    base = base.withColumn("_has_base", F.lit(True))
    partners = t.partner.select(as_package, "ClientPartnerID", "PartnerSplitPercentage")
    notes = t.note.select(as_package, "Note")
    return (
        requests.join(headers, package).join(base, package, "left").join(partners, package, "left")
        .join(notes, package, "left")
    )


def previous_header(requests: DataFrame, t: BillingTables, base_item_id: int = BASE_ITEM_ID) -> DataFrame:
    """The package or version a renewal is compared with."""
    history, current = _answerable(requests, t)
    columns = ["request_id", "ClientID", "ClientPartnerID", "Location", *HEADER_VALUES, *PART_VALUES]
    rows = _version_parts(history, t, base_item_id).select(*columns).unionByName(
        _current_parts(current, t, base_item_id).select(*columns)
    )
    rows = with_client(rows, t.client, ["ClientName"], spread_by=["request_id"])
    names = t.client.select(F.col("ClientID").alias("ClientPartnerID"), F.col("ClientName").alias("ClientPartnerName"))
    return lookup_join(rows, names, ["ClientPartnerID"], ["request_id"]).select(
        "request_id", "ClientName", "ClientPartnerName", "Location", "LicensedUsers", "BasePrice",
        _term().alias("LicenseTermMonths"), "UserMinimum", "PackageDiscount", "PartnerSplitPercentage",
        "LicenseStartDate", "LicenseExpirationDate", "Note",
    )


def active_identity(requests: DataFrame, t: BillingTables) -> DataFrame:
    """Client, partner and location of the package being renewed, always from current state."""
    header = with_client(t.header.select("PackageID", "ClientID", "Location"), t.client, ["ClientName"])
    package = F.col("PackageID").alias("LicensePackageID")
    rows = header.join(named_partners(t.partner, t.client), "PackageID", "left").select(
        package, "ClientName", "ClientPartnerName", "Location"
    )
    return requests.select("request_id", "LicensePackageID").join(rows, "LicensePackageID").select(
        "request_id", "ClientName", "ClientPartnerName", "Location"
    )


def _renewal_sources(requests: DataFrame, autofill, t: BillingTables) -> tuple[DataFrame, DataFrame]:
    """Split requests into those filled from a version and those filled from a current package.

    Without autofill the source is the package itself, with it the previous package; the flag
    `_renew` stays on the row, so one join chain serves both.
    """
    flagged = requests.select("request_id", "LicensePackageID", "PrevPackageID", "PrevChangeID",
                              autofill.alias("_renew"))
    routed = _with_version(flagged, t.change_log, "PrevPackageID", "PrevChangeID")
    history = routed.where("_renew AND _in_history")
    source = F.when(F.col("_renew"), F.col("PrevPackageID")).otherwise(F.col("LicensePackageID"))
    current = routed.where("NOT (_renew AND _in_history)").select("request_id", "_renew", source.alias("SourceID"))
    return history, current


def _renewed_dates():
    """The next term starts the day after expiry and lasts as many months; a date after 9999-12-31 is NULL."""
    last = F.lit("9999-12-31").cast("date")
    next_day = F.when(F.col("LicenseExpirationDate") < last, F.date_add("LicenseExpirationDate", 1))
    next_end = F.add_months(next_day, _term())
    start = F.when(F.col("_renew"), next_day).otherwise(F.col("LicenseStartDate"))
    end = F.when(F.col("_renew"), F.when(next_end <= last, next_end)).otherwise(F.col("LicenseExpirationDate"))
    return [start.alias("DefaultPackageStartDate"), end.alias("DefaultPackageEndDate")]


def _active_header(requests: DataFrame, autofill, t: BillingTables, base_item_id: int) -> DataFrame:
    history, current = _renewal_sources(requests, autofill, t)
    columns = ["request_id", "_renew", *HEADER_VALUES, *PART_VALUES]
    rows = _version_parts(history, t, base_item_id, "PrevPackageID", "PrevChangeID").select(*columns).unionByName(
        _current_parts(current, t, base_item_id, "SourceID").select(*columns)
    )
    return rows.select("request_id", "LicensedUsers", "BasePrice", "UserMinimum", "PackageDiscount",
                       "PartnerSplitPercentage", *_renewed_dates(), "Note")


def _active_items(requests: DataFrame, autofill, t: BillingTables, mode: str) -> DataFrame:
    history, current = _renewal_sources(requests, autofill, t)
    flags = requests.select("request_id", autofill.alias("_renew"))
    past = _version_lines(history, t, "left", "PrevPackageID", "PrevChangeID").withColumn("_renew", F.lit(True))
    lines = t.detail.select(F.col("PackageID").alias("SourceID"), "ItemID", *_line_values())
    now = current.join(lines, "SourceID").select("request_id", "ItemID", *ITEM_VALUES, "_renew")
    rows = past.unionByName(now)
    named = lookup_join(rows, t.item.select("ItemID", "ItemName"), ["ItemID"], ["request_id", "Quantity"])
    renewed = renewal_item_price(F.col("ItemPrice"), F.col("ItemDiscount"), F.col("LicenseFactor"), mode)
    price = F.when(F.col("_renew"), renewed).otherwise(F.col("ItemPrice").cast(UNIT))
    named = named.select("request_id", "ItemName", price.alias("ItemPrice"), "Quantity", "ItemDiscount", "LicenseFactor")
    return pad_blank_rows(named, flags.select("request_id"))


def active_header(requests: DataFrame, t: BillingTables, base_item_id: int = BASE_ITEM_ID) -> DataFrame:
    """Header proposed for a renewal, or the package as it is where autofill is off."""
    return _active_header(requests, yes_no(F.col("AutofillHeader")), t, base_item_id)


def active_items(requests: DataFrame, t: BillingTables) -> DataFrame:
    """Items proposed for a renewal at next-term prices, each list followed by blank rows."""
    return _active_items(requests, yes_no(F.col("AutofillItems")), t, "final")


def active_header_editing(requests: DataFrame, t: BillingTables, base_item_id: int = BASE_ITEM_ID) -> DataFrame:
    """Second version: editing mode overrides autofill."""
    autofill = yes_no(F.col("AutofillHeader")) & ~yes_no(F.col("EditingMode"))
    return _active_header(requests, autofill, t, base_item_id)


def active_items_editing(requests: DataFrame, t: BillingTables) -> DataFrame:
    autofill = yes_no(F.col("AutofillItems")) & ~yes_no(F.col("EditingMode"))
    return _active_items(requests, autofill, t, "earlier")


def _v0_sources(requests: DataFrame, autofill: str) -> DataFrame:
    """First version: versions are ignored and editing mode always uses the package itself."""
    editing = yes_no(F.col("EditingMode"))
    source = F.when(yes_no(F.col(autofill)) & ~editing, F.col("PrevPackageID")).otherwise(F.col("LicensePackageID"))
    return requests.select("request_id", source.alias("SourceID"), editing.alias("_editing"))


def active_header_v0(requests: DataFrame, t: BillingTables, as_of=None,
                     base_item_id: int = BASE_ITEM_ID) -> DataFrame:
    """First version: outside editing mode only packages with the base item; start is `as_of`."""
    start = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    rows = _current_parts(_v0_sources(requests, "AutofillHeader"), t, base_item_id, "SourceID")
    rows = rows.where("_editing OR _has_base")
    return rows.select("request_id", "LicensedUsers", "UserMinimum", "BasePrice", "PartnerSplitPercentage",
                       "PackageDiscount", start.alias("DefaultPackageStartDate"), "Note")


def active_items_v0(requests: DataFrame, t: BillingTables) -> DataFrame:
    """First version: price with factor but without discount outside editing mode; no blank rows.

    Outside editing mode an existing package without lines gives one row of NULLs.
    """
    sources = _v0_sources(requests, "AutofillItems").join(
        t.header.select(F.col("PackageID").alias("SourceID"), F.lit(True).alias("_exists")), "SourceID", "left"
    )
    lines = t.detail.select(F.col("PackageID").alias("SourceID"), "ItemID", *_line_values(), F.lit(True).alias("_line"))
    rows = sources.join(lines, "SourceID", "left").where(
        "(_editing AND _line) OR (NOT _editing AND _exists)"
    )
    named = lookup_join(rows, t.item.select("ItemID", "ItemName"), ["ItemID"], ["request_id", "Quantity"])
    renewed = renewal_item_price(F.col("ItemPrice"), F.col("ItemDiscount"), F.col("LicenseFactor"), "earliest")
    price = F.when(F.col("_editing"), F.col("ItemPrice").cast(UNIT)).otherwise(renewed)
    return named.select("request_id", "ItemName", price.alias("ItemPrice"), "Quantity", "ItemDiscount", "LicenseFactor")
