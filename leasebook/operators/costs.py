"""Renewal and history costs per package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.functions.dates import month_diff
from leasebook.functions.exact import Exact
from leasebook.functions.money import line_amount, package_cost, renewal_item_price
from leasebook.sources.staging import stage

LINE_AMOUNT_ARGS = ("Quantity", "Price", "Discount", "LicenseFactor")


def _monthly(detail: DataFrame, keys: list[str]) -> DataFrame:
    """Monthly amount per key. Lines are summed before any join, so a package with very many
    lines reaches the shuffle as one partial sum per task."""
    amount = line_amount(*[F.col(c) for c in LINE_AMOUNT_ARGS])
    return detail.groupBy(*keys).agg(F.sum(amount).alias("_monthly"))


def _months():
    return month_diff(F.col("LicenseStartDate"), F.col("LicenseExpirationDate"))


def renewal_cost(detail: DataFrame, header: DataFrame) -> DataFrame:
    """PackageID and the cost of renewing the package for one more term.

    Packages without lines have no row; lines without a header belong to no package.
    """
    terms = header.select("PackageID", "LicenseStartDate", "LicenseExpirationDate", "PackageDiscount")
    return (
        _monthly(detail, ["PackageID"])
        .join(terms, "PackageID")
        .select("PackageID", term_cost().alias("CalculatedRenewalCost"))
    )


def renewal_cost_exact(detail: DataFrame, header: DataFrame) -> DataFrame:
    """`renewal_cost` with the result types of T-SQL at every step, decimal(38,6) in the end."""
    rest = lambda rate: Exact.whole(1) - Exact.whole(1) * Exact.of(F.col(rate), 5, 4)
    price = Exact.of(F.col("Price"), 19, 4)
    unit = (price + price * Exact.of(F.col("LicenseFactor"), 5, 4)) * rest("Discount")
    monthly = (Exact.whole(F.col("Quantity")) * unit).total()
    cost = Exact.whole(_months()) * Exact(F.col("_monthly"), monthly.precision, monthly.scale) * rest("PackageDiscount")
    terms = header.select("PackageID", "LicenseStartDate", "LicenseExpirationDate", "PackageDiscount")
    sums = detail.groupBy("PackageID").agg(monthly.column.alias("_monthly"))
    return sums.join(terms, "PackageID").select("PackageID", cost.column.alias("CalculatedRenewalCost"))


def package_summary(detail: DataFrame, base_item_id: int) -> DataFrame:
    """Per package the base item's quantity and price and the monthly amount, in one pass over the lines.

    A package holds an item at most once, so the maximum picks the base item's row.
    """
    is_base = F.col("ItemID") == base_item_id
    amount = line_amount(*[F.col(c) for c in LINE_AMOUNT_ARGS])
    return detail.groupBy("PackageID").agg(
        F.max(F.when(is_base, F.col("Quantity"))).alias("LicensedUsers"),
        F.max(F.when(is_base, F.col("Price"))).alias("BasePrice"),
        F.sum(amount).alias("_monthly"),
    )


def term_cost() -> Column:
    """Renewal cost of a header row joined with its `package_summary`; NULL without lines."""
    return package_cost(_months(), F.col("_monthly"), F.col("PackageDiscount"))


def history_cost(detail_log: DataFrame, header_log: DataFrame) -> DataFrame:
    """Cost over the logs, joined on PackageID only, one row per package, term and discount.

    Every header version meets every logged line, so a group of n versions counts each line
    n times. The sum over all such pairs is n times the plain sum, which is what is
    computed; the pairs are never formed.
    """
    groups = (
        header_log.where("PackageID IS NOT NULL")
        .groupBy("PackageID", "LicenseStartDate", "LicenseExpirationDate", "PackageDiscount")
        .agg(F.count(F.lit(1)).alias("_versions"))
    )
    crossed = (F.col("_monthly").cast("decimal(26,8)") * F.col("_versions").cast("decimal(10,0)")).cast("decimal(26,8)")
    return (
        groups.join(_monthly(detail_log, ["PackageID"]), "PackageID")
        .select("PackageID", "LicenseStartDate", "LicenseExpirationDate", "PackageDiscount",
                package_cost(_months(), crossed, F.col("PackageDiscount")).alias("TotalPackageCost"))
    )


def history_cost_v0(detail_log: DataFrame, header_log: DataFrame) -> DataFrame:
    """Earlier rule: latest dates of all versions, no package discount, one row per package."""
    groups = header_log.groupBy("PackageID").agg(
        F.max("LicenseStartDate").alias("LicenseStartDate"),
        F.max("LicenseExpirationDate").alias("LicenseExpirationDate"),
        F.count(F.lit(1)).alias("_versions"),
    )
    crossed = (F.col("_monthly").cast("decimal(26,8)") * F.col("_versions").cast("decimal(10,0)")).cast("decimal(26,8)")
    return (
        groups.join(_monthly(detail_log, ["PackageID"]), "PackageID")
        .select("PackageID", package_cost(_months(), crossed).alias("TotalPackageCost"))
    )


def version_cost(change_log: DataFrame, change_items: DataFrame, detail_log: DataFrame,
                 header_log: DataFrame) -> DataFrame:
    """Cost of each package version from the items that version held (the evident intent).

    The amounts, which take the shuffles of all logged lines, are staged before they meet the terms.
    """
    members = change_items.select(
        F.col("LicensePackageID").alias("PackageID"), F.col("LicensePackageChangeID").alias("ChangeID"),
        "ItemID", F.col("LatestDetailGroupChangeID").alias("DetailGroupChangeID"),
    )
    monthly = stage(_monthly(
        members.join(detail_log, ["PackageID", "DetailGroupChangeID", "ItemID"]), ["PackageID", "ChangeID"]
    ))
    terms = header_log.select("PackageID", "HeaderChangeID", "LicenseStartDate", "LicenseExpirationDate",
                              "PackageDiscount")
    return (
        change_log.select("PackageID", "ChangeID", "HeaderChangeID")
        .join(terms, ["PackageID", "HeaderChangeID"])
        .join(monthly, ["PackageID", "ChangeID"])
        .select("PackageID", "ChangeID",
                package_cost(_months(), F.col("_monthly"), F.col("PackageDiscount")).alias("TotalPackageCost"))
    )


def item_price_modes(detail: DataFrame) -> DataFrame:
    """Next-term unit price of every line under the three price rules."""
    args = [F.col(c) for c in ("Price", "Discount", "LicenseFactor")]
    return detail.select(
        "PackageID", "ItemID",
        renewal_item_price(*args, mode="final").alias("FinalPrice"),
        renewal_item_price(*args, mode="earlier").alias("EarlierPrice"),
        renewal_item_price(*args, mode="earliest").alias("EarliestPrice"),
    )
