"""A batch as tagged rows: current rows, submitted rows and log ids in one frame, grouped once per key.

Every source brings its own columns and leaves those of the others empty, so a group holds each side of
a comparison, and the highest ids of its logs, without a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.operators.compare import differs_or_null, for_packages

VALUES = ["Price", "Quantity", "Discount", "LicenseFactor"]
HEADER_VALUES = ["ClientID", "Location", "LicenseStartDate", "LicenseExpirationDate", "PackageDiscount", "UserMinimum"]
PARTNER_VALUES = ["ClientPartnerID", "PartnerSplitPercentage"]


def pairs() -> list[tuple[Column, Column]]:
    return [(F.col(f"Old{v}"), F.col(f"New{v}")) for v in VALUES]


def _grouped(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """At most one source fills a column of a key but for log ids, of which the highest counts."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rows.columns if c not in keys])


def line_frame(accepted: DataFrame, lines: DataFrame, detail: DataFrame, detail_log: DataFrame, extra: dict[str, str],
               log_ids: dict[str, str]) -> DataFrame:
    """One row per (PackageID, ItemID) of the accepted packages: both images, row number, highest logged ids.

    `extra` names further current columns, `log_ids` the id columns of the log, each with its name here. Rows that
    are in the log only have neither `_current` nor `_submitted`.
    """
    current = detail.select(
        "PackageID", "ItemID", *[F.col(v).alias(f"Old{v}") for v in VALUES],
        *[F.col(c).alias(a) for c, a in extra.items()], F.lit(True).alias("_current"))
    logged = detail_log.select("PackageID", "ItemID", *[F.col(c).alias(a) for c, a in log_ids.items()])
    # The lines submitted are of accepted packages already.
    known = for_packages(current.unionByName(logged, allowMissingColumns=True), accepted)
    submitted = lines.select(
        "PackageID", "ItemID", "RowNo", F.col("ItemPrice").alias("NewPrice"), F.col("Quantity").alias("NewQuantity"),
        F.col("ItemDiscount").alias("NewDiscount"), F.col("LicenseFactor").alias("NewLicenseFactor"),
        F.lit(True).alias("_submitted"))
    return _grouped([known, submitted], ["PackageID", "ItemID"])


def package_frame(accepted: DataFrame, lines: DataFrame, header: DataFrame, partner: DataFrame, note: DataFrame,
                  header_log: DataFrame, partner_log: DataFrame, note_log: DataFrame, change_log: DataFrame,
                  ids: dict[str, str], soft: bool = False) -> DataFrame:
    """One row per accepted package: submitted values, current parts, highest logged ids, what its lines do.

    `lines` is the line comparison with `Action`; `ids` gives the change id column of header, partner and note.
    Structs `new`, `header`, `partner` and `note` are NULL where there is no such row. A maximum of structs needs sorted
    rows, so only the few rows that bring one are grouped that way, once they are dealt out; lines and logs are hashed.
    """
    state = ["Inactive"] if soft else []
    new = F.struct(*HEADER_VALUES, "ClientPartnerID", F.col("PartnerSplit").alias("PartnerSplitPercentage"), "Note", "LoginName")
    one = lambda table, name, columns: table.select("PackageID", F.struct(*columns).alias(name))
    highest = lambda log, column, name: log.select("PackageID", F.col(column).alias(name))
    done = lines.select(
        "PackageID", (F.coalesce("Action", F.lit("NONE")) != "NONE").alias("_lines_differ"),
        F.when(F.col("Action") != "INSERT", (F.col("Action") == "DELETE") | differs_or_null(pairs())).alias("DetailsChanged"),
        *([] if soft else ["_group_max"]))
    images = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        accepted.select("PackageID", new.alias("new")),
        one(header, "header", [*HEADER_VALUES, ids["header"], "Inactive"]), one(partner, "partner", [*PARTNER_VALUES, ids["partner"], *state]),
        one(note, "note", ["Note", ids["note"], *state])]).repartition("PackageID")
    images = _grouped([images], ["PackageID"]).where("new IS NOT NULL")
    known = _grouped([
        done, highest(header_log, ids["header"], "_header_max"),
        highest(partner_log, ids["partner"], "_partner_max"), highest(note_log, ids["note"], "_note_max"),
        highest(change_log, "ChangeID", "_version_max"),
    ], ["PackageID"])
    return images.join(known, "PackageID", "left").withColumn("NextChangeID", F.coalesce(F.col("_version_max") + 1, F.lit(1)))
