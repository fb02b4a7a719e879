"""Package versions, row messages and figures returned by a save."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.model import BASE_ITEM_ID
from leasebook.operators.compare import for_packages, next_id

# Messages per line action.
MESSAGES = {"INSERT": ", Added!", "UPDATE": ", Updated!", "DELETE": ", Deleted!"}


def next_package_change_id(packages: DataFrame, change_log: DataFrame) -> DataFrame:
    """PackageID and the number of its next version: highest ChangeID plus one, or 1."""
    wanted = packages.select("PackageID").distinct()
    following = next_id(for_packages(change_log.select("PackageID", "ChangeID"), wanted), ["PackageID"], "ChangeID",
                        "_next_change")
    return wanted.join(following, "PackageID", "left").select(
        "PackageID", F.coalesce("_next_change", F.lit(1)).alias("ChangeID")
    )


def change_log_rows(packages: DataFrame, parts: dict[str, tuple[Column, str, Column]], as_of) -> DataFrame:
    """One version row per changed package with the highest change id of each part.

    `parts` maps an output column (or, without one, a name that starts with a dot) to (does the part change, the
    highest logged id, the id it gets). All of it stands in the package frame, so nothing is joined.
    """
    changed = reduce(lambda a, b: a | b, [c for c, _, _ in parts.values()])
    ids = [F.greatest(F.col(logged), F.when(c, new)).alias(column)
           for column, (c, logged, new) in parts.items() if not column.startswith(".")]
    return packages.where(changed).select(
        "PackageID", F.col("NextChangeID").alias("ChangeID"), *ids, as_of.alias("Updated"), F.col("new.LoginName").alias("UpdatedBy"))


def row_messages(lines: DataFrame, diff: DataFrame) -> DataFrame:
    """The message shown beside each submitted line: what happened, or why it was refused.

    `lines` are all checked lines with Accepted and, for accepted ones, PackageID and ItemID, which
    are unique together; row numbers need not be.
    """
    action = F.lit(None).cast("string")
    for name, text in MESSAGES.items():
        action = F.when(F.col("Action") == name, text).otherwise(action)
    accepted = (
        lines.where("Accepted")
        .join(diff.select("PackageID", "ItemID", "Action"), ["PackageID", "ItemID"], "left")
        .select("submission_id", "RowNo", F.coalesce(action, F.lit("")).alias("_message"))
    )
    refused = lines.where("NOT Accepted").select("submission_id", "RowNo", F.col("LineErrors").alias("_message"))
    return accepted.unionByName(refused).select(
        "submission_id", "RowNo", F.expr("substring(_message, 3)").alias("MessageToUser")
    )


def save_measures(accepted: DataFrame, lines: DataFrame, base_item_id: int = BASE_ITEM_ID) -> DataFrame:
    """Final package id with the submitted quantity and price of the base item."""
    base = lines.where(F.col("ItemID") == base_item_id).select(
        "PackageID", F.col("Quantity").alias("LicensedUsers"), F.col("ItemPrice").alias("BasePrice")
    )
    return accepted.select("submission_id", "PackageID").join(base, "PackageID", "left").select(
        "submission_id", F.col("PackageID").alias("FinalPackageID"), "LicensedUsers", "BasePrice"
    )
