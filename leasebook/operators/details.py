"""Changes of package lines: comparison, new current rows, log rows, membership rows.

One comparison, the line frame of `tagged` with the action of each line, feeds everything else; what is known
per package comes from the package frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.model import COLUMNS
from leasebook.operators.compare import differs
from leasebook.operators.tagged import VALUES, pairs

def _with_action(frame: DataFrame, action: Column) -> DataFrame:
    """The line frame with `Action`, which is NULL where an item is in the log only."""
    shown = F.when(F.col("_current").isNotNull() | F.col("_submitted").isNotNull(), action)
    return frame.withColumn("Action", shown).drop("_current", "_submitted")


def line_actions(frame: DataFrame, null_safe: bool = False) -> DataFrame:
    """INSERT, UPDATE, DELETE or NONE per line of the submitted packages."""
    return _with_action(frame, (
        F.when(F.col("_current").isNull(), "INSERT").when(F.col("_submitted").isNull(), "DELETE")
        .when(differs(pairs(), null_safe), "UPDATE").otherwise("NONE")
    ))


def diff_details(actions: DataFrame) -> DataFrame:
    """One row per line of the submitted packages with its action and both images."""
    return actions.where("Action IS NOT NULL").select(
        "PackageID", "ItemID", "RowNo", "Action", *[f"Old{v}" for v in VALUES], *[f"New{v}" for v in VALUES],
        "OldDetailItemChangeID",
    )


def details_changed(packages: DataFrame) -> DataFrame:
    """Per package with current lines: would any of them change?

    A NULL on either side counts as a change; a submission that only adds lines does not.
    """
    return packages.where("DetailsChanged IS NOT NULL").select("PackageID", "DetailsChanged")


def next_group() -> Column:
    """The group id that a package's changed lines are logged under."""
    return F.coalesce(F.col("_group_max") + 1, F.lit(1))


def detail_rows(actions: DataFrame, continue_ids: bool = True) -> DataFrame:
    """New current lines of the submitted packages.

    Added lines take the id their log row takes, which continues the item's ids where it was in the package before;
    without `continue_ids` they take 1.
    """
    first = F.coalesce(F.col("_item_max") + 1, F.lit(1)) if continue_ids else F.lit(1)
    changed = F.col("Action").isin("INSERT", "UPDATE")
    values = [F.when(changed, F.col(f"New{v}")).otherwise(F.col(f"Old{v}")).alias(v) for v in VALUES]
    change_id = (
        F.when(F.col("Action") == "INSERT", first)
        .when(F.col("Action") == "UPDATE", F.col("OldDetailItemChangeID") + 1)
        .otherwise(F.col("OldDetailItemChangeID"))
    )
    return actions.where("Action <> 'DELETE'").select("PackageID", "ItemID", *values, change_id.alias("DetailItemChangeID"))


def detail_log_rows(actions: DataFrame, packages: DataFrame) -> DataFrame:
    """Log rows of the changed lines: values before the change, or the new ones of added lines."""
    values = [F.coalesce(f"Old{v}", f"New{v}").alias(v) for v in VALUES]
    groups = packages.select("PackageID", next_group().alias("DetailGroupChangeID"))
    return (
        actions.where("Action <> 'NONE'").join(groups, "PackageID")
        .select(
            "PackageID", F.coalesce(F.col("_item_max") + 1, F.lit(1)).alias("DetailItemChangeID"), "ItemID",
            "DetailGroupChangeID", *values, F.col("Action").alias("Operation"),
        )
        .select(*COLUMNS["detail_log"])
    )


def change_items_rows(actions: DataFrame, packages: DataFrame, versioned: Column, post_image: bool = False) -> DataFrame:
    """Which items each new version holds, and under which group id their values are logged.

    As first written the rows show, per package,
    * no lines before: the new lines, all under group 1;
    * lines about to change: the lines before the change;
    * otherwise: the lines after the change, if any part of the package changed.
    `post_image` always shows the lines after the change. `versioned` is true for packages of the package frame that
    get a version.
    """
    after_group = F.when(F.col("Action").isin("INSERT", "UPDATE"), F.col("_next_group")).otherwise(F.col("_group_max"))
    in_after, in_before = F.col("Action") != "DELETE", F.col("Action") != "INSERT"
    package = packages.select("PackageID", "NextChangeID", "DetailsChanged", next_group().alias("_next_group"), versioned.alias("_versioned"))
    rows = actions.where("Action IS NOT NULL").join(package, "PackageID")
    if post_image:
        rows = rows.where(in_after & F.col("_versioned"))
        group = after_group
    else:
        first_fill = F.col("DetailsChanged").isNull()
        keep = F.when(first_fill, in_after).when(F.col("DetailsChanged"), in_before).otherwise(
            in_after & F.col("_versioned")
        )
        rows = rows.where(keep)
        group = F.when(first_fill, F.lit(1)).when(F.col("DetailsChanged"), F.col("_group_max")).otherwise(after_group)
    return rows.select(
        F.col("PackageID").alias("LicensePackageID"), F.col("NextChangeID").alias("LicensePackageChangeID"), "ItemID",
        group.alias("LatestDetailGroupChangeID"),
    )


# Second schema: absent lines stay as inactive rows, logs hold the values after the change.

def line_actions_soft(frame: DataFrame, null_safe: bool = False) -> DataFrame:
    """As `line_actions`; DELETE means switched to inactive, an inactive line submitted again is updated."""
    inactive = F.col("OldInactive") == 1
    return _with_action(frame, (
        F.when(F.col("_current").isNull(), "INSERT")
        .when(F.col("_submitted").isNull(), F.when(inactive, "NONE").otherwise("DELETE"))
        .when(differs(pairs(), null_safe) | inactive, "UPDATE").otherwise("NONE")
    ))


def diff_details_soft(actions: DataFrame) -> DataFrame:
    return actions.where("Action IS NOT NULL").select(
        "PackageID", "ItemID", "RowNo", "Action", *[f"Old{v}" for v in VALUES], *[f"New{v}" for v in VALUES],
        "OldInactive", "OldChangeID",
    )


def _soft_image() -> list[Column]:
    changed = F.col("Action").isin("INSERT", "UPDATE")
    values = [F.when(changed, F.col(f"New{v}")).otherwise(F.col(f"Old{v}")).alias(v) for v in VALUES]
    inactive = F.when(changed, 0).when(F.col("Action") == "DELETE", 1).otherwise(F.col("OldInactive"))
    return [*values, inactive.alias("Inactive")]


def detail_rows_soft(actions: DataFrame) -> DataFrame:
    change_id = (
        F.when(F.col("Action") == "INSERT", 1).when(F.col("Action") == "NONE", F.col("OldChangeID"))
        .otherwise(F.col("OldChangeID") + 1)
    )
    return actions.where("Action IS NOT NULL").select("PackageID", "ItemID", *_soft_image(), change_id.alias("ChangeID"))


def detail_log_rows_post(actions: DataFrame) -> DataFrame:
    """Log rows with the values after the change. Switching a line to inactive is an UPDATE."""
    operation = F.when(F.col("Action") == "INSERT", "INSERT").otherwise("UPDATE")
    return actions.where("Action <> 'NONE'").select(
        "PackageID", F.coalesce(F.col("_item_max") + 1, F.lit(1)).alias("ChangeID"), "ItemID", *_soft_image(),
        operation.alias("Operation"))
