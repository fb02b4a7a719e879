"""Changes of package header, partner and note, with their log rows.

Each `*_change` reads the package frame of `tagged` and tells what a batch does to a part; `diff_*`
shows it with both images, and the row functions read only that comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.functions.text import text_key
from leasebook.model import COLUMNS
from leasebook.operators.compare import differs
from leasebook.operators.tagged import HEADER_VALUES, PARTNER_VALUES


def _shown(packages: DataFrame, part: str, old: list[str], new: list[str], action: Column, change: Column) -> DataFrame:
    """Both images of a part, its action and its change id after it."""
    return packages.select(
        "PackageID", *[F.col(f"new.{c}").alias(f"New{c}") for c in new], *[F.col(f"{part}.{c}").alias(f"Old{c}") for c in old],
        action.alias("Action"), change.alias("ChangeID"), F.col(part).isNotNull().alias("_exists"),
        F.col("NextChangeID"), F.col("new.LoginName").alias("LoginName"))


def header_change(change_id: str = "HeaderChangeID", detect_change: bool = True, null_safe: bool = False) -> tuple[Column, Column]:
    """(INSERT, UPDATE or NONE per package, its header's change id). Without `detect_change` every match is an UPDATE."""
    def key(name: str):
        return text_key(F.col(name)) if name.endswith("Location") else F.col(name)

    changed = differs([(key(f"header.{v}"), key(f"new.{v}")) for v in HEADER_VALUES], null_safe) if detect_change else F.lit(True)
    before = F.col(f"header.{change_id}")
    action = F.when(F.col("header").isNull(), "INSERT").when(changed, "UPDATE").otherwise("NONE")
    return action, F.when(action == "INSERT", 1).when(action == "UPDATE", before + 1).otherwise(before)


def diff_header(packages: DataFrame, change_id: str = "HeaderChangeID", detect_change: bool = True,
                null_safe: bool = False) -> DataFrame:
    return _shown(packages, "header", [*HEADER_VALUES, change_id, "Inactive"], HEADER_VALUES,
                  *header_change(change_id, detect_change, null_safe))


def header_rows(diff: DataFrame) -> DataFrame:
    """New current headers; a changed or new package is active."""
    unchanged = F.col("Action") == "NONE"
    values = [F.when(unchanged, F.col(f"Old{v}")).otherwise(F.col(f"New{v}")).alias(v) for v in HEADER_VALUES]
    return diff.select(
        "PackageID", *values, F.col("ChangeID").alias("HeaderChangeID"),
        F.when(unchanged, F.col("OldInactive")).otherwise(F.lit(0)).alias("Inactive"),
    ).select(*COLUMNS["header"])


def header_log_rows(diff: DataFrame) -> DataFrame:
    """Values before the change, or the new ones of an added package."""
    values = [F.coalesce(f"Old{v}", f"New{v}").alias(v) for v in HEADER_VALUES]
    return diff.where("Action <> 'NONE'").select(
        "PackageID", F.col("ChangeID").alias("HeaderChangeID"), *values,
        F.coalesce("OldInactive", F.lit(0)).alias("Inactive"), F.col("Action").alias("Operation"),
    ).select(*COLUMNS["header_log"])


def _header_image_soft() -> list[Column]:
    new = [F.col(f"New{v}").alias(v) for v in HEADER_VALUES]
    return [F.col("PackageID"), *new, F.coalesce("OldInactive", F.lit(0)).alias("Inactive"), F.col("ChangeID")]


def header_rows_soft(diff: DataFrame) -> DataFrame:
    """Second schema: new values of every submitted package; Inactive is left as it was."""
    return diff.select(*_header_image_soft())


def header_log_rows_soft(diff: DataFrame) -> DataFrame:
    return diff.where("Action <> 'NONE'").select(*_header_image_soft(), F.col("Action").alias("Operation"))


def partner_change(change_id: str = "ClientPartnerChangeID", soft: bool = False, null_safe: bool = False) -> tuple[Column, Column]:
    """(INSERT, UPDATE, DELETE or NONE per package, its partner's change id).

    A blank partner removes the current one. A partner added again continues the ids of the
    log. With `soft`, removal marks the row inactive, and naming a partner makes it active.
    """
    named, exists = F.col("new.ClientPartnerID").isNotNull(), F.col("partner").isNotNull()
    changed = differs([(F.col(f"partner.{v}"), F.col(f"new.{v}")) for v in PARTNER_VALUES], null_safe)
    removable = exists
    if soft:
        changed = changed | (F.col("partner.Inactive") == 1)
        removable = exists & (F.col("partner.Inactive") == 0)
    action = (
        F.when(named & ~exists, "INSERT").when(named & changed, "UPDATE").when(~named & removable, "DELETE")
        .otherwise("NONE")
    )
    before = F.col(f"partner.{change_id}")
    return action, F.when(action == "INSERT", F.coalesce(F.col("_partner_max") + 1, F.lit(1))).when(
        action == "NONE", before).otherwise(before + 1)


def diff_partner(packages: DataFrame, change_id: str = "ClientPartnerChangeID", soft: bool = False,
                 null_safe: bool = False) -> DataFrame:
    return _shown(packages, "partner", [*PARTNER_VALUES, change_id, *(["Inactive"] if soft else [])], PARTNER_VALUES,
                  *partner_change(change_id, soft, null_safe))


def _partner_image():
    changed = F.col("Action").isin("INSERT", "UPDATE")
    return [F.when(changed, F.col(f"New{v}")).otherwise(F.col(f"Old{v}")).alias(v) for v in PARTNER_VALUES]


def partner_rows(diff: DataFrame) -> DataFrame:
    return diff.where("Action IN ('INSERT', 'UPDATE') OR (Action = 'NONE' AND _exists)").select(
        "PackageID", *_partner_image(), F.col("ChangeID").alias("ClientPartnerChangeID")
    )


def partner_log_rows(diff: DataFrame) -> DataFrame:
    values = [F.coalesce(f"Old{v}", f"New{v}").alias(v) for v in PARTNER_VALUES]
    return diff.where("Action <> 'NONE'").select(
        "PackageID", F.col("ChangeID").alias("ClientPartnerChangeID"), *values, F.col("Action").alias("Operation")
    )


def partner_rows_soft(diff: DataFrame) -> DataFrame:
    inactive = F.when(F.col("Action") == "DELETE", 1).when(F.col("Action") == "NONE", F.col("OldInactive")).otherwise(0)
    return diff.where("Action <> 'NONE' OR _exists").select(
        "PackageID", *_partner_image(), inactive.alias("Inactive"), "ChangeID"
    )


def partner_log_rows_soft(diff: DataFrame) -> DataFrame:
    return diff.where("Action <> 'NONE'").select(
        "PackageID", "ChangeID", *_partner_image(), F.when(F.col("Action") == "DELETE", 1).otherwise(0).alias("Inactive"),
        F.col("Action").alias("Operation"),
    )


def note_change(change_id: str = "NoteChangeID", soft: bool = False, null_safe: bool = False) -> tuple[Column, Column]:
    """(INSERT, UPDATE, DELETE or NONE per package, its note's change id).

    A note is added only when it is not blank, and updated also to a blank one; with `soft`
    a blank note marks the current one inactive instead, and a text makes it active again.
    """
    exists = F.col("note").isNotNull()
    filled = F.coalesce(F.length(F.rtrim(F.col("new.Note"))) > 0, F.lit(False))
    changed = differs([(text_key(F.col("note.Note")), text_key(F.col("new.Note")))], null_safe)
    action = F.when(~exists & filled, "INSERT")
    if soft:
        inactive = F.col("note.Inactive") == 1
        blank = F.col("new.Note").isNotNull() & ~filled
        action = action.when(exists & filled & (changed | inactive), "UPDATE").when(exists & blank & ~inactive, "DELETE")
    else:
        action = action.when(exists & changed, "UPDATE")
    action = action.otherwise("NONE")
    before = F.col(f"note.{change_id}")
    return action, F.when(action == "INSERT", 1).when(action == "NONE", before).otherwise(before + 1)


def diff_note(packages: DataFrame, change_id: str = "NoteChangeID", soft: bool = False, null_safe: bool = False) -> DataFrame:
    return _shown(packages, "note", ["Note", change_id, *(["Inactive"] if soft else [])], ["Note"],
                  *note_change(change_id, soft, null_safe))


def _note_image():
    return F.when(F.col("Action").isin("INSERT", "UPDATE"), F.col("NewNote")).otherwise(F.col("OldNote")).alias("Note")


def note_rows(diff: DataFrame) -> DataFrame:
    return diff.where("Action <> 'NONE' OR _exists").select(
        "PackageID", _note_image(), F.col("ChangeID").alias("NoteChangeID")
    )


def note_log_rows(diff: DataFrame, as_of) -> DataFrame:
    """The text before an update, or the added text, with the version it belongs to."""
    return diff.where("Action <> 'NONE'").select(
        "PackageID", F.col("ChangeID").alias("NoteChangeID"), F.coalesce("OldNote", "NewNote").alias("Note"),
        F.col("Action").alias("Operation"), F.col("NextChangeID").alias("LicPackageChangeID"), as_of.alias("Updated"),
        F.col("LoginName").alias("UpdatedBy"),
    )


def note_rows_soft(diff: DataFrame) -> DataFrame:
    inactive = F.when(F.col("Action") == "DELETE", 1).when(F.col("Action") == "NONE", F.col("OldInactive")).otherwise(0)
    return diff.where("Action <> 'NONE' OR _exists").select("PackageID", _note_image(), inactive.alias("Inactive"), "ChangeID")


def note_log_rows_soft(diff: DataFrame) -> DataFrame:
    """Marking a note inactive is logged as an UPDATE."""
    operation = F.when(F.col("Action") == "INSERT", "INSERT").otherwise("UPDATE")
    return diff.where("Action <> 'NONE'").select(
        "PackageID", "ChangeID", _note_image(), operation.alias("Operation"),
        F.when(F.col("Action") == "DELETE", 1).otherwise(0).alias("Inactive"),
    )
