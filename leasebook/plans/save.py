"""A batch of submitted packages as one set of DataFrames.

Every property is a plan over the tables as they were before the batch. The resolved lines,
the accepted submissions, the line comparison and the package frame feed many outputs, so each is staged once
(see `sources.staging`). A dry run looks at the frames; `sources.store` writes them. A batch made for one output
(`once`) leaves the comparison and the frame in that output's plan, so Spark neither writes them nor moves the columns it does not need.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasebook.model import BASE_ITEM_ID, BillingTables, SoftTables
from leasebook.operators import changelog, details, parts, submissions, tagged
from leasebook.operators.compare import replace_packages
from leasebook.sources.staging import stage


def as_of_column(as_of: dt.date | dt.datetime | None) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of)


def _counts(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        d.agg(F.count(F.lit(1)).alias("RowCount")).select(F.lit(n).alias("Frame"), "RowCount") for n, d in frames.items()])


def _part(change: tuple[Column, Column], logged: str) -> tuple[Column, str, Column]:
    action, new = change
    return action != "NONE", logged, new


class CheckedBatch:
    """Submissions and lines after validation; a refused submission does not stop the others.

    Without `lines` the submissions carry a column LinesXml with their lines as a document. One that
    cannot be read refuses its submission, and leaves the package as it is.
    """

    def __init__(self, client: DataFrame, item: DataFrame, header: DataFrame, batch: DataFrame, lines: DataFrame | None,
                 highest: int | None = None, once: bool = False):
        self._client, self._item, self._header, self._highest, self._once = client, item, header, highest, once
        self._batch, self._lines = batch, lines

    @cached_property
    def _parsed(self) -> DataFrame:
        return stage(submissions.parsed_documents(self._batch))

    @cached_property
    def checked_lines(self) -> DataFrame:
        """Lines with their item and what is wrong with them; the names they came with are left behind."""
        lines = submissions.lines_of(self._parsed) if self._lines is None else self._lines
        return submissions.validate_lines(stage(submissions.resolve_items(lines, self._item).drop("ItemName")))

    @cached_property
    def checked(self) -> DataFrame:
        batch, unread = self._batch, None
        if self._lines is None:
            batch, unread = batch.drop("LinesXml"), submissions.errors_of(self._parsed)
        headers = submissions.validate_header(batch, self._client).drop("ClientName", "ClientPartnerName")
        errors = submissions.submission_errors(headers, self.checked_lines, unread)
        return stage(submissions.mark_new_packages(errors, self._header))

    @cached_property
    def refused(self) -> DataFrame:
        return self.checked.where("ErrorText IS NOT NULL").select("submission_id", "ErrorText")

    @cached_property
    def accepted(self) -> DataFrame:
        """Accepted submissions with their final PackageID."""
        ok = self.checked.where("ErrorText IS NULL").drop("ErrorText")
        numbered = submissions.number_new_packages(ok, self._header, self._highest)
        return stage(numbered.drop("PackageID").withColumnRenamed("FinalPackageID", "PackageID"))

    @cached_property
    def lines(self) -> DataFrame:
        """Lines of accepted submissions with PackageID and ItemID."""
        return self.checked_lines.drop("LineErrors").join(
            self.accepted.select("submission_id", "PackageID"), "submission_id"
        )

    def _line_plan(self) -> DataFrame:
        """The line frame with actions."""
        raise NotImplementedError

    def _package_plan(self, lines: DataFrame) -> DataFrame:
        """The package frame over a line comparison."""
        raise NotImplementedError

    @cached_property
    def line_actions(self) -> DataFrame:
        return self._line_plan() if self._once else stage(self._line_plan())

    @cached_property
    def packages(self) -> DataFrame:
        plan = self._package_plan(self.line_actions)
        return plan if self._once else stage(plan)

    @cached_property
    def _both(self) -> tuple[DataFrame, DataFrame]:
        """(line comparison, package frame) for an output that reads both: the comparison is written, as the frame reads it too."""
        if not self._once:
            return self.line_actions, self.packages
        lines = stage(self._line_plan())
        return lines, self._package_plan(lines)

    def messages(self, diff: DataFrame) -> DataFrame:
        """Line notices are only shown where they are the reason for the refusal."""
        refused = self.refused.withColumn("_show", F.col("ErrorText") == submissions.BAD_LINES)
        shown = (
            self.checked_lines.join(refused.drop("ErrorText"), "submission_id")
            .select("submission_id", "RowNo", F.lit(None).cast("bigint").alias("PackageID"), "ItemID",
                    F.lit(False).alias("Accepted"), F.when(F.col("_show"), F.col("LineErrors")).otherwise("").alias("LineErrors"))
        )
        done = self.lines.select("submission_id", "RowNo", "PackageID", "ItemID", F.lit(True).alias("Accepted"),
                                 F.lit("").alias("LineErrors"))
        return changelog.row_messages(shown.unionByName(done), diff)


class SaveBatch(CheckedBatch):
    """First schema: removed lines are deleted, logs hold the values before each change."""

    def __init__(self, tables: BillingTables, batch: DataFrame, lines: DataFrame | None, as_of=None,
                 base_item_id: int = BASE_ITEM_ID, null_safe: bool = False, post_image: bool = False,
                 highest: int | None = None, once: bool = False):
        super().__init__(tables.client, tables.item, tables.header, batch, lines, highest, once)
        self.tables, self.base_item_id = tables, base_item_id
        self._as_of, self._null_safe, self._post_image = as_of_column(as_of), null_safe, post_image

    # Comparisons: two frames are written, all else is read from them without a shuffle for a part.

    def _line_plan(self) -> DataFrame:
        t = self.tables
        frame = tagged.line_frame(self.accepted, self.lines, t.detail, t.detail_log, {"DetailItemChangeID": "OldDetailItemChangeID"},
                                  {"DetailItemChangeID": "_item_max", "DetailGroupChangeID": "_group_max"})
        return details.line_actions(frame, self._null_safe)

    def _package_plan(self, lines: DataFrame) -> DataFrame:
        t = self.tables
        return tagged.package_frame(
            self.accepted, lines, t.header, t.partner, t.note, t.header_log, t.partner_log, t.note_log, t.change_log,
            {"header": "HeaderChangeID", "partner": "ClientPartnerChangeID", "note": "NoteChangeID"})

    @cached_property
    def detail_diff(self) -> DataFrame:
        return details.diff_details(self.line_actions)

    @cached_property
    def header_diff(self) -> DataFrame:
        return parts.diff_header(self.packages, null_safe=self._null_safe)

    @cached_property
    def partner_diff(self) -> DataFrame:
        return parts.diff_partner(self.packages, null_safe=self._null_safe)

    @cached_property
    def note_diff(self) -> DataFrame:
        return parts.diff_note(self.packages, null_safe=self._null_safe)

    # New log rows

    @cached_property
    def detail_log_rows(self) -> DataFrame:
        return details.detail_log_rows(*self._both)

    @cached_property
    def header_log_rows(self) -> DataFrame:
        return parts.header_log_rows(self.header_diff)

    @cached_property
    def partner_log_rows(self) -> DataFrame:
        return parts.partner_log_rows(self.partner_diff)

    @cached_property
    def note_log_rows(self) -> DataFrame:
        return parts.note_log_rows(self.note_diff, self._as_of)

    def _parts(self) -> dict:
        return {
            "HeaderChangeID": _part(parts.header_change(null_safe=self._null_safe), "_header_max"),
            "DetailGroupChangeID": (F.col("_lines_differ"), "_group_max", details.next_group()),
            "ClientPartnerChangeID": _part(parts.partner_change(null_safe=self._null_safe), "_partner_max"),
            "NoteChangeID": _part(parts.note_change(null_safe=self._null_safe), "_note_max"),
        }

    @cached_property
    def change_log_rows(self) -> DataFrame:
        return changelog.change_log_rows(self.packages, self._parts(), self._as_of)

    @property
    def _versioned(self) -> Column:
        return reduce(lambda a, b: a | b, [c for c, _, _ in self._parts().values()])

    @cached_property
    def changed(self) -> DataFrame:
        """Packages that get a version."""
        return self.packages.where(self._versioned).select("PackageID")

    @cached_property
    def change_items_rows(self) -> DataFrame:
        return details.change_items_rows(*self._both, self._versioned, self._post_image)

    # New current rows of the submitted packages

    @cached_property
    def current_rows(self) -> dict[str, DataFrame]:
        return {
            "header": parts.header_rows(self.header_diff),
            "detail": details.detail_rows(self.line_actions),
            "partner": parts.partner_rows(self.partner_diff),
            "note": parts.note_rows(self.note_diff),
        }

    @cached_property
    def log_rows(self) -> dict[str, DataFrame]:
        return {
            "header_log": self.header_log_rows, "detail_log": self.detail_log_rows,
            "partner_log": self.partner_log_rows, "note_log": self.note_log_rows,
            "change_log": self.change_log_rows, "change_items": self.change_items_rows,
        }

    @property
    def all_log_rows(self) -> dict[str, DataFrame]:
        return self.log_rows

    def new_table(self, name: str) -> DataFrame:
        """A whole current table after the batch."""
        return replace_packages(getattr(self.tables, name), self.accepted, self.current_rows[name])

    # Answers

    @cached_property
    def row_messages(self) -> DataFrame:
        return self.messages(self.detail_diff)

    @cached_property
    def measures(self) -> DataFrame:
        return changelog.save_measures(self.accepted, self.lines, self.base_item_id)

    def dry_run(self) -> DataFrame:
        """What the batch would write and refuse, as row counts per frame; nothing is written."""
        return _counts({"refused": self.refused, **self.current_rows, **self.log_rows})


class SoftSaveBatch(CheckedBatch):
    """Second schema: rows are marked inactive, headers always change, logs hold the new values."""

    def __init__(self, client: DataFrame, item: DataFrame, tables: SoftTables, batch: DataFrame, lines: DataFrame | None,
                 as_of=None, base_item_id: int = BASE_ITEM_ID, null_safe: bool = False, highest: int | None = None, once: bool = False):
        super().__init__(client, item, tables.header, batch, lines, highest, once)
        self.tables, self.base_item_id = tables, base_item_id
        self._as_of, self._null_safe = as_of_column(as_of), null_safe

    def _line_plan(self) -> DataFrame:
        t = self.tables
        frame = tagged.line_frame(self.accepted, self.lines, t.detail, t.detail_log, {"Inactive": "OldInactive", "ChangeID": "OldChangeID"},
                                  {"ChangeID": "_item_max"})
        return details.line_actions_soft(frame, self._null_safe)

    def _package_plan(self, lines: DataFrame) -> DataFrame:
        t = self.tables
        return tagged.package_frame(
            self.accepted, lines, t.header, t.partner, t.note, t.header_log, t.partner_log, t.note_log, t.change_log,
            {"header": "ChangeID", "partner": "ChangeID", "note": "ChangeID"}, soft=True)

    @cached_property
    def detail_diff(self) -> DataFrame:
        return details.diff_details_soft(self.line_actions)

    @cached_property
    def header_diff(self) -> DataFrame:
        return parts.diff_header(self.packages, "ChangeID", detect_change=False)

    @cached_property
    def partner_diff(self) -> DataFrame:
        return parts.diff_partner(self.packages, "ChangeID", True, self._null_safe)

    @cached_property
    def note_diff(self) -> DataFrame:
        return parts.diff_note(self.packages, "ChangeID", True, self._null_safe)

    @cached_property
    def log_rows(self) -> dict[str, DataFrame]:
        return {
            "header_log": parts.header_log_rows_soft(self.header_diff),
            "detail_log": details.detail_log_rows_post(self.line_actions),
            "partner_log": parts.partner_log_rows_soft(self.partner_diff),
            "note_log": parts.note_log_rows_soft(self.note_diff),
        }

    @cached_property
    def current_rows(self) -> dict[str, DataFrame]:
        return {
            "header": parts.header_rows_soft(self.header_diff),
            "detail": details.detail_rows_soft(self.line_actions),
            "partner": parts.partner_rows_soft(self.partner_diff),
            "note": parts.note_rows_soft(self.note_diff),
        }

    @cached_property
    def change_log_rows(self) -> DataFrame:
        return changelog.change_log_rows(self.packages, {
            "HeaderChangeID": _part(parts.header_change("ChangeID", detect_change=False), "_header_max"),
            "ClientPartnerChangeID": _part(parts.partner_change("ChangeID", True, self._null_safe), "_partner_max"),
            "NoteChangeID": _part(parts.note_change("ChangeID", True, self._null_safe), "_note_max"),
            ".lines": (F.col("_lines_differ"), "", F.lit(None)),
        }, self._as_of)

    @property
    def all_log_rows(self) -> dict[str, DataFrame]:
        return {**self.log_rows, "change_log": self.change_log_rows}

    def dry_run(self) -> DataFrame:
        """What the batch would write and refuse, as row counts per frame; nothing is written."""
        return _counts({"refused": self.refused, **self.current_rows, **self.all_log_rows})

    def new_table(self, name: str) -> DataFrame:
        return replace_packages(getattr(self.tables, name), self.accepted, self.current_rows[name])

    @cached_property
    def row_messages(self) -> DataFrame:
        """A line switched to inactive has no submitted row, so it has no message."""
        return self.messages(self.detail_diff)

    @cached_property
    def measures(self) -> DataFrame:
        return changelog.save_measures(self.accepted, self.lines, self.base_item_id)
