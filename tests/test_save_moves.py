"""A batch moves no more than its outputs need."""

import datetime as dt
from decimal import Decimal as D

from leasebook.operators import submissions as sub
from leasebook.plans import save
from leasebook.plans.save import SaveBatch
from tests.frames import batch, rows, same_lines, submission, tables

DAY = dt.date(2024, 2, 29)
SUBMITTED = [submission(1, 10, "core", " ", "NORTH ", 6, note=""), submission(2, 0), submission(3, 11, "Bolt", "", None), submission(3, 11)]
LINES = same_lines() + [(1, 3, "50%_[x]", D(30), 1, D(0), D(0)), (2, 1, "base", D(1), 1, D(0), D(0)), (2, 2, "BASE", D(1), 1, D(0), D(0))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_not_shuffled_to_meet_a_few_repeated_items(spark):
    _, lines = batch(spark, SUBMITTED, LINES)
    checked = sub.validate_lines(sub.resolve_items(lines, tables(spark).item))
    assert "hashpartitioning(submission_id" not in plan_of(checked)
    assert [r[0] for r in rows(checked.where("LineErrors <> ''"), "submission_id")] == [2, 2]


def test_names_are_left_behind_when_resolved(spark):
    b = SaveBatch(tables(spark), *batch(spark, SUBMITTED, LINES), DAY)
    assert "ItemName" not in b.checked_lines.columns and not {"ClientName", "ClientPartnerName"} & set(b.accepted.columns)


def test_one_output_is_not_written_before_it_is_read(spark, monkeypatch):
    staged = []
    write = save.stage
    monkeypatch.setattr(save, "stage", lambda df: staged.append(df.columns) or write(df))
    make = lambda **o: SaveBatch(tables(spark), *batch(spark, SUBMITTED, LINES), DAY, **o)
    one, all_of_it = make(once=True), make()
    for name in ("detail_diff", "detail_log_rows", "header_log_rows", "change_log_rows", "change_items_rows", "row_messages", "refused"):
        assert rows(getattr(one, name)) == rows(getattr(all_of_it, name)), name
    staged.clear()
    rows(make(once=True).new_table("detail"))
    assert not [c for c in staged if "Action" in c or "new" in c]


def test_documents_are_parsed_once(spark, monkeypatch):
    subs, _ = batch(spark, [submission(1, 10), submission(2, 11)], [])
    docs = subs.selectExpr("*", "CASE submission_id WHEN 1 THEN '<Root><r><Row>1</Row><ItemName>Base</ItemName><ItemPrice>9</ItemPrice>"
                                "<Quantity>2</Quantity></r></Root>' ELSE '<Root><r>' END AS LinesXml")
    parsed = []
    parse = sub.parsed_documents
    monkeypatch.setattr(sub, "parsed_documents", lambda df: parsed.append(1) or parse(df))
    b = SaveBatch(tables(spark), docs, None, DAY)
    assert rows(b.refused) == [(2, sub.BAD_DOCUMENT)] and rows(b.detail_diff, "ItemID", "Action")[0] == (5, "UPDATE")
    assert len(parsed) == 1 and "from_xml" not in plan_of(b.checked_lines)
