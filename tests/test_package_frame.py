"""The package frame: lines and logs are hashed, only rows with structs are sorted."""

from leasebook.operators import tagged

ACCEPTED = """SELECT * FROM VALUES (1L, 7L, 'here', DATE '2020-01-01', DATE '2021-01-01', 0.1, 3, 8L, 0.2, 'text', 'clerk'),
  (2L, 7L, 'there', DATE '2020-01-01', DATE '2021-01-01', 0.1, 3, NULL, 0.2, '', 'clerk')
  t(PackageID, ClientID, Location, LicenseStartDate, LicenseExpirationDate, PackageDiscount, UserMinimum, ClientPartnerID, PartnerSplit, Note, LoginName)"""
LINES = """SELECT * FROM VALUES (1L, 5L, 'NONE', 2.0, 1, 2.0, 1, 4), (1L, 6L, 'UPDATE', 2.0, 1, 3.0, 1, 2), (3L, 5L, 'INSERT', NULL, NULL, 1.0, 1, NULL)
  t(PackageID, ItemID, Action, OldPrice, OldQuantity, NewPrice, NewQuantity, _group_max)"""


def test_lines_and_logs_are_not_sorted(spark):
    accepted = spark.sql(ACCEPTED)
    lines = spark.sql(LINES).selectExpr("*", "0.0 AS OldDiscount", "0.0 AS NewDiscount", "0.0 AS OldLicenseFactor", "0.0 AS NewLicenseFactor")
    header = accepted.where("PackageID = 1").selectExpr("*", "4 AS HeaderChangeID", "0 AS Inactive")
    partner = spark.sql("SELECT 1L AS PackageID, 8L AS ClientPartnerID, 0.2 AS PartnerSplitPercentage, 6 AS ClientPartnerChangeID")
    note = spark.sql("SELECT 9L AS PackageID, 'old' AS Note, 1 AS NoteChangeID")
    changes = spark.sql("SELECT * FROM VALUES (1L, 2), (1L, 5), (3L, 9), (CAST(NULL AS BIGINT), 9) t(PackageID, ChangeID)")
    frame = tagged.package_frame(accepted, lines, header, partner, note, header, partner, note, changes,
                                 {"header": "HeaderChangeID", "partner": "ClientPartnerChangeID", "note": "NoteChangeID"})
    rows = {r["PackageID"]: r for r in frame.collect()}
    assert set(rows) == {1, 2}
    one, two = rows[1], rows[2]
    assert (one["_lines_differ"], one["DetailsChanged"], one["_group_max"], one["NextChangeID"]) == (True, True, 4, 6)
    assert (one["_header_max"], one["_partner_max"], one["_note_max"], one["new"]["Location"], one["header"]["HeaderChangeID"]) == (4, 6, None, "here", 4)
    assert one["note"] is None and two["header"] is None and two["_lines_differ"] is None and two["NextChangeID"] == 1
    plan = frame._jdf.queryExecution().executedPlan().toString()
    sorted_rows = [line for line in plan.splitlines() if "SortAggregate" in line]
    assert sorted_rows and not any("_lines_differ" in line or "_version_max" in line for line in sorted_rows)
