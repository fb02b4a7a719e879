import dataclasses
import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from leasebook.model import SOFT_COLUMNS, SoftTables
from leasebook.operators import log_state
from leasebook.operators import submissions as sub
from leasebook.plans.save import SaveBatch, SoftSaveBatch
from leasebook.sources.staging import stage
from leasebook.sources.store import PackageStore, SoftPackageStore
from tests.frames import batch, rows, same_lines, submission, tables

DAY = dt.date(2024, 2, 29)


def plan(spark, subs, lines, t=None, **options):
    return SaveBatch(t or tables(spark), *batch(spark, subs, lines), DAY, **options)


def test_parse_lines(spark):
    docs = [
        (1, "<Root><r><Row>4</Row><ItemName>A &amp; B</ItemName><ItemPrice>1.5</ItemPrice><Quantity> 2 </Quantity>"
            "<ItemDiscount/></r><r><Row>5</Row></r></Root>"),
        (2, "<Root><r><Row>1</Row>"), (3, "<Root><r><Row>x</Row></r><r><Row>2</Row></r></Root>"), (4, "<Root></Root>"),
        (5, ""), (6, None), (7, "<Root><r><ItemDiscount>12.5</ItemDiscount></r></Root>"),
    ]
    df = spark.createDataFrame(docs, "submission_id bigint, LinesXml string")
    assert rows(sub.parse_lines(df)) == [(1, 4, "A & B", D("1.5"), 2, None, None), (1, 5, None, None, None, None, None)]
    assert rows(sub.parse_errors(df)) == [(2, sub.BAD_DOCUMENT), (3, sub.BAD_VALUE), (7, sub.BAD_VALUE)]


def test_unchanged_submission_writes_nothing(spark):
    b = plan(spark, [submission(1, 10)], same_lines())
    assert all(frame.count() == 0 for frame in b.log_rows.values())
    assert rows(b.row_messages) == [(1, 1, ""), (1, 2, "")]
    for name in ("header", "detail", "partner", "note"):
        assert rows(b.new_table(name)) == rows(getattr(b.tables, name).select(*b.new_table(name).columns))


def test_line_actions_logs_and_messages(spark):
    lines = [(1, 1, "base ", D(10), 3, D(0), D("0.05")), (1, 2, "50%_[x]", D(30), 1, D(0), D(0))]
    b = plan(spark, [submission(1, 10)], lines)
    assert rows(b.detail_diff, "ItemID", "Action") == [(5, "UPDATE"), (6, "DELETE"), (7, "INSERT")]
    assert rows(b.detail_log_rows, "ItemID", "DetailItemChangeID", "DetailGroupChangeID", "Quantity", "Operation") == [
        (5, 2, 2, 2, "UPDATE"), (6, 2, 2, 1, "DELETE"), (7, 1, 2, 1, "INSERT")]
    assert rows(b.new_table("detail").where("PackageID = 10"), "ItemID", "Quantity", "DetailItemChangeID") == [(5, 3, 2), (7, 1, 1)]
    assert rows(b.row_messages) == [(1, 1, "Updated!"), (1, 2, "Added!")]
    assert rows(b.change_log_rows) == [(10, 2, 1, 2, 1, 1, DAY, "me")]
    # Membership is taken before the change, as first written, and after it on request.
    assert rows(b.change_items_rows) == [(10, 2, 5, 1), (10, 2, 6, 1)]
    after = plan(spark, [submission(1, 10)], lines, post_image=True)
    assert rows(after.change_items_rows) == [(10, 2, 5, 2), (10, 2, 7, 2)]
    assert rows(b.measures) == [(1, 10, 3, D(10))]


def test_submission_that_only_adds_is_no_line_change(spark):
    b = plan(spark, [submission(1, 10)], same_lines() + [(1, 3, "50%_[x]", D(30), 1, D(0), D(0))])
    assert rows(b.change_items_rows) == [(10, 2, 5, 1), (10, 2, 6, 1), (10, 2, 7, 2)]


def test_readded_item_continues_its_log_ids(spark):
    lines = [(1, 1, "Reports", D(1), 3, D(0), D(0)), (1, 2, "50%_[x]", D(30), 1, D(0), D(0))]
    b = plan(spark, [submission(1, 11, "Bolt", "", None)], lines)
    assert rows(b.new_table("detail").where("PackageID = 11"), "ItemID", "Price", "DetailItemChangeID") == [
        (6, None, 1), (7, D(30), 3)]  # NULL against a value is no difference
    safe = plan(spark, [submission(1, 11, "Bolt", "", None)], lines, null_safe=True)
    assert rows(safe.new_table("detail").where("PackageID = 11"), "ItemID", "Price", "DetailItemChangeID") == [
        (6, D(1), 2), (7, D(30), 3)]


def test_header_partner_and_note_changes(spark):
    b = plan(spark, [submission(1, 10, "core", " ", "NORTH ", 6, note="")], same_lines())
    assert rows(b.new_table("header").where("PackageID = 10"), "ClientID", "UserMinimum", "HeaderChangeID", "Inactive") == [(300, 6, 2, 0)]
    assert rows(b.header_log_rows, "ClientID", "UserMinimum", "HeaderChangeID", "Operation") == [(1, 5, 2, "UPDATE")]
    assert b.new_table("partner").count() == 0
    assert rows(b.partner_log_rows) == [(10, 2, 2, D("0.2"), "DELETE")]
    assert rows(b.new_table("note")) == [(10, "", 2)]
    assert rows(b.note_log_rows) == [(10, 2, "first", "UPDATE", 2, DAY, "me")]
    assert rows(b.change_log_rows) == [(10, 2, 2, 1, 2, 2, DAY, "me")]
    # Only other parts changed, so membership is written last.
    assert rows(b.change_items_rows) == [(10, 2, 5, 1), (10, 2, 6, 1)]


def test_case_and_trailing_blanks_are_no_change(spark):
    b = plan(spark, [submission(1, 10, "ACME", "BOLT", "north ", note="FIRST ")], same_lines())
    assert b.changed.count() == 0


def test_new_packages_are_numbered_in_order(spark):
    subs = [submission(9, 0), submission(3, 77), submission(4, 10)]
    lines = [(9, 1, "Base", D(1), 4, D(0), D(0))] + same_lines(4)
    b = plan(spark, subs, lines)
    assert rows(b.accepted, "submission_id", "PackageID", "IsNew") == [(3, 12, True), (4, 10, False), (9, 13, True)]
    assert rows(b.header_log_rows, "PackageID", "HeaderChangeID", "PackageDiscount", "Inactive", "Operation") == [
        (12, 1, D("0.1"), 0, "INSERT"), (13, 1, D("0.1"), 0, "INSERT")]
    assert rows(b.change_items_rows) == [(13, 1, 5, 1)]
    assert rows(b.change_log_rows, "PackageID", "ChangeID", "DetailGroupChangeID", "ClientPartnerChangeID") == [
        (12, 1, None, 1), (13, 1, 1, 1)]
    empty = tables(spark, header=[])
    assert rows(sub.assign_package_ids(batch(spark, [submission(1, 0)], [])[0], empty.header), "FinalPackageID") == [(1,)]


def test_refused_submissions_do_not_stop_others(spark):
    subs = [submission(1, 0, "Nobody"), submission(2, 0, "Acme", "Nobody"), submission(3, 0), submission(4, 11, "Bolt"),
            submission(5, 11, "Bolt"), submission(6, 10)]
    lines = [(1, 1, "??", None, 0, None, None), (3, 1, "Base", D(0), 1, None, None), (3, 2, "base", D(1), None, None, None),
             (3, 3, "??", D(1), 1, None, None), *same_lines(6)]
    b = plan(spark, subs, lines)
    assert rows(b.refused) == [(1, sub.UNKNOWN_CLIENT), (2, sub.UNKNOWN_PARTNER), (3, sub.BAD_LINES),
                               (4, sub.REPEATED_PACKAGE), (5, sub.REPEATED_PACKAGE)]
    duplicate, unknown = sub.DUPLICATE_ITEM[2:], sub.UNKNOWN_ITEM[2:]
    assert rows(b.row_messages) == [(1, 1, ""), (3, 1, duplicate + sub.BLANK_PRICE), (3, 2, duplicate + sub.BLANK_QUANTITY),
                                    (3, 3, unknown), (6, 1, ""), (6, 2, "")]
    assert rows(b.accepted, "submission_id") == [(6,)]
    assert dict(rows(b.dry_run()))["refused"] == 5


def test_submission_without_lines_removes_all(spark):
    b = plan(spark, [submission(1, 10)], [])
    assert rows(b.detail_diff, "ItemID", "Action") == [(5, "DELETE"), (6, "DELETE")]
    assert rows(b.new_table("detail"), "PackageID") == [(11,)]


def soft_tables(spark, inactive=0):
    t = tables(spark)
    pick = lambda df, old, flag: df.withColumnRenamed(old, "ChangeID").selectExpr("*", f"{flag} AS Inactive")
    log = lambda df, old: df.withColumnRenamed(old, "ChangeID")
    return t, SoftTables(
        header=t.header.withColumnRenamed("HeaderChangeID", "ChangeID"),
        detail=pick(t.detail, "DetailItemChangeID", f"CASE WHEN ItemID = 6 THEN {inactive} ELSE 0 END"),
        partner=pick(t.partner, "ClientPartnerChangeID", inactive), note=pick(t.note, "NoteChangeID", inactive),
        header_log=log(t.header_log, "HeaderChangeID"), detail_log=log(t.detail_log, "DetailItemChangeID"),
        partner_log=log(t.partner_log, "ClientPartnerChangeID"), note_log=log(t.note_log, "NoteChangeID"),
        change_log=t.change_log,
    )


def soft_plan(spark, subs, lines, inactive=0):
    t, soft = soft_tables(spark, inactive)
    return SoftSaveBatch(t.client, t.item, soft, *batch(spark, subs, lines), DAY)


def test_soft_removal_and_post_image_logs(spark):
    b = soft_plan(spark, [submission(1, 10, partner="", note="")], [(1, 1, "Base", D(10), 4, D(0), D("0.05"))])
    assert rows(b.new_table("detail").where("PackageID = 10"), "ItemID", "Quantity", "Inactive", "ChangeID") == [(5, 4, 0, 2), (6, 1, 1, 2)]
    assert rows(b.log_rows["detail_log"], "ItemID", "Quantity", "Inactive", "ChangeID", "Operation") == [
        (5, 4, 0, 2, "UPDATE"), (6, 1, 1, 2, "UPDATE")]
    assert rows(b.log_rows["partner_log"]) == [(10, 2, 2, D("0.2"), 1, "DELETE")]
    assert rows(b.log_rows["note_log"]) == [(10, 2, "first", "UPDATE", 1)]
    assert rows(b.log_rows["header_log"], "ChangeID", "Operation") == [(2, "UPDATE")]  # no change test
    assert rows(b.change_log_rows) == [(10, 2, 2, 2, 2, DAY, "me")]


def test_soft_resubmission_makes_active_again(spark):
    b = soft_plan(spark, [submission(1, 10)], same_lines(), inactive=1)
    assert rows(b.new_table("detail").where("PackageID = 10"), "ItemID", "Inactive", "ChangeID") == [(5, 0, 1), (6, 0, 2)]
    assert rows(b.new_table("partner"), "Inactive", "ChangeID") == [(0, 2)]
    assert rows(b.new_table("note"), "Inactive", "ChangeID") == [(0, 2)]
    again = soft_plan(spark, [submission(1, 10, partner="", note="")], [], inactive=1)
    assert rows(again.log_rows["detail_log"], "ItemID") == [(5,)]  # an inactive line is not logged again
    assert again.log_rows["partner_log"].count() == 0 and again.log_rows["note_log"].count() == 0


@pytest.fixture
def store(spark, tmp_path):
    s = PackageStore(spark, str(tmp_path / "store"), buckets=4)
    s.create(tables(spark))
    return s


CHANGE = ([submission(1, 10, note="second")], [(1, 1, "Base", D(10), 3, D(0), D("0.05")), (1, 2, "50%_[x]", D(30), 1, D(0), D(0))])


def state(t):
    names = ["header", "detail", "partner", "note", "header_log", "detail_log", "partner_log", "note_log", "change_log", "change_items"]
    return {n: rows(getattr(t, n)) for n in names}


def test_store_applies_a_batch_once(spark, store):
    before = state(store.tables())
    store.save(*batch(spark, *CHANGE), DAY)
    first = state(store.tables())
    assert first["note"] == [(10, "second", 2)] and len(first["detail"]) == 3 and first != before
    assert [r for r in first["header"] if r[0] == 11] == [r for r in before["header"] if r[0] == 11]
    store.save(*batch(spark, *CHANGE), DAY)
    assert state(store.tables()) == first  # the same submission again makes no version


def test_log_maxima_equal_current_ids(spark, store):
    store.save(*batch(spark, *CHANGE), DAY)
    t = store.tables()
    top = {(r.PackageID, r.ItemID): r.m for r in t.detail_log.groupBy("PackageID", "ItemID").agg({"DetailItemChangeID": "max"})
           .withColumnRenamed("max(DetailItemChangeID)", "m").collect()}
    assert all(top[r.PackageID, r.ItemID] == r.DetailItemChangeID for r in t.detail.where("PackageID = 10").collect())


def test_one_batch_equals_single_submissions(spark, store, tmp_path):
    subs = [CHANGE[0][0], submission(2, 0, note="x"), submission(3, 11, "Bolt", "Acme", "South")]
    lines = CHANGE[1] + [(2, 1, "Base", D(1), 4, D(0), D(0)), (3, 1, "Reports", D(2), 3, D(0), D(0))]
    store.save(*batch(spark, subs, lines), DAY)
    single = PackageStore(spark, str(tmp_path / "single"), buckets=4)
    single.create(tables(spark))
    for s in subs:
        single.save(*batch(spark, [s], [line for line in lines if line[0] == s[0]]), DAY)
    assert state(single.tables()) == state(store.tables())


def test_a_bucket_left_without_rows_is_overwritten(spark, tmp_path):
    s = PackageStore(spark, str(tmp_path / "wide"), buckets=4096)  # a bucket a package
    s.create(tables(spark))
    assert s.tables().detail.where("PackageID = 11").count()
    s.save(*batch(spark, [submission(1, 11, "Bolt")], []), DAY)
    after = state(s.tables())
    assert not [r for r in after["detail"] if r[0] == 11] and None not in {r[0] for n in after for r in after[n]}
    assert [r for r in after["detail"] if r[0] == 10] == [r for r in rows(tables(spark).detail.select(*s.columns["detail"])) if r[0] == 10]


def test_empty_batch_changes_nothing(spark, store):
    before = state(store.tables())
    subs, lines = batch(spark, *CHANGE)
    store.save(subs.where("false"), lines.where("false"), DAY)
    assert state(store.tables()) == before


def test_cut_off_document_leaves_the_package(spark, store):
    before = state(store.tables())
    subs = batch(spark, [submission(1, 10), submission(2, 11, "Bolt")], [])[0]
    docs = subs.withColumn("LinesXml", F.expr("CASE submission_id WHEN 1 THEN '<Root><r><Row>1' ELSE '<Root></Root>' END"))
    b = store.save(docs, None, DAY)
    assert rows(b.refused) == [(1, sub.BAD_DOCUMENT)]
    after = state(store.tables())
    assert [r for r in after["detail"] if r[0] == 10] == [r for r in before["detail"] if r[0] == 10]
    assert not [r for r in after["detail"] if r[0] == 11]


def test_submission_ids_are_required_and_unique(spark):
    subs, lines = batch(spark, [submission(1, 10), submission(1, 11, "Bolt"), submission(2, 0)], [])
    subs = subs.unionByName(subs.where("submission_id = 2").withColumn("submission_id", F.lit(None).cast("long")))
    b = SaveBatch(tables(spark), subs, lines, DAY)
    assert sorted(map(str, rows(b.refused))) == sorted(map(str, [
        (None, sub.NO_SUBMISSION_ID), (1, sub.REPEATED_SUBMISSION_ID), (1, sub.REPEATED_SUBMISSION_ID)]))


def test_batch_reads_and_writes_only_its_buckets(spark, store):
    subs, lines = batch(spark, *CHANGE)
    touched = store._touched(stage(subs))
    bucket = touched.first()[0]
    path = f"{store.root}/detail"
    assert "dynamicpruning" in store.tables(touched).detail._jdf.queryExecution().executedPlan().toString()
    assert store.tables(touched).detail.count() == spark.read.parquet(path).where(F.col("pkg_bucket") == bucket).count()
    files = lambda: {r[0] for r in spark.read.parquet(path).where(F.col("pkg_bucket") != bucket).select(F.input_file_name()).collect()}
    others = files()
    store.save(subs, lines, DAY)
    assert files() == others
    with pytest.raises(ValueError):
        PackageStore(spark, store.root, buckets=1 << 20)


def test_soft_store_saves_and_reloads(spark, tmp_path):
    t, soft = soft_tables(spark)
    flagged = {n: getattr(soft, n).withColumn("Inactive", F.lit(0)) for n in ("detail_log", "partner_log", "note_log")}
    soft = dataclasses.replace(soft, **flagged)
    s = SoftPackageStore(spark, str(tmp_path / "soft"), buckets=4)
    s.create(soft, t)
    again = SoftPackageStore(spark, str(tmp_path / "soft"), buckets=4)
    b = again.save(*batch(spark, [submission(1, 10, partner="", note=""), submission(2, 0)], [(1, 1, "Base", D(10), 4, D(0), D("0.05"))]), DAY)
    after = s.tables()
    assert rows(after.detail.where("PackageID = 10"), "ItemID", "Quantity", "Inactive", "ChangeID") == [(5, 4, 0, 2), (6, 1, 1, 2)]
    top = after.detail_log.where("PackageID = 10").groupBy("ItemID").agg(F.max_by("Quantity", "ChangeID").alias("Quantity"))
    assert rows(top, "ItemID", "Quantity") == [(5, 4), (6, 1)]
    assert rows(b.accepted, "PackageID") == [(10,), (12,)] and dict(rows(b.dry_run()))["refused"] == 0


SOFT_LOG = "PackageID long, ChangeID long, ItemID long, Price decimal(19,4), Quantity int, Discount decimal(5,4), LicenseFactor decimal(5,4), Inactive int"


def test_log_folds_to_the_latest_rows(spark):
    one = lambda p, c, i, q, gone=0: (p, c, i, D(1), q, D(0), None, gone)
    log = spark.createDataFrame([
        one(1, 1, 5, 3), one(1, 2, 5, 4), one(1, 10, 5, None, 1), one(1, 1, 6, 7), one(1, None, 6, 9), one(2, 1, 5, 1), one(2, 1, 5, 2),
        one(None, 1, 5, 1), one(3, 1, None, 8)], SOFT_LOG)
    assert rows(log_state.current_from_log(log, "detail"), "PackageID", "ItemID", "Quantity", "Inactive", "ChangeID") == [
        (1, 5, None, 1, 10), (1, 6, 7, 0, 1), (2, 5, 2, 0, 1), (3, None, 8, 0, 1)]
    earlier = log_state.current_from_log(log, "detail", F.col("ChangeID") <= 2)
    assert rows(earlier.where("PackageID = 1"), "ItemID", "Quantity") == [(5, 4), (6, 7)]
    assert log_state.current_from_log(log.where("false"), "detail").count() == 0


def test_drift_of_current_rows_from_their_log(spark):
    log = spark.createDataFrame([(1, 1, 5, D(1), 3, D(0), None, 0), (1, 1, 6, D(1), 3, D(0), None, 0), (1, 1, 7, D(1), 3, D(0), None, 0)], SOFT_LOG)
    current = log.where("ItemID < 7").withColumn("Quantity", F.expr("IF(ItemID = 6, NULL, Quantity)"))
    current = current.union(current.withColumn("ItemID", F.lit(8)).limit(1))
    assert rows(log_state.drift(current, log, "detail")) == [(1, 6, "differs"), (1, 7, "no row"), (1, 8, "no log")]


def test_logs_fold_to_what_a_batch_leaves(spark):
    t, soft = soft_tables(spark)
    logs = {f"{n}_log": getattr(soft, n).withColumn("Operation", F.lit("INSERT")) for n in log_state.KEYS}
    soft = dataclasses.replace(soft, **logs)
    b = SoftSaveBatch(t.client, t.item, soft, *batch(spark, [submission(1, 10, partner="", note="")], [(1, 1, "Base", D(10), 4, D(0), D("0.05"))]), DAY)
    for name in log_state.KEYS:
        columns = SOFT_COLUMNS[name]
        log = logs[f"{name}_log"].select(*columns).unionByName(b.log_rows[f"{name}_log"].select(*columns))
        assert rows(log_state.current_from_log(log, name)) == rows(b.new_table(name).select(*columns))
        assert log_state.drift(b.new_table(name), log, name).count() == 0
