import dataclasses
import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from leasebook.functions.dates import UserInputError
from leasebook.operators import costs, expiring, finder, lookups, padding, versions
from leasebook.operators.finder import FinderSearch
from tests.frames import rows, tables


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark)


def test_renewal_cost_months_discount_and_null_price(t):
    got = dict(rows(costs.renewal_cost(t.detail, t.header)))
    # 11 months x (2 x 10.5 + 10) x 0.9; the only line of package 11 has no price.
    assert got == {10: D("306.9"), 11: None}


def test_expiring_finder_end_month_is_its_first_day(t):
    assert rows(expiring.expiring_finder(t, "2019-01", "2019-12"), "PackageID") == []
    assert rows(expiring.expiring_finder(t, "2019-01", "2020/01"), "PackageID") == [(10,)]
    got = rows(expiring.expiring_finder(t), "PackageID", "ClientPartnerName", "LicensedUsers", "BasePrice", "CalculatedRenewalCost")
    assert got == [(10, "Bolt", 2, D(10), D("306.9")), (11, None, 0, None, D(0))]
    assert [r.PackageID for r in expiring.expiring_finder(t).collect()] == [10, 11]


def test_expiring_finder_needs_both_bounds_and_filters_text(t):
    assert expiring.expiring_finder(t, "2025-01", "").count() == 2
    assert rows(expiring.expiring_finder(t, client_text="ACM"), "PackageID") == [(10,)]
    assert rows(expiring.expiring_finder(t, partner_text="bolt"), "PackageID") == [(10,)]
    with pytest.raises(UserInputError):
        expiring.expiring_finder(t, "2020.01")


def test_client_info_null_location_gives_null_key(t):
    assert rows(expiring.expiring_client_info(t), "ClientLocationKey", "ClientName") == [("1-North", "Acme"), (None, "Bolt")]


def test_package_info_blank_partner_switches_date_filter_off(t):
    got = expiring.expiring_package_info(t, "1990-01", "1990-02").collect()
    assert [r.PackageID for r in got] == [11, 10]  # latest expiry of the client first
    assert expiring.expiring_package_info(t, "1990-01", "1990-02", "bolt").count() == 0


def test_finder_current_and_inactive(t):
    assert rows(finder.finder_current(t), "PackageID", "ChangeID", "Status") == [(10, 1, "Active")]
    both = rows(finder.finder_current(t, FinderSearch(inactive="y")), "PackageID", "ChangeID", "Status", "Note")
    assert both == [(10, 1, "Active", "first"), (11, 2, "Inactive", None)]


def test_history_cost_counts_each_line_once_per_version(t):
    got = rows(costs.history_cost(t.detail_log, t.header_log), "PackageID", "LicenseExpirationDate", "TotalPackageCost")
    assert got == [(10, dt.date(2019, 12, 31), D("306.9")), (11, dt.date(2019, 10, 30), D(540)), (11, dt.date(2020, 1, 31), D(180))]
    v0 = rows(costs.history_cost_v0(t.detail_log, t.header_log))
    assert v0 == [(10, D(341)), (11, D(360))]


def test_history_repeats_per_cost_only_in_its_first_form(t):
    got = rows(finder.finder_history(t, by_version_cost=False), "PackageID", "ChangeID", "TotalPackageCost", "LicensedUsers", "ClientPartnerName")
    assert got == [(10, 1, D("306.9"), 2, "Bolt"), (11, 1, D(180), None, None), (11, 1, D(540), None, None),
                   (11, 2, D(180), None, None), (11, 2, D(540), None, None)]
    exact = rows(finder.finder_history(t), "PackageID", "ChangeID", "TotalPackageCost")
    assert exact == [(10, 1, D("306.9")), (11, 1, D(270)), (11, 2, D(90))]


def test_finder_all_sorted_and_history_off(t):
    assert finder.finder_all(t).count() == 1
    got = finder.finder_all(t, FinderSearch(history="yes", inactive="1")).collect()
    keys = [(r.ClientName, r.ClientPartnerName or "", r.PackageID, r.ChangeID) for r in got]
    assert keys == sorted(keys) and len(got) == 5
    assert finder.finder_all(t, FinderSearch(history="yes", inactive="1"), by_version_cost=False).count() == 7


def test_blank_dates_bound_nothing_unless_asked(t):
    header = t.header.withColumn("LicenseExpirationDate", F.when(F.col("PackageID") == 10, F.lit(dt.date(9999, 12, 31))))
    open_ = dataclasses.replace(t, header=header)
    assert rows(finder.finder_current(open_, FinderSearch(inactive="y")), "PackageID") == [(10,), (11,)]
    assert rows(finder.finder_current(open_, FinderSearch(inactive="y", open_years=100)), "PackageID") == []


def test_finder_v0_drops_missing_location(t):
    got = rows(finder.finder_v0(t, FinderSearch(history="1", inactive="1")), "PackageID", "ChangeID", "TotalPackageCost")
    assert got == [(10, 0, D("306.9")), (10, 1, D(341))]


def requests(spark, *pairs):
    data = [(i, p, c) for i, (p, c) in enumerate(pairs)]
    return spark.createDataFrame(data, "request_id int, PackageID bigint, ChangeID int")


def test_requests_route_to_history_current_or_error(spark, t):
    q = requests(spark, (10, 1), (10, 0), (10, None), (10, 9), (99, 0), (0, 0), (0, 3))
    viewed = rows(versions.viewer_header(q, t), "request_id", "BillingEmail", "PackageTerm")
    assert viewed == [(0, None, 11), (1, "ann@acme", 11), (2, "ann@acme", 11)]
    errors = rows(versions.request_errors(q, t), "request_id", "ErrorText")
    assert [e[0] for e in errors] == [3, 4, 6]
    assert 'ID entered ("10") does not have a history entry #9.' in errors[0][1]
    assert 'ID entered ("99") does not exist.' in errors[1][1]
    header = rows(versions.previous_header(q, t), "request_id", "ClientPartnerName", "LicensedUsers", "Note")
    assert header == [(i, "Bolt", 2, "first") for i in (0, 1, 2)]


def test_unknown_items_drop_from_viewer_but_stay_in_previous(spark):
    t = tables(spark, item=[(5, "Base", D(10), 1)])
    q = requests(spark, (10, 1), (10, 0))
    assert rows(versions.viewer_items(q, t), "request_id", "ItemName") == [(0, "Base"), (1, "Base")]
    assert versions.previous_items(q, t).count() == 4
    assert versions.package_line_items(q, t).count() == 4


def renewals(spark, *rows_):
    return spark.createDataFrame(list(rows_), "request_id int, LicensePackageID bigint, PrevPackageID bigint,"
                                 " PrevChangeID int, AutofillHeader string, AutofillItems string, EditingMode string")


def test_active_renewal(spark, t):
    q = renewals(spark, (0, 10, 11, 1, "no", "no", ""), (1, 10, 11, 1, "yes", "y", ""), (2, 10, 11, 7, "Y", "1", ""),
                 (3, 10, 11, None, "1", "yes", "yes"))
    dates = rows(versions.active_header(q, t), "request_id", "DefaultPackageStartDate", "DefaultPackageEndDate")
    assert dates == [(0, dt.date(2019, 1, 1), dt.date(2019, 12, 31)), (1, dt.date(2019, 10, 31), dt.date(2020, 7, 31)),
                     (2, dt.date(2020, 2, 1), dt.date(2020, 5, 1)), (3, dt.date(2020, 2, 1), dt.date(2020, 5, 1))]
    items = versions.active_items(q, t)
    assert {r.request_id: r.n for r in items.groupBy("request_id").agg(F.count("*").alias("n")).collect()} == {0: 7, 1: 7, 2: 6, 3: 6}
    assert items.where("ItemName = '' AND ItemPrice IS NULL").count() == 20
    edited = rows(versions.active_header_editing(q.where("request_id = 3"), t), "LicensedUsers", "DefaultPackageStartDate")
    assert edited == [(2, dt.date(2019, 1, 1))]
    assert rows(versions.active_identity(q, t), "request_id", "ClientName", "ClientPartnerName")[0] == (0, "Acme", "Bolt")


def test_active_v0_needs_base_item_and_keeps_empty_package(spark):
    t = tables(spark, detail=[(10, 5, D(10), 2, D("0.5"), D("0.1"), 1)])
    q = renewals(spark, (0, 11, 10, 0, "no", "no", ""), (1, 11, 10, 0, "yes", "yes", ""), (2, 11, 10, 0, "", "", "yes"))
    assert rows(versions.active_header_v0(q, t, dt.date(2024, 1, 2)), "request_id", "DefaultPackageStartDate") == [
        (1, dt.date(2024, 1, 2)), (2, dt.date(2024, 1, 2))]
    assert rows(versions.active_items_v0(q, t), "request_id", "ItemName", "ItemPrice") == [(0, None, None), (1, "Base", D(11))]


def test_lookups_and_padding(spark, t):
    assert rows(lookups.inventory_search(t.item, t.item_log, "BA"), "ItemID", "Updated") == [(5, dt.date(2019, 6, 1))]
    assert lookups.inventory_search(t.item, t.item_log, "  ").count() == 3
    assert rows(lookups.item_lookup(t.item, "[[]x")) == [("50%_[x]",)]
    assert rows(lookups.client_lookup(t.client, "o")) == [("Bolt",), ("Core",)]
    assert lookups.partner_lookup(t.client).columns == ["ClientPartnerName"]
    names = spark.createDataFrame([("ACME ",), ("nobody",)], "ClientName string")
    assert rows(lookups.location_lookup(t.header_log, t.client, names)) == [("ACME ", "North")]
    keys = spark.createDataFrame([(1,)], "request_id int")
    assert padding.end_of_list_rows(keys).where("EndOfListKey = 'END_OF_LIST' AND Quantity = ''").count() == 5
    lines = spark.createDataFrame([(1, "a", D(1), 2, D(0), D(0))], "request_id int, ItemName string, ItemPrice decimal(19,4),"
                                  " Quantity int, ItemDiscount decimal(5,4), LicenseFactor decimal(5,4)")
    assert padding.pad_empty_text_rows(lines, keys).where("Quantity = ''").count() == 5


def test_hot_package_is_split_over_tasks(spark):
    """A third of all lines in one package: adaptive execution splits its join partition."""
    lines = spark.range(300_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 10 ELSE id END AS PackageID", "id AS ItemID", "CAST(1 AS DECIMAL(19,4)) AS Price",
        "1 AS Quantity", "CAST(0 AS DECIMAL(5,4)) AS Discount", "CAST(0 AS DECIMAL(5,4)) AS LicenseFactor")
    requests = spark.range(300_000).selectExpr("id AS request_id", "id AS PackageID")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "400KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16"}
    before = {k: spark.conf.get(k) for k in conf if k != "spark.sql.adaptive.coalescePartitions.initialPartitionNum"}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        joined = versions._current_lines(requests, lines)
        assert len(joined.collect()) == 300_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
