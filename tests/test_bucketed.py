"""Bucketed package tables give the same reports without a shuffle by package."""

import re

import pytest

from leasebook.operators import costs, expiring
from leasebook.operators.tagged import line_frame
from leasebook.sources.bucketed import bucketed_tables, write_bucketed
from tests.frames import rows, tables


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    t = tables(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name in ("header", "detail", "partner", "note", "header_log", "detail_log", "partner_log", "note_log", "change_log"):
        spark.sql(f"DROP TABLE IF EXISTS bucketed_test_{name}")
    write_bucketed(t, "bucketed_test", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield t, bucketed_tables(spark, "bucketed_test", t)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name in ("header", "detail", "partner", "note", "header_log", "detail_log", "partner_log", "note_log", "change_log"):
        spark.sql(f"DROP TABLE IF EXISTS bucketed_test_{name}")


def shuffled_by(df):
    """Keys of the exchanges in the plan."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def package_only(keys):
    return [k for k in keys if re.fullmatch(r"PackageID#\d+L?, \d+", k)]


def test_renewal_cost(both):
    plain, t = both
    make = lambda x: costs.renewal_cost(x.detail, x.header)
    assert package_only(shuffled_by(make(plain))) and not package_only(shuffled_by(make(t)))
    assert sorted(map(str, make(plain).collect())) == sorted(map(str, make(t).collect()))


def test_expiring_finder(both):
    """Lines are not shuffled; headers and partners are, by package, after they have met a client table too large to broadcast."""
    plain, t = both
    make = lambda x: expiring.expiring_finder(x, sort=False)
    assert len(package_only(shuffled_by(make(plain)))) == 3 and len(package_only(shuffled_by(make(t)))) == 2
    assert sorted(map(str, make(plain).collect())) == sorted(map(str, make(t).collect()))


def test_line_comparison(spark, both):
    plain, t = both

    def make(x):
        accepted = x.header.select("PackageID")
        lines = x.detail.selectExpr("PackageID", "ItemID", "1 AS RowNo", "Price AS ItemPrice", "Quantity", "Discount AS ItemDiscount", "LicenseFactor")
        return line_frame(accepted, lines, x.detail, x.detail_log, {}, {"DetailItemChangeID": "_item_max"})

    assert package_only(shuffled_by(make(plain))) and not package_only(shuffled_by(make(t)))
    assert sorted(map(str, make(plain).collect())) == sorted(map(str, make(t).collect()))
    assert rows(make(t), "PackageID")
