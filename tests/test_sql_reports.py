"""Reports and rules called from SQL against the DataFrame forms."""

import pytest
from pyspark.sql import functions as F

from leasebook.functions.text import contains_text, is_blank
from leasebook.operators import expiring, versions
from leasebook.plans.sql_reports import register_reports
from tests.frames import tables
from tests.test_functions import TEXTS


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def t(spark):
    t = tables(spark)
    register_reports(spark, t)
    return t


@pytest.mark.parametrize("call,args", [
    ("", ()), ("'2019-01', '2020/01'", ("2019-01", "2020/01")), ("'', '', 'acm'", ("", "", "acm")), ("partner_text => 'b_lt'", ("", "", "", "b_lt")),
    ("'2025-01'", ("2025-01",)), ("NULL, NULL, '[a-c]c'", (None, None, "[a-c]c")), ("'2020-01', '2019-01'", ("2020-01", "2019-01")),
])
def test_expiring_packages(spark, t, call, args):
    assert _rows(spark.sql(f"SELECT * FROM expiring_packages({call})")) == _rows(expiring.expiring_finder(t, *args))


def test_expiring_clients(spark, t):
    assert _rows(spark.sql("SELECT * FROM expiring_clients()")) == _rows(expiring.expiring_client_info(t))
    assert _rows(spark.sql("SELECT * FROM expiring_clients('2019-01', '2022-01', 'bolt')")) == _rows(
        expiring.expiring_client_info(t, "2019-01", "2022-01", "bolt"))


def test_unreadable_months_raise_the_notice(spark, t):
    with pytest.raises(Exception, match="start date filter entered could not be interpreted, the end date"):
        spark.sql("SELECT * FROM expiring_packages('2020.01', '2020-13')").collect()


def test_one_package_and_one_version(spark, t):
    asked = [(r[0], None) for r in t.header.select("PackageID").collect()] + [
        (r[0], r[1]) for r in t.change_log.select("PackageID", "ChangeID").collect()] + [(-5, None), (-5, 3)]
    for package, change in asked:
        request = spark.createDataFrame([(1, package, change)], "request_id long, PackageID long, ChangeID long")
        call = f"{package}, {'NULL' if change is None else change}"
        for name, report in (("package_view", versions.viewer_header), ("package_lines", versions.viewer_items)):
            assert _rows(spark.sql(f"SELECT * FROM {name}({call})")) == _rows(report(request, t).drop("request_id"))


def test_filters_reach_the_headers(spark, t):
    plan = spark.sql("SELECT * FROM expiring_packages('2019-01', '2020-01')")._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 2019-01-01" in plan and "raise_error" not in plan


def test_rules(spark, t):
    df = spark.createDataFrame([(x,) for x, _, _ in TEXTS], "t string")
    assert [tuple(r) for r in df.selectExpr("t", "year_month(t)", "year_month_error(t)").collect()] == TEXTS
    assert tuple(spark.sql("SELECT month_difference(DATE'2019-01-01', DATE'2019-12-31'), is_yes(' y'), is_yes('YES '), is_yes(NULL)").first()) == (
        11, False, True, False)
    names = spark.createDataFrame([(n,) for n in ["name one", "Name Two", "dot.t", "back\\slash", "a]b^c", "5%", None]], "n string")
    for text in ["", " ", "NAME", "%one", "e_o", "[ot]", "[^a-z ]", "\\", ".", "[", "[]", "[^]", "[a^]", "]", "\\Q", "\\E", "[a-c]k", "^"]:
        found = names.select("n", F.expr("contains_text(n, '{}')".format(text.replace("\\", "\\\\"))).alias("got"))
        want = names.select("n", F.lit(True) if is_blank(text) else F.coalesce(contains_text(F.col("n"), text), F.lit(False)))
        assert found.collect() == [tuple(r) for r in want.collect()], text
