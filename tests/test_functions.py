import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leasebook.functions.dates import (UserInputError, month_diff, parse_year_month, read_date_range, year_month_arg,
                                       year_month_error)
from leasebook.functions.joins import lookup_join
from leasebook.functions.money import package_cost, renewal_item_price
from leasebook.functions.numbering import number_rows
from leasebook.functions.text import contains_text, is_blank, yes_no, yes_no_arg


def test_month_diff_counts_boundaries(spark):
    rows = [(dt.date(2019, 1, 1), dt.date(2019, 12, 31), 11), (dt.date(2019, 1, 31), dt.date(2019, 2, 1), 1),
            (dt.date(2020, 3, 1), dt.date(2020, 1, 31), -2), (dt.date(2018, 12, 31), dt.date(2020, 1, 1), 13)]
    df = spark.createDataFrame(rows, "a date, b date, n int")
    assert df.where(month_diff(F.col("a"), F.col("b")) != F.col("n")).count() == 0


TEXTS = [("", None, False), ("  ", None, False), (None, None, False), ("2020/12", dt.date(2020, 12, 1), False),
         ("2020-12", dt.date(2020, 12, 1), False), ("2020.12", dt.date(2020, 12, 1), True), ("2020/13", None, True),
         ("abcd/ef", None, True), ("2020-1", None, True)]


def test_year_month_columns_and_arguments_agree(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in TEXTS], "t string")
    got = df.select("t", parse_year_month(F.col("t")), year_month_error(F.col("t"))).collect()
    assert [tuple(r) for r in got] == TEXTS
    for text, month, wrong in TEXTS:
        if wrong:
            with pytest.raises(ValueError):
                year_month_arg(text)
        else:
            assert year_month_arg(text) == month


def test_unreadable_dates_are_reported_together():
    with pytest.raises(UserInputError) as error:
        read_date_range([("2020", "first"), ("2020-01", "second"), ("x", "third")])
    assert str(error.value) == "first, third. Please enter dates in the form YYYY-MM or YYYY/MM."


@pytest.mark.parametrize("text,expected", [
    ("NAME", {"name one", "Name Two"}), ("%one", {"name one"}), ("e_o", {"name one"}), ("[ot]", {"name one", "Name Two", "dot.t"}),
    ("[^a-z ]", {"dot.t", "back\\slash"}), ("\\", {"back\\slash"}), (".", {"dot.t"}), ("k\\_l", {"back\\slash"}), ("one ", set()),
    ("[", set()), ("[a-c]k", {"back\\slash"}),
])
def test_search_text(spark, text, expected):
    names = ["name one", "Name Two", "dot.t", "back\\slash", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n for r in df.where(contains_text(F.col("n"), text)).collect()} == expected


def test_blank_and_yes_no(spark):
    assert is_blank(None) and is_blank("  ") and not is_blank(" a")
    cases = [("yes", True), ("Y", True), ("1", True), ("YES ", True), ("no", False), ("", False), (None, False), ("true", False)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(yes_no(F.col("t"))).collect()] == [e for _, e in cases]
    assert [yes_no_arg(t) for t, _ in cases] == [e for _, e in cases]


def test_price_modes(spark):
    df = spark.createDataFrame([(Decimal(100), Decimal("0.1"), Decimal("0.05"))], "p decimal(19,4), d decimal(5,4), f decimal(5,4)")
    prices = [df.select(renewal_item_price(F.col("p"), F.col("d"), F.col("f"), m)).first()[0]
              for m in ("final", "earlier", "earliest")]
    assert prices == [Decimal("94.5"), Decimal("94.5"), Decimal(105)]


def test_number_rows_is_dense_and_ordered(spark):
    keys = [-(10**12), -70000, -1, 0, 1, 65535, 65536, 65537, 10**9, 10**12, 10**15, 2**52]
    df = number_rows(spark.createDataFrame([(k,) for k in keys[::-1]], "k bigint"), "k", "n")
    assert sorted((r.k, r.n) for r in df.collect()) == [(k, i + 1) for i, k in enumerate(keys)]
    wide = number_rows(spark.range(200_000).select((F.col("id") * 3).alias("k")), "k", "n")
    assert wide.where("n <> k / 3 + 1").count() == 0


def test_numbers_of_spread_out_null_and_repeated_keys(spark):
    hashed = spark.range(3000).select(F.xxhash64("id").alias("k"))
    numbered = number_rows(hashed, "k", "n")
    assert [r.n for r in numbered.orderBy("k").collect()] == list(range(1, 3001))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition(_range") == 2  # over ranges, or inside one
    few = number_rows(spark.createDataFrame([(5,), (None,), (5,), (-7,)], "k bigint"), "k", "n")
    assert sorted((str(r.k), r.n) for r in few.collect()) == [("-7", 2), ("5", 3), ("5", 3), ("None", 1)]


def test_lookup_join_deals_out_rows_without_a_key(spark):
    fact = spark.range(1000).select(F.when(F.col("id") < 700, None).otherwise(F.col("id") % 9).cast("bigint").alias("k"), "id")
    dim = spark.createDataFrame([(i, i * 10) for i in range(8)] + [(None, 5)], "k bigint, v bigint")
    for how, n in (("left", 1000), ("inner", 266)):
        rows = lookup_join(fact, dim, ["k"], ["id"], how).collect()
        assert len(rows) == n and all(r.v == (None if r.k in (None, 8) else r.k * 10) for r in rows)


def test_cost_of_an_open_end_and_a_negative_discount(spark):
    df = spark.createDataFrame([(Decimal("10"), 95988, Decimal("-9.5"))], "m decimal(26,8), n int, d decimal(5,4)")
    assert df.select(package_cost(F.col("n"), F.col("m"), F.col("d"))).first()[0] == Decimal("10078740.0000")
