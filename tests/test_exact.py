"""Precision and scale rules, and values at their edges."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from leasebook.functions.exact import Exact, product_type, quotient_type, sum_type


@pytest.mark.parametrize("rule,a,b,expected", [
    (product_type, (19, 4), (5, 4), (25, 8)), (product_type, (26, 8), (17, 4), (38, 6)), (product_type, (10, 0), (38, 6), (38, 6)),
    (product_type, (38, 2), (10, 0), (38, 2)), (product_type, (20, 10), (20, 10), (38, 17)), (product_type, (38, 10), (38, 10), (38, 6)),
    (sum_type, (19, 4), (25, 8), (26, 8)), (sum_type, (10, 0), (16, 4), (17, 4)), (sum_type, (38, 10), (38, 10), (38, 10)),
    (sum_type, (38, 0), (10, 6), (38, 0)), (sum_type, (38, 20), (38, 4), (38, 4)), (sum_type, (5, 2), (5, 2), (6, 2)),
    (quotient_type, (10, 0), (10, 0), (21, 11)), (quotient_type, (19, 4), (5, 4), (29, 10)), (quotient_type, (38, 10), (38, 10), (38, 6)),
    (quotient_type, (1, 0), (2, 1), (8, 6)),
])
def test_result_types(rule, a, b, expected):
    assert rule(*a, *b) == expected


def test_columns_have_the_types_of_the_rules(spark):
    kinds = [(19, 4), (5, 4), (10, 0), (38, 6), (38, 10), (38, 20), (38, 0), (20, 10)]
    df = spark.range(1)
    names, columns = [], []
    for a in kinds:
        for b in kinds:
            x, y = Exact.of(F.lit(D(3)), *a), Exact.of(F.lit(D(2)), *b)
            for made in (x + y, x - y, x * y, x / y):
                names.append(f"decimal({made.precision},{made.scale})")
                columns.append(made.column.alias(f"c{len(columns)}"))
    shown = df.select(*columns)
    assert [f.dataType.simpleString() for f in shown.schema] == names
    row = shown.first()
    assert [tuple(row[i:i + 3]) for i in range(0, len(row), 4)] == [(5, 1, 6)] * len(kinds) ** 2


def test_values(spark):
    rows = [(D("123456789012345.1234"), D("0.1234")), (D("0.0001"), D("0.0049")), (D("-7.5"), D("0.5")), (None, D("1"))]
    df = spark.createDataFrame(rows, "a decimal(19,4), b decimal(5,4)")
    a, b = Exact.of(F.col("a"), 19, 4), Exact.of(F.col("b"), 5, 4)
    got = df.select((a + a * b).column, ((a + a * b) * (Exact.whole(1) - Exact.whole(1) * b)).column, (a / b).column).collect()
    for (x, y), row in zip(rows, got):
        if x is None:
            assert tuple(row) == (None, None, None)
            continue
        whole = x + x * y
        assert row[0] == whole and row[1] == (whole * (1 - y)).quantize(D("0.000001"), "ROUND_HALF_UP")
        assert row[2] == (x / y).quantize(D("0.0000000001"), "ROUND_HALF_UP")


def test_sums_of_wide_operands_lose_no_digit(spark):
    df = spark.sql("SELECT CAST('123456789012345678901234567.0123456789' AS DECIMAL(38,10)) a")
    a = Exact.of(F.col("a"), 38, 10)
    assert df.select((a + a).column).first()[0] == D("246913578024691357802469134.0246913578")
    assert df.select((a - a).column).first()[0] == 0
    assert df.select(a.total().column).schema[0].dataType.simpleString() == "decimal(38,10)"
