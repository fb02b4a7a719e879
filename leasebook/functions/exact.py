"""Decimal arithmetic whose result types follow the published precision and scale rules of T-SQL.

Types of + - x / for operands (p1, s1) and (p2, s2), before they are reduced to 38 digits:

    + -   scale max(s1, s2), precision max(p1 - s1, p2 - s2) + scale + 1
    x     scale s1 + s2, precision p1 + p2 + 1
    /     scale max(6, s1 + p2 + 1), precision p1 - s1 + s2 + scale

A product or quotient of more than 38 digits gives up digits of its scale, down to 6 at least; a sum keeps the whole part of its
larger operand. Digits that do not fit are rounded half up. An int counts as decimal(10,0).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 38
LEAST_SCALE = 6
INT_DIGITS = 10


def sum_type(p1: int, s1: int, p2: int, s2: int) -> tuple[int, int]:
    whole, scale = max(p1 - s1, p2 - s2), max(s1, s2)
    precision = min(whole + scale + 1, MOST)
    return precision, min(scale, precision - whole)


def _reduced(precision: int, scale: int) -> tuple[int, int]:
    if precision <= MOST:
        return precision, scale
    return MOST, max(MOST - (precision - scale), min(scale, LEAST_SCALE))


def product_type(p1: int, s1: int, p2: int, s2: int) -> tuple[int, int]:
    return _reduced(p1 + p2 + 1, s1 + s2)


def quotient_type(p1: int, s1: int, p2: int, s2: int) -> tuple[int, int]:
    scale = max(LEAST_SCALE, s1 + p2 + 1)
    return _reduced(p1 - s1 + s2 + scale, scale)


@dataclass(frozen=True)
class Exact:
    """A decimal column that knows its precision and scale."""

    column: Column
    precision: int
    scale: int

    @staticmethod
    def of(column: Column, precision: int, scale: int) -> Exact:
        return Exact(column.cast(f"decimal({precision},{scale})"), precision, scale)

    @staticmethod
    def whole(value: Column | int) -> Exact:
        """An int."""
        return Exact.of(F.lit(value) if isinstance(value, int) else value, INT_DIGITS, 0)

    @property
    def _type(self) -> tuple[int, int]:
        return self.precision, self.scale

    def _fitting(self, precision: int, scale: int) -> Column:
        """The column for a sum of that type, with one digit to spare so that Spark's own type for the sum is not wider.

        A value of 38 digits does not fit, and raises an error as the overflow it nearly is.
        """
        return self.column.cast(f"decimal({min(precision, MOST - 1)},{scale})")

    def __add__(self, other: Exact) -> Exact:
        kind = sum_type(*self._type, *other._type)
        return Exact.of(self._fitting(*kind) + other._fitting(*kind), *kind)

    def __sub__(self, other: Exact) -> Exact:
        kind = sum_type(*self._type, *other._type)
        return Exact.of(self._fitting(*kind) - other._fitting(*kind), *kind)

    def __mul__(self, other: Exact) -> Exact:
        return Exact.of(self.column * other.column, *product_type(*self._type, *other._type))

    def __truediv__(self, other: Exact) -> Exact:
        return Exact.of(self.column / other.column, *quotient_type(*self._type, *other._type))

    def total(self) -> Exact:
        """The sum over rows."""
        return Exact.of(F.sum(self.column), MOST, self.scale)
