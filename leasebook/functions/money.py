"""Price and cost expressions on exact decimals.

Every step has a stated precision, so that the result does not depend on how an
engine widens or narrows the scale of decimal products.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "decimal(23,8)"
TOTAL = "decimal(26,8)"
TERM_TOTAL = "decimal(31,8)"
COST = "decimal(28,4)"
MONTHS = "decimal(6,0)"  # also for a term that ends in 9999
RATE_LEFT = "decimal(6,4)"


def _left(rate: Column) -> Column:
    """What remains after a discount."""
    return (F.lit(1) - rate).cast(RATE_LEFT)


def renewal_item_price(price: Column, discount: Column, factor: Column, mode: str = "final") -> Column:
    """Price of one unit in the next term.

    final    (p + p*f) * (1 - d)
    earlier  (p - p*d) + (p - p*d)*f
    earliest p + p*f, discount ignored
    """
    if mode == "final":
        return ((price + price * factor) * _left(discount)).cast(UNIT)
    if mode == "earlier":
        net = price - price * discount
        return (net + net * factor).cast(UNIT)
    if mode == "earliest":
        return (price + price * factor).cast(UNIT)
    raise ValueError(f"unknown price mode {mode!r}")


def line_amount(quantity: Column, price: Column, discount: Column, factor: Column) -> Column:
    """Monthly amount of one line."""
    unit = renewal_item_price(price, discount, factor)
    return (quantity.cast("decimal(10,0)") * unit).cast(TOTAL)


def package_cost(months: Column, monthly: Column, discount: Column | None = None) -> Column:
    """Cost of a whole term: months x monthly amount, less the package discount."""
    cost = (monthly.cast(TOTAL) * months.cast(MONTHS)).cast(TERM_TOTAL)
    if discount is not None:
        cost = cost * _left(discount)
    return cost.cast(COST)
