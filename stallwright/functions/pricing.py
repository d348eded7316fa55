"""Prices: effective cost, total cost, the marketplace price, promotion prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,10)"


def effective_cost(*prices: Column) -> Column:
    """The first price that is neither null nor zero."""
    return F.coalesce(*[F.nullif(p, F.lit(0).cast(MONEY)) for p in prices])


def total_cost(cost: Column, fee: Column) -> Column:
    return cost + F.coalesce(fee, F.lit(0).cast(MONEY))


def prices(unit: Column, fee: Column, cost: Column, returns: Column) -> tuple[Column, Column]:
    """(price without shipping, price with it); null without a fee or a positive cost.

    Total cost over a 24 % margin, times a coefficient of the unit price and one of
    the rate of returns, rounded to fifties."""
    unit, fee, cost = (x.cast(MONEY) for x in (unit, fee, cost))
    coefficient = F.when(unit > 12000, F.lit("0.98")).when(unit > 8000, F.lit("1.00")).when(unit < 3000, F.lit("1.05")).otherwise(F.lit("1.02")).cast("decimal(4,2)")
    risk = F.when(returns == "High", F.lit("1.10")).when(returns == "Moderate", F.lit("1.06")).otherwise(F.lit("1.00")).cast("decimal(4,2)")
    base = ((cost + fee).cast("decimal(20,4)") / F.lit("0.76").cast("decimal(4,2)")).cast("decimal(24,10)")
    gross = (base * coefficient).cast("decimal(26,10)") * risk - fee
    fifty = lambda c: F.round(c.cast("decimal(28,10)") / F.lit(50).cast("decimal(4,0)"), 0) * 50
    without = F.greatest(fifty(gross), F.lit(0).cast("decimal(28,0)"))
    with_shipping = F.greatest(fifty(fifty(gross) + fee), F.lit(0).cast("decimal(28,0)"))
    known = (cost > 0) & fee.isNotNull()
    return F.when(known, without.cast("double")), F.when(known, with_shipping.cast("double"))


def promotion_price(price: Column) -> Column:
    """5 % off, rounded half up to cents."""
    return F.floor(price * 0.95 * 100 + 0.5) / 100
