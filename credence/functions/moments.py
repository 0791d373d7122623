"""Means and centred products as aggregates that keep their digits, in one pass.

Raw sums of squares lose all digits where values are large beside their spread (time stamps, money in
cents): a spread of 1 around 10^8 needs 16 digits for the squares alone.  ``covar_pop`` merges centred
products pair by pair instead; the mean is summed in three parts of limited length, whose sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a value is cut: multiples of this, whole numbers, and what is left.
CUT = float(1 << 20)


def mean_of(value: Column) -> Column:
    """The mean of finite values; whole parts add up without rounding to 2^53 times ``CUT``."""
    value = value.cast("double")
    high = F.rint(value / F.lit(CUT))
    rest = value - high * F.lit(CUT)
    n = F.count(value)
    return F.sum(high) / n * F.lit(CUT) + (F.sum(F.rint(rest)) / n + F.sum(rest - F.rint(rest)) / n)


def products_of(values: list[Column]) -> list[Column]:
    """Sums of products of deviations from the means: the upper triangle, row by row."""
    n = F.count(F.lit(1))
    return [F.covar_pop(values[a], values[b]) * n for a in range(len(values)) for b in range(a, len(values))]
