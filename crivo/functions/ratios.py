"""Ratios of counts, rounded half-up on decimals.

Counts stay exact integers up to the division, so a report gives the same
digits whatever the partitioning of the input.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, places: int = 4) -> Column:
    """``num / den`` as a double with ``places`` decimals; null when ``den`` is 0."""
    q = F.try_divide(num.cast("decimal(18,0)"), den.cast("decimal(18,0)"))
    return F.round(q, places).cast("double")


def pct(num: Column, den: Column, places: int = 2) -> Column:
    """Percentage of two counts."""
    q = F.try_divide(num.cast("decimal(18,0)") * F.lit(Decimal(100)), den.cast("decimal(18,0)"))
    return F.round(q, places).cast("double")


def count_if(p: Column) -> Column:
    return F.count_if(p)
