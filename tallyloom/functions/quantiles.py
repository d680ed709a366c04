"""Median-unbiased (type 8) quantiles of a sorted array.

Spark's ``percentile`` interpolates differently (type 7), so the two order
statistics around ``n*p + (p+1)/3`` are read from the sorted array and blended.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.columns import col


def type8(sorted_values, p: float) -> Column:
    a = col(sorted_values)
    n = F.size(a)
    h = n * F.lit(float(p)) + F.lit((p + 1.0) / 3.0)
    j = F.floor(h).cast("int")
    lo = F.least(F.greatest(j, F.lit(1)), n)
    hi = F.least(F.greatest(j + 1, F.lit(1)), n)
    g = h - j
    value = F.element_at(a, lo) * (1.0 - g) + F.element_at(a, hi) * g
    return F.when(n > 0, F.when(F.element_at(a, lo) == F.element_at(a, hi), F.element_at(a, lo)).otherwise(value))
