"""Age codes: completed years, age with unit, table ages, and code lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.columns import col

# Fixed values of the age coding.
BAND_MIN, BAND_MAX = 1, 20
UNKNOWN_AGE = 999
DATABASE_AGES = list(range(0, 20))
PIPELINE_AGES = list(range(1, 21))


def band_of_years(years) -> Column:
    """Completed years to a band: 0 is band 2, 1-4 band 3, then five-year bands to 20."""
    y = col(years).cast("double")
    return (
        F.when((y >= 0) & (y < 1), 2)
        .when((y >= 1) & (y < 5), 3)
        .when((y >= 5) & (y < 85), F.floor(y / 5).cast("int") + 3)
        .when((y >= 85) & (y <= 150), BAND_MAX)
        .otherwise(F.lit(UNKNOWN_AGE))
        .cast("int")
    )


def band_of_unit_age(age, unit) -> Column:
    """Age with a unit code: unit 0 neonatal, unit 2 years, other units infant."""
    a, u = col(age).cast("double"), col(unit)
    return (
        F.when(u.isNull(), 21)
        .when(u == 0, 1)
        .when(u == 2, band_of_years(a))
        .otherwise(2)
        .cast("int")
    )


def band_of_table_age(age) -> Column:
    """Lower bound of a tabulated age group to a band."""
    a = col(age).cast("double")
    return (
        F.when(a == 0, 2).when(a == 1, 3).when(a >= 5, F.floor(a / 5).cast("int") + 3).cast("int")
    )


def band_of_register_age(age) -> Column:
    """Five-year register age to a band, with infants, children and the oldest clamped."""
    a = col(age).cast("double")
    raw = F.greatest(F.lit(3), F.least(F.lit(20), F.floor(3 + a / 5).cast("int")))
    return F.when(a == 0, 2).otherwise(raw).cast("int")


def band_midpoint(band) -> Column:
    """Representative age of a pipeline band."""
    b = col(band)
    return F.when(b <= 2, 0.5).when(b == 3, 3.0).otherwise((b - 3) * 5 + 2.5).cast("double")


# Aggregate age codes as (numerator ages, denominator ages).
AGGREGATE_AGES = {
    20: (list(range(0, 3)), [1, 2]),
    21: ([3, 4], [3, 4]),
    22: (list(range(5, 11)), list(range(5, 11))),
    23: (list(range(11, 14)), list(range(11, 14))),
    24: (list(range(14, 20)), list(range(14, 20))),
    25: (list(range(0, 20)), list(range(1, 20))),
    26: (list(range(5, 20)), list(range(5, 20))),
}


def age_spec(codes: list[int], population_free: int = 0) -> tuple[list[int], list[int]]:
    """Numerator and denominator base ages for a list of database age codes.

    The age without a population denominator never enters the denominator; a rate
    for that age alone cannot be formed and is refused.
    """
    num = sorted({a for c in codes for a in (AGGREGATE_AGES[c][0] if c in AGGREGATE_AGES else [c])})
    den = [a for a in num if a != population_free]
    if not den:
        raise ValueError("a rate for the age without a population denominator is undefined")
    return num, den
