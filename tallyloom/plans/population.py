"""Population denominators and small cell-level helpers of the preparation stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.schema import rename_first


def standardise_population(df: DataFrame, keys, value: str, aliases=()) -> DataFrame:
    """Sum duplicate rows per key without missing keys; negatives are clipped after the sum."""
    df = rename_first(df, value, aliases)
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    total = F.sum(F.col(value).try_cast("double"))
    return df.filter(complete).groupBy(*keys).agg(F.greatest(F.coalesce(total, F.lit(0.0)), F.lit(0.0)).alias(value))


def prepare_population(df: DataFrame, keys, value: str, year: str, years: tuple[int, int], age: str, ages: list) -> DataFrame:
    """Study-period population with its age codes checked."""
    x = standardise_population(df.filter(F.col(year).between(*years)), keys, value)
    bad = F.raise_error(F.concat(F.lit("age code outside the domain: "), F.col(age).cast("string"))).cast("double")
    return x.withColumn(value, F.when(F.col(age).isin(ages), F.col(value)).otherwise(bad))


def missing_years(df: DataFrame, year: str, years: tuple[int, int]) -> DataFrame:
    """Study years without any row."""
    want = df.sparkSession.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias(year))
    return want.join(df.select(F.col(year).cast("int").alias(year)).distinct(), year, "left_anti")


def split_codes(df: DataFrame, code: str, members) -> tuple[DataFrame, DataFrame]:
    inside = F.coalesce(F.col(code).isin(list(members)), F.lit(False))
    return df.filter(inside), df.filter(~inside)


def envelope(code: str, sets: dict[str, list], other: str) -> Column:
    out = F.lit(other)
    for name, codes in sets.items():
        out = F.when(F.col(code).isin(list(codes)), F.lit(name)).otherwise(out)
    return out
