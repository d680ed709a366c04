"""Wide and polymorphic inputs to long tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.schema import normalise_token

YEAR_COLUMN = r"^[A-Za-z]?\d{4}$"


def columns_to_long(df: DataFrame, ids, pattern: str, key: str, value: str) -> DataFrame:
    """Columns whose name matches a pattern become rows; the digits of the name are the key."""
    picked = [c for c in df.columns if re.match(pattern, c)]
    if not picked:
        raise ValueError(f"no column matches {pattern}")
    long = df.select(*ids, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in picked]).unpivot(list(ids), picked, "_name", value)
    return long.select(*ids, F.regexp_extract("_name", r"(\d+)", 1).cast("int").alias(key), value)


def years_to_long(df: DataFrame, ids, value: str, year: str = "DeathYear") -> DataFrame:
    return columns_to_long(df, ids, YEAR_COLUMN, year, value)


def blocks_to_long(blocks: dict[tuple, DataFrame], tags: list[str], age: str, value: str) -> DataFrame:
    """Annual blocks (one per group, sex, ...) with an age column and year columns, stacked long."""
    pieces = []
    for key, df in blocks.items():
        long = years_to_long(df, [age], value)
        pieces.append(long.withColumns({t: F.lit(k) for t, k in zip(tags, key)}))
    return reduce(lambda a, b: a.unionByName(b), pieces)


def union_tagged(parts: dict, tag: str, drop=()) -> DataFrame:
    """Stack tables with a tag column; columns missing in some become NULL."""
    unwanted = {normalise_token(d) for d in drop}
    tagged = [
        df.select(*[c for c in df.columns if normalise_token(c) not in unwanted]).withColumn(tag, F.lit(key)) for key, df in parts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def long_or_wide(df: DataFrame, ids, pattern: str, key: str, value: str) -> DataFrame:
    """Accept a long table (key and value present) or one with a column per key."""
    if key in df.columns and value in df.columns:
        return df.select(*ids, F.col(key).cast("int").alias(key), F.col(value).try_cast("double").alias(value))
    return columns_to_long(df, ids, pattern, key, value)


def two_key_columns(df: DataFrame, ids, pattern: str, first: str, second: str, value: str) -> DataFrame:
    """Column names that carry two keys, such as ``A1<age>`` and ``A2<age>``."""
    picked = [c for c in df.columns if re.match(pattern, c)]
    long = df.select(*ids, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in picked]).unpivot(list(ids), picked, "_name", value)
    part = lambda g: F.regexp_extract("_name", pattern, g).cast("int")
    return long.select(*ids, part(1).alias(first), part(2).alias(second), value)
