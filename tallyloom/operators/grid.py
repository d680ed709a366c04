"""Grids of cells and the long/wide reshapes around them.

Grids are built by exploding code lists and numbers of levels, never by a cross join; a dimension may have any number of levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import materialise

#: Rows of a table that travel as one array value; a larger table is numbered and joined.
ARRAY_ROWS = 10_000


def literal_levels(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def packed_rows(small: DataFrame) -> Column:
    """All rows of a table as one array value; for tables whose number of rows has been checked."""
    row = F.struct(*[F.col(c) for c in small.columns])
    return small.agg(F.collect_list(row).alias("r")).scalar()


def numbered(df: DataFrame, name: str = "_i") -> DataFrame:
    """Rows with the numbers 0, 1, ... in some order: numbered inside hash buckets, which begin where the last one ends."""
    spark = df.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    h = F.xxhash64(*df.columns)
    x = df.withColumn("_b", F.pmod(h, F.lit(buckets)).cast("int"))
    inside = x.withColumn("_k", F.row_number().over(W.partitionBy("_b").orderBy(h, *df.columns)) - 1)
    # one row for each bucket, of which there are as many as shuffle partitions
    sizes = x.groupBy("_b").agg(F.count("*").alias("_n"))
    starts = sizes.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_start"))
    return inside.join(starts, "_b").withColumn(name, F.col("_start") + F.col("_k")).drop("_b", "_k", "_start")


def attach_all(left: DataFrame, right: DataFrame, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """Every left row with every right row; names must not clash.

    The tables are written and counted, the right one first. The one with few rows travels as one array value, which
    every row of the other explodes. If both have more, the right rows get numbers, every left row is dealt the numbers in
    runs of ``array_rows``, and an equi join turns numbers into rows. It is a merge join: Spark takes an exploded table to be
    as small as it was before, and would send all dealt rows through the driver as a broadcast.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"column names on both sides: {sorted(clash)}")
    right = materialise(right, "attached")
    n = right.count()
    if n <= array_rows:
        return _exploded(left, right).select(*left.columns, *right.columns)
    left = materialise(left, "attached")
    if left.count() <= array_rows:
        return _exploded(right, left).select(*left.columns, *right.columns)
    rows = materialise(numbered(right), "numbered")
    first = F.col("_run") * array_rows
    dealt = left.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((n - 1) // array_rows))))
    dealt = dealt.withColumn("_i", F.explode(F.sequence(first, F.least(first + array_rows, F.lit(n)) - 1))).drop("_run")
    return dealt.hint("merge").join(rows, "_i").select(*left.columns, *right.columns)


def _exploded(many: DataFrame, few: DataFrame) -> DataFrame:
    """Every row of ``many`` with every row of ``few``, which travels as one array value."""
    out = many.withColumn("_r", F.explode(packed_rows(few)))
    return out.select(*many.columns, *[F.col(f"_r.{c}").alias(c) for c in few.columns])


def level_grid(spark: SparkSession, levels: dict[str, list]) -> DataFrame:
    """Grid of supplied code lists, generated in parallel from a row counter."""
    total = reduce(lambda a, b: a * b, [len(v) for v in levels.values()], 1)
    out, stride = [], 1
    for name, values in levels.items():
        index = (F.floor(F.col("id") / stride) % len(values)).cast("int")
        out.append(F.element_at(literal_levels(values), index + 1).alias(name))
        stride *= len(values)
    return spark.range(total).select(*out)


def observed_grid(df: DataFrame, dimensions: list[str], levels: dict[str, list] | None = None) -> DataFrame:
    """Grid of the levels seen in ``df`` (or supplied), spread over the first dimension."""
    levels = levels or {}
    if all(d in levels for d in dimensions):
        return level_grid(df.sparkSession, {d: levels[d] for d in dimensions})
    observed = [d for d in dimensions if d not in levels]
    grid = df.select(observed[0]).filter(F.col(observed[0]).isNotNull()).distinct()
    for d in observed[1:]:
        seen = df.select(d).filter(F.col(d).isNotNull()).distinct()
        grid = attach_all(grid, seen)
    for d in dimensions:
        if d in levels:
            grid = grid.withColumn(d, F.explode(literal_levels(levels[d])))
    return grid.select(*dimensions)


def complete_cells(
    df: DataFrame, dimensions, values, levels: dict[str, list] | None = None, fill: float = 0.0
) -> DataFrame:
    """Every combination of levels with the summed measures, ``fill`` where nothing was seen.

    A missing level is not a level of the grid, but cells that have one keep their own row, so no
    mass is lost.
    """
    dimensions, values = list(dimensions), list(values)
    sums = df.groupBy(*dimensions).agg(*[F.sum(v).cast("double").alias(v) for v in values])
    grid = observed_grid(df, dimensions, levels)
    unplaced = reduce(lambda a, b: a | b, [F.col(d).isNull() for d in dimensions])
    full = grid.join(sums, dimensions, "left").unionByName(sums.filter(unplaced))
    return full.fillna(fill, subset=values)


def complete_codes(df: DataFrame, by, code: str, codes, value: str, fill: float = 0.0) -> DataFrame:
    """Each observed group with every code of a list.

    The group's sums become a map with at most one entry per listed code, which the
    exploded list looks up: no join, so a group with a missing key is a group like any other.
    """
    by, codes = list(by), list(codes)
    sums = df.groupBy(*by, code).agg(F.sum(value).cast("double").alias(value))
    listed = F.when(F.col(code).isin(codes) & F.col(value).isNotNull(), F.struct(F.col(code), F.col(value)))
    packed = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(listed)).alias("_m"))
    levels = literal_levels(codes).cast(f"array<{dict(df.dtypes)[code]}>")
    return packed.withColumn(code, F.explode(levels)).select(*by, code, F.coalesce(F.try_element_at("_m", F.col(code)), F.lit(fill)).alias(value))


def spread_join(many: DataFrame, few: DataFrame, by, how: str = "inner") -> DataFrame:
    """Join a table with one row per group to a table with many, without one task per group.

    The rows of a group are dealt over as many salts as there are shuffle partitions, and the
    small side is repeated for each; a dominant group is therefore read by many tasks.
    """
    salts = max(1, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rest = [c for c in many.columns if c not in by]
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    repeated = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*by, "_salt"], how).drop("_salt")


def pivot_codes(df: DataFrame, by, code: str, codes, value: str, prefix: str = "c", fill: float = 0.0) -> DataFrame:
    """Long to wide with an explicit code list; absent combinations become ``fill``."""
    codes = list(codes)
    wide = df.groupBy(*by).pivot(code, codes).agg(F.sum(F.col(value).cast("double")))
    out = [F.coalesce(F.col(f"`{c}`"), F.lit(fill)).alias(f"{prefix}{c}") for c in codes]
    return wide.select(*by, *out)


def outside_domain(df: DataFrame, code: str, codes) -> DataFrame:
    """Rows whose code is not in the list (the domain check of a pivot)."""
    return df.filter(F.col(code).isNull() | ~F.col(code).isin(list(codes)))


def unpivot_codes(
    df: DataFrame, ids, columns, code: str, value: str, prefix: str = "c", code_type: str = "int",
    drop_zero: bool = True, tolerance: float = 1e-12,
) -> DataFrame:
    """Wide to long; near-zero cells are dropped unless asked to stay."""
    long = df.unpivot(list(ids), list(columns), "_name", value)
    out = long.select(
        *ids, F.expr(f"substring(_name, {len(prefix) + 1})").cast(code_type).alias(code), F.col(value)
    )
    return out.filter(F.abs(value) > tolerance) if drop_zero else out


def ensure_columns(df: DataFrame, columns, fill: float = 0.0) -> DataFrame:
    """A fixed set of measure columns: absent ones added, NULLs filled."""
    have = set(df.columns)
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.lit(fill)) if c in have else F.lit(float(fill))
            for c in columns
        }
    )
