"""Grouped sums, margins and derived series."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import finite, or_zero
from tallyloom.session import materialise, small_table

#: Labels that one row lists; a group with more has NULL there, and all of them in ``label_chunks``.
LISTED = 10_000


def grouped_sum(df: DataFrame, by, values) -> DataFrame:
    """Sum of measures by key; partial sums happen before the shuffle."""
    aggs = [F.sum(or_zero(v)).alias(v) for v in values]
    return df.groupBy(*by).agg(*aggs)


def observed_sum(df: DataFrame, by, value: str, observation) -> DataFrame:
    """Grouped sum that also records input and row totals in an ``Observation``.

    The input total is collected on the way through, so preservation can be checked
    without a second scan.
    """
    seen = df.observe(observation, F.sum(or_zero(value)).alias("input_total"), F.count(F.lit(1)).alias("input_rows"))
    return grouped_sum(seen, by, [value])


def tally(df: DataFrame, keys, name: str = "num") -> DataFrame:
    """Collapse records to their key with a count: the first and only record-level shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(name))


def replace_keys(df: DataFrame, corrected: DataFrame, keys) -> DataFrame:
    """Drop rows whose key was corrected and append the corrected rows."""
    keys = list(keys)
    return df.join(corrected.select(*keys).distinct(), keys, "left_anti").unionByName(
        corrected, allowMissingColumns=True
    )


def interpolate_period(
    df: DataFrame, by, period: str, value: str, target, weights: dict, drop: float = 1e-12
) -> DataFrame:
    """Rebuild one period as a weighted sum of anchor periods; an absent anchor counts zero."""
    w = F.lit(0.0)
    for anchor, weight in weights.items():
        w = w + F.when(F.col(period) == anchor, F.lit(float(weight))).otherwise(0.0)
    out = (
        df.filter(F.col(period).isin(list(weights)))
        .groupBy(*by)
        .agg(F.sum(w * or_zero(value)).alias(value))
        .withColumn(period, F.lit(target))
    )
    return out.filter(F.abs(value) > drop).select(*by, period, value)


def annual_with_correction(df: DataFrame, by, period: str, value: str, affected: Column, target, weights) -> DataFrame:
    """Annual totals where the affected cells of one year come from anchor years."""
    corrected = interpolate_period(df.filter(affected), by, period, value, target, weights)
    kept = df.filter(~F.coalesce(affected & (F.col(period) == target), F.lit(False)))
    return grouped_sum(kept.select(*by, period, value).unionByName(corrected), [*by, period], [value])


def margins(df: DataFrame, keys, collapse: dict, values, aggs: list[Column] | None = None) -> DataFrame:
    """Base cells together with every margin over the ``collapse`` dimensions.

    ``collapse`` maps a dimension to the code its total carries, e.g.
    ``{"province": 10, "sex": 3}``.  One GROUPING SETS pass produces them all.
    """
    keys, dims = list(keys), list(collapse)
    sets = []
    for drop in product([False, True], repeat=len(dims)):
        gone = {d for d, flag in zip(dims, drop) if flag}
        sets.append([F.col(k) for k in keys if k not in gone])
    aggs = aggs or [F.sum(or_zero(v)).alias(v) for v in values]
    flags = [F.grouping(d).alias(f"_g_{d}") for d in dims]
    out = df.groupingSets(sets, *[F.col(k) for k in keys]).agg(*aggs, *flags)
    measure = [c for c in out.columns if c not in keys and not c.startswith("_g_")]
    cols = [
        F.when(F.col(f"_g_{k}") == 1, F.lit(collapse[k])).otherwise(F.col(k)).alias(k) if k in collapse else F.col(k)
        for k in keys
    ]
    return out.select(*cols, *measure)


def membership(df: DataFrame, code: str, groups: dict, group_name: str) -> DataFrame:
    """Attach every group a code belongs to (groups may overlap), from a bounded mapping."""
    members: dict = {}
    for g, codes in groups.items():
        for c in codes:
            members.setdefault(c, []).append(g)
    spark = df.sparkSession
    ctype, gtype = df.schema[code].dataType, ("string" if isinstance(next(iter(groups)), str) else "int")
    rows = [(c, g) for c, gs in members.items() for g in gs]
    table = small_table(spark, rows, f"{code} {ctype.simpleString()}, {group_name} {gtype}")
    return df.join(table, code, "inner")


def derived_series(
    df: DataFrame, by, cause: str, age: str, value: str, series: dict, age_groups: dict,
    series_name: str = "series", group_name: str = "age_group",
) -> DataFrame:
    """Overlapping series x overlapping age groups in one aggregate."""
    long = membership(df, cause, series, series_name)
    long = membership(long, age, age_groups, group_name)
    return grouped_sum(long, [*by, series_name, group_name], [value])


def weighted_mean(df: DataFrame, by, value: str, weight: str) -> DataFrame:
    """Weighted mean over usable pairs; without weight, the plain mean of usable values."""
    w_ok = finite(weight) & (F.col(weight) > 0)
    v_ok = finite(value)
    num = F.sum(F.when(w_ok & v_ok, F.col(weight) * F.col(value)))
    den = F.sum(F.when(w_ok & v_ok, F.col(weight)))
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(w_ok, F.col(weight))), F.lit(0.0)).alias(weight),
        F.coalesce(F.try_divide(num, den), F.avg(F.when(v_ok, F.col(value)))).alias(value),
    )


def component_table(df: DataFrame, by, first: Column, second: Column, value: str) -> DataFrame:
    """Cross-tabulate two binary classes into four measure columns ``d11 d12 d21 d22``."""
    v = or_zero(value)
    cells = {
        "d11": first & second, "d12": first & ~second, "d21": ~first & second, "d22": ~first & ~second,
    }
    return df.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(c, v)), F.lit(0.0)).alias(n) for n, c in cells.items()]
    )


def max_finite(c: str) -> Column:
    return F.max(F.when(finite(c), F.col(c)))


def sum_or_null(c: str) -> Column:
    """NULL when every entry is NULL, which is what ``sum`` does already."""
    return F.sum(c)


def merge_consistent(df: DataFrame, keys, values, tolerance: float = 1e-8) -> DataFrame:
    """Merge duplicate rows that agree; a spread above the tolerance fails the job."""
    out = []
    for v in values:
        spread = F.max(v) - F.min(v)
        out.append(
            F.when(spread > tolerance, F.raise_error(F.lit(f"duplicates disagree on {v}")).cast("double"))
            .otherwise(F.max(v)).alias(v)
        )
    return df.groupBy(*keys).agg(*out)


def duplicate_spread(df: DataFrame, keys, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.max(value).alias("merged"), (F.max(value) - F.min(value)).alias("spread")
    )


def catalogue(df: DataFrame, columns) -> DataFrame:
    """Distinct combinations with how many rows carry them."""
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))


def coverage(df: DataFrame, by, year: str, cell, label: str) -> DataFrame:
    """Rows, first and last year, distinct cells and the joined labels per group.

    Rows are summed per cell and label first, so a group's rows never meet; the labels of a
    group are joined up to ``LISTED``, and ``label_chunks`` has those of any group.
    """
    by, cell = list(by), list(cell)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cell])
    y, text = F.col(year), F.col(label).cast("string")
    keyed = df.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], F.when(known, F.struct(*cell)).alias("_cell"), text.alias("_l"), y.alias("_y"))
    groups = [f"_g{k}" for k in range(len(by))]
    small = keyed.groupBy(*groups, "_cell", "_l").agg(F.count("*").alias("_n"), F.min("_y").alias("_a"), F.max("_y").alias("_b"))
    cells = small.groupBy(*groups, "_cell").agg(F.sum("_n").alias("_n"), F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    main = cells.groupBy(*groups).agg(
        F.sum("_n").alias("rows"), F.min("_a").alias("first_year"), F.max("_b").alias("last_year"), F.count("_cell").alias("cells")
    )
    labels = in_order(small.groupBy(*groups, "_l").agg(F.count("*").alias("_n")), groups, "_l").groupBy(*groups).agg(joined_labels("_l", "labels"))
    same = reduce(lambda a, b: a & b, [main[g].eqNullSafe(labels[g]) for g in groups])
    return main.join(labels, same).select(*[main[g].alias(c) for g, c in zip(groups, by)], "rows", "first_year", "last_year", "cells", "labels")


def joined_labels(label: str, name: str) -> Column:
    """Sorted labels joined by commas, from rows that are distinct already; NULL for more than ``LISTED``.

    A row keeps ``LISTED`` labels and one more at most: each carries its number in order, counted by a
    window beforehand, or the sum of lengths would be gathered first.
    """
    held = F.collect_list(F.when(F.col("_nth") <= LISTED, F.col(label)))
    return F.when(F.count(label) <= LISTED, F.array_join(F.sort_array(held), ",")).alias(name)


def in_order(df: DataFrame, by, label: str) -> DataFrame:
    """``_nth`` of each label in its group, for ``joined_labels``; the window streams and spills."""
    return df.withColumn("_nth", F.when(F.col(label).isNotNull(), F.row_number().over(W.partitionBy(*by).orderBy(F.col(label).asc_nulls_last()))))


def label_chunks(df: DataFrame, by, label: str, size: int = 1000) -> DataFrame:
    """All distinct labels of every group in order, in rows of at most ``size``: (by, chunk, first, labels).

    Rows are sorted over all tasks by group and label, so a large group is many tasks' work; chunks of
    a group order by ``chunk``.
    """
    by = list(by)
    rows = df.filter(F.col(label).isNotNull()).select(*by, F.col(label).cast("string").alias("_l")).distinct()
    # written, so that numbers given by place hold
    placed = materialise(rows.repartitionByRange(*by, "_l").sortWithinPartitions(*by, "_l").withColumn("_at", F.monotonically_increasing_id()), "labels")
    chunk = F.floor(F.col("_at") / size)
    g = placed.groupBy(*by, chunk.alias("chunk")).agg(F.sort_array(F.collect_list("_l")).alias("labels"))
    return g.select(*by, "chunk", F.get("labels", F.lit(0)).alias("first"), F.array_join("labels", ",").alias("labels"))


def kish(weight: str) -> Column:
    """Effective sample size of the positive weights."""
    w = F.when(F.col(weight) > 0, F.col(weight))
    return F.coalesce(F.try_divide(F.pow(F.sum(w), 2), F.sum(w * w)), F.lit(0.0))


def top_with_forced(df: DataFrame, code: str, value: str, n: int, forced) -> DataFrame:
    """The n largest codes plus codes that must always be listed."""
    totals = df.groupBy(code).agg(F.sum(or_zero(value)).alias(value))
    top = totals.orderBy(F.desc(value), F.asc(code)).limit(n)
    return top.unionByName(totals.filter(F.col(code).isin(list(forced)))).distinct()
