"""Assertions as data.

A check is a one-row DataFrame (``check, failures, worst, ok``), so checks can be
unioned, stored next to the output they describe, or enforced under a policy.
"""

from __future__ import annotations

import enum
import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import finite, or_zero

log = logging.getLogger(__name__)


class Policy(enum.Enum):
    RAISE = "raise"
    WARN = "warn"
    REPORT = "report"


def required_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"required column(s) absent: {missing}")


def _result(name: str, failures: Column, worst: Column | None = None) -> list[Column]:
    failures = F.coalesce(failures.cast("bigint"), F.lit(0).cast("bigint"))
    worst = F.lit(0.0) if worst is None else F.coalesce(worst.cast("double"), F.lit(0.0))
    return [
        F.lit(name).alias("check"),
        failures.alias("failures"),
        worst.alias("worst"),
        (failures == 0).alias("ok"),
    ]


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once with their multiplicity."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def unique_key(df: DataFrame, keys, name: str = "unique_key") -> DataFrame:
    d = duplicate_keys(df, keys)
    return d.agg(F.count("*").alias("f"), F.max("rows").alias("w")).select(
        *_result(name, F.col("f"), F.col("w"))
    )


def examples(df: DataFrame, keys, n: int = 10) -> DataFrame:
    """Head preview of offending rows (a top-n, not a full sort)."""
    return df.orderBy(*keys).limit(n)


def non_negative(df: DataFrame, columns, tolerance: float = 0.0, name: str = "non_negative") -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < -tolerance, F.lit(False)) for c in columns])
    low = F.min(F.least(*[F.col(c).cast("double") for c in columns], F.lit(0.0)))
    return df.agg(F.count_if(bad).alias("f"), low.alias("w")).select(*_result(name, F.col("f"), F.col("w")))


def no_missing(df: DataFrame, columns, name: str = "no_missing") -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return df.agg(F.count_if(bad).alias("f")).select(*_result(name, F.col("f")))


def _relative(a, b) -> Column:
    return F.abs(a - b) / F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def total_preserved(
    before: DataFrame, after: DataFrame, value: str, value_after: str | None = None,
    tolerance: float = 1e-8, name: str = "total_preserved",
) -> DataFrame:
    """Grand totals of two tables agree, relative with a floor of one."""
    signed = before.select(or_zero(value).alias("b"), F.lit(0.0).alias("a")).unionAll(
        after.select(F.lit(0.0).alias("b"), or_zero(value_after or value).alias("a"))
    )
    e = _relative(F.col("b"), F.col("a"))
    return (
        signed.agg(F.coalesce(F.sum("b"), F.lit(0.0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"))
        .select(*_result(name, (e > tolerance).cast("int"), e))
    )


def group_errors(
    before: DataFrame, after: DataFrame, by, value: str, value_after: str | None = None
) -> DataFrame:
    """Per-group totals of two tables and their scaled error.

    One union and one aggregate, with partial sums before the shuffle, instead of
    two aggregates and a full outer join.
    """
    both = before.select(*by, or_zero(value).alias("before"), F.lit(0.0).alias("after")).unionByName(
        after.select(*by, F.lit(0.0).alias("before"), or_zero(value_after or value).alias("after"))
    )
    return (
        both.groupBy(*by)
        .agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
        .withColumn("error", _relative(F.col("before"), F.col("after")))
    )


def group_totals_preserved(
    before, after, by, value, value_after=None, tolerance: float = 1e-8, name: str = "group_totals_preserved"
) -> DataFrame:
    e = group_errors(before, after, by, value, value_after)
    return e.agg(F.count_if(F.col("error") > tolerance).alias("f"), F.max("error").alias("w")).select(
        *_result(name, F.col("f"), F.col("w"))
    )


def table_error(
    left: DataFrame, right: DataFrame, keys, value: str, absolute: float = 1e-6, relative: float = 2e-7
) -> DataFrame:
    """Largest absolute and relative difference over the union of keys."""
    both = left.select(*keys, or_zero(value).alias("l"), F.lit(0.0).alias("r")).unionByName(
        right.select(*keys, F.lit(0.0).alias("l"), or_zero(value).alias("r"))
    )
    d = both.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    diff = F.abs(F.col("l") - F.col("r"))
    rel = diff / F.greatest(F.lit(1.0), F.abs("l"), F.abs("r"))
    return d.agg(
        F.count("*").alias("cells"),
        F.max(diff).alias("max_absolute"),
        F.max(rel).alias("max_relative"),
        F.count_if((diff > absolute) & (rel > relative)).alias("over_tolerance"),
    )


def checkpoint_diff(
    left: DataFrame, right: DataFrame, keys, values, absolute: float = 1e-6, relative: float = 1e-7
) -> DataFrame:
    """Row-by-row comparison of two versions of a table on a unique key."""
    joined = left.select(*keys, *[F.col(v).alias(f"{v}_left") for v in values], F.lit(True).alias("_l")).join(
        right.select(*keys, *[F.col(v).alias(f"{v}_right") for v in values], F.lit(True).alias("_r")),
        list(keys), "full_outer",
    )
    status = (
        F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    )
    out = joined.withColumn("key_status", status)
    all_match = F.col("key_status") == "both"
    for v in values:
        a, b = F.col(f"{v}_left").cast("double"), F.col(f"{v}_right").cast("double")
        diff = F.abs(a - b)
        rel = F.try_divide(diff, F.greatest(F.abs(a), F.abs(b)))
        rel = F.when(diff == 0, 0.0).otherwise(rel)
        match = (F.col("key_status") == "both") & (
            (a.isNull() & b.isNull()) | F.coalesce((diff <= absolute) | (rel <= relative), F.lit(False))
        )
        out = out.withColumns({f"{v}_abs": diff, f"{v}_rel": rel, f"{v}_match": match})
        all_match = all_match & F.col(f"{v}_match")
    return out.withColumn("all_match", all_match).drop("_l", "_r")


def diff_summary(diff: DataFrame, values) -> DataFrame:
    aggs = [
        F.count("*").alias("rows"),
        F.count_if(F.col("key_status") == "both").alias("both"),
        F.count_if(F.col("key_status") == "left_only").alias("left_only"),
        F.count_if(F.col("key_status") == "right_only").alias("right_only"),
        F.count_if("all_match").alias("matching"),
    ]
    for v in values:
        aggs += [F.count_if(F.col(f"{v}_match")).alias(f"{v}_matching"), F.max(f"{v}_abs").alias(f"{v}_max_abs")]
    return diff.agg(*aggs)


def exact_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with a signed count; empty means identical.

    A signed union and one aggregate: a single shuffle with partial sums, where two
    ``exceptAll`` calls would need four.
    """
    cols = left.columns
    signed = left.select(*cols, F.lit(1).cast("bigint").alias("_s")).unionByName(
        right.select(*cols, F.lit(-1).cast("bigint").alias("_s"))
    )
    return signed.groupBy(*cols).agg(F.sum("_s").alias("surplus")).filter("surplus <> 0")


def exact_equality(left: DataFrame, right: DataFrame, name: str = "exact_equality") -> DataFrame:
    d = exact_differences(left, right)
    return d.agg(F.count("*").alias("f"), F.max(F.abs("surplus")).alias("w")).select(
        *_result(name, F.col("f"), F.col("w"))
    )


def composition_closure(
    df: DataFrame, strata, category: str, value: str, levels, tolerance: float = 1e-8,
    name: str = "composition_closure",
) -> DataFrame:
    """Each stratum has every level exactly once, valid entries, and sums to one."""
    known = F.col(category).isin(list(levels))
    g = df.groupBy(*strata).agg(
        F.sum(or_zero(value)).alias("s"),
        F.count("*").alias("n"),
        F.count_distinct(F.when(known, F.col(category))).alias("d"),
        F.count_if(~finite(value) | (F.col(value) < 0)).alias("invalid"),
    )
    gap = F.abs(F.col("s") - 1.0)
    k = len(list(levels))
    bad = (gap > tolerance) | (F.col("n") != k) | (F.col("d") != k) | (F.col("invalid") > 0)
    return g.agg(F.count_if(bad).alias("f"), F.max(gap).alias("w")).select(*_result(name, F.col("f"), F.col("w")))


def unmapped(df: DataFrame, condition: Column, example, limit: int = 10) -> DataFrame:
    """How many records fell through a mapping, with a few of the codes."""
    hits = df.filter(condition).groupBy(example).agg(F.count("*").alias("n"))
    ranked = hits.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("records"),
        F.count("*").alias("codes"),
    )
    shown = hits.orderBy(F.desc("n"), F.asc(example)).limit(limit)
    preview = shown.agg(F.array_join(F.sort_array(F.collect_list(F.col(example))), ",").alias("examples"))
    return ranked.withColumn("examples", preview.scalar())


def same_domain(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Keys present on one side only (set equality when empty)."""
    keys = list(keys)
    l, r = left.select(*keys).distinct(), right.select(*keys).distinct()
    return (
        l.join(r, keys, "left_anti").withColumn("side", F.lit("left_only"))
        .unionByName(r.join(l, keys, "left_anti").withColumn("side", F.lit("right_only")))
    )


def report(*checks: DataFrame) -> DataFrame:
    """Stack one-row checks into a report."""
    return reduce(lambda a, b: a.unionByName(b), checks)


def enforce(checks: DataFrame, policy: Policy = Policy.RAISE) -> DataFrame:
    """Apply a policy to a report (one row per check, so collecting it is bounded)."""
    if policy is Policy.REPORT:
        return checks
    failed = [r["check"] for r in checks.filter("not ok").collect()]
    if failed and policy is Policy.RAISE:
        raise AssertionError(f"failed checks: {failed}")
    for name in failed:
        log.warning("check failed: %s", name)
    return checks
