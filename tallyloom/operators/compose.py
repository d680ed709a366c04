"""Compositions: fractions that close to one, on the log-ratio scale and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions.columns import finite, log_ratio, or_zero, safe_ratio
from tallyloom.operators.donors import borrow, donor_table
from tallyloom.session import materialise, small_table

# ---------------------------------------------------------------- weight tables
# Linear maps over years or ages are small weight tables {(target, source): w}.


def interpolation_weights(points: list[int], anchors: list[int]) -> dict[tuple[int, int], float]:
    """Piecewise-linear between anchors, flat outside them."""
    if any(b <= a for a, b in zip(anchors, anchors[1:])):
        raise ValueError("anchors must increase")
    out: dict[tuple[int, int], float] = {}
    for p in points:
        if p <= anchors[0]:
            out[p, anchors[0]] = 1.0
        elif p >= anchors[-1]:
            out[p, anchors[-1]] = 1.0
        else:
            k = max(i for i, a in enumerate(anchors) if a <= p)
            t = (p - anchors[k]) / (anchors[k + 1] - anchors[k])
            out[p, anchors[k]] = 1.0 - t
            if t > 0:
                out[p, anchors[k + 1]] = t
    return out


def smoothing_weights(points: list[int], window: int) -> dict[tuple[int, int], float]:
    """Centred triangular moving average, weights renormalised at the edges."""
    if window % 2 == 0 or window < 1:
        raise ValueError("the smoothing window is odd")
    if any(b != a + 1 for a, b in zip(points, points[1:])):
        raise ValueError("smoothing points must be consecutive")
    half = window // 2
    out: dict[tuple[int, int], float] = {}
    for i in points:
        near = {j: half + 1 - abs(i - j) for j in points if abs(i - j) <= half}
        total = sum(near.values())
        out.update({(i, j): w / total for j, w in near.items()})
    return out


def chain_weights(outer: dict, inner: dict) -> dict[tuple[int, int], float]:
    """Weights of ``outer`` applied after ``inner``, so that data are joined once."""
    out: dict[tuple[int, int], float] = {}
    for (i, j), w in outer.items():
        for (k, a), v in inner.items():
            if j == k:
                out[i, a] = out.get((i, a), 0.0) + w * v
    return out


def weight_table(spark: SparkSession, weights: dict, target: str, source: str) -> DataFrame:
    rows = [(int(i), int(j), float(w)) for (i, j), w in sorted(weights.items())]
    return small_table(spark, rows, f"{target} int, {source} int, _w double")


def apply_weights(df: DataFrame, weights: dict, by, index: str, value: str, scale: bool = False) -> DataFrame:
    """Weighted sums along one dimension: ``out[i] = sum_j w[i, j] * value[j]``.

    With ``scale`` the sum is divided by the weight actually present, for series
    with gaps.
    """
    w = weight_table(df.sparkSession, weights, "_target", index)
    joined = df.select(*by, F.col(index).cast("int").alias(index), F.col(value).alias("_v")).join(w, index)
    total = F.sum(F.col("_v") * F.col("_w"))
    if scale:
        total = F.try_divide(total, F.sum("_w"))
    return joined.groupBy(*by, F.col("_target").alias(index)).agg(total.alias(value))


# ---------------------------------------------------------------- shares


def share(df: DataFrame, by, value: str, name: str = "share", default: float | None = 0.0) -> DataFrame:
    """Share of the group total; ``df`` holds count cells."""
    return df.withColumn(name, safe_ratio(value, F.sum(or_zero(value)).over(W.partitionBy(*by)), default))


def close(df: DataFrame, by, value: str) -> DataFrame:
    """Renormalise so each group sums to one."""
    return df.withColumn(value, safe_ratio(value, F.sum(or_zero(value)).over(W.partitionBy(*by)), None))


def softmax(df: DataFrame, by, score: str, name: str) -> DataFrame:
    """Softmax per group with the maximum subtracted first."""
    w = W.partitionBy(*by)
    shifted = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return shifted.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def ordered_codes(df: DataFrame, by, label: str, name: str = "sort_order", start: int = 0) -> DataFrame:
    """Dense rank of labels, used to append sort orders after existing ones."""
    w = W.partitionBy(*by).orderBy(label) if by else W.orderBy(label)
    return df.withColumn(name, F.dense_rank().over(w) + F.lit(start))


# ---------------------------------------------------------------- survey fractions


def floor_counts(df: DataFrame, by_cell, value: str, floor: float) -> DataFrame:
    """Flag cells that are zero or missing at the source before applying a numeric floor."""
    return df.groupBy(*by_cell).agg(
        F.every(F.coalesce(F.col(value) <= 0, F.lit(True))).alias("source_zero"),
        F.greatest(F.coalesce(F.sum(or_zero(value)), F.lit(0.0)), F.lit(floor)).alias(value),
    )


def counts_to_fractions(
    counts: DataFrame, strata, code: str, codes, value: str, levels: dict[str, list[str]],
    effective: str | None = None, tolerance: float = 1e-12,
) -> DataFrame:
    """Fractions per stratum, borrowed from the first donor level where a stratum is empty.

    ``counts`` is a complete grid of strata x codes.  The effective sample size of a
    borrowed stratum is the donor's.
    """
    strata = list(strata)
    base = counts.select(
        *strata, code, or_zero(value).alias("observed"),
        (or_zero(effective) if effective else F.lit(0.0)).alias("_n"),
    )
    w = W.partitionBy(*strata)
    base = base.withColumn("total", F.sum("observed").over(w))
    # the stratum size sits on one code row only, so that donor sums count it once
    base = base.withColumn("_n_once", F.when(F.col(code) == F.lit(list(codes)[0]), F.col("_n")).otherwise(0.0))
    # own strata, empty strata and donors all read this table: write it once
    base = materialise(base, "survey-counts")
    own = base.filter(F.col("total") > tolerance).select(
        *strata, code, "observed", "total",
        (F.col("observed") / F.col("total")).alias("fraction"),
        F.lit("own").alias("fraction_source"),
        F.col("_n").alias("effective_n"),
    )
    empty = base.filter(F.col("total") <= tolerance).select(*strata).distinct()
    table = donor_table(base, levels, code, codes, "observed", extra={"effective_n": "_n_once"})
    lent = borrow(empty, table, levels, code, codes, tolerance, extra=("effective_n",))
    lent = lent.select(
        *strata, code, F.lit(0.0).alias("observed"), F.lit(0.0).alias("total"), F.col("donor_share").alias("fraction"),
        F.concat(F.lit("borrowed:"), F.col("donor_level")).alias("fraction_source"), "effective_n",
    )
    return own.unionByName(lent)


@dataclass(frozen=True)
class AnchorCorrection:
    """Linear extrapolation of one code at one anchor: ``2 * middle - far``."""

    code: int
    target: int
    middle: int
    far: int
    require_source_zero: bool = False
    require_far_positive: bool = False


def correct_anchors(
    fractions: DataFrame, strata, code: str, year: str, fraction: str, source_zero: str,
    corrections: list[AnchorCorrection], years: list[int], bias_floor: float = 1e-5,
    fraction_floor: float = 1e-8, tolerance: float = 1e-14,
) -> DataFrame:
    """Harmonise listed codes across anchors, floor, and close twice.

    Adds ``fraction_corrected`` (closed) and ``fraction_model`` (floored and closed).
    """
    strata = list(strata)
    key = [*strata, code]
    wide = (
        fractions.groupBy(*key).pivot(year, years).agg(F.first(fraction))
        .join(fractions.groupBy(*key).agg(F.every(source_zero).alias("_zero")), key)
    )
    new: dict[int, Column] = {y: F.coalesce(F.col(f"`{y}`"), F.lit(0.0)) for y in years}
    flags: dict[int, Column] = {y: F.lit(False) for y in years}
    for c in corrections:
        here = F.col(code) == c.code
        hit = here & (F.col(f"`{c.middle}`") > tolerance)
        if c.require_source_zero:
            hit = hit & F.col("_zero")
        if c.require_far_positive:
            hit = hit & (F.col(f"`{c.far}`") > tolerance)
        guess = 2 * F.col(f"`{c.middle}`") - F.col(f"`{c.far}`")
        corrected = F.when(hit, guess).otherwise(new[c.target])
        new[c.target] = F.when(here, F.greatest(corrected, F.lit(bias_floor))).otherwise(new[c.target])
        flags[c.target] = flags[c.target] | hit
    rows = F.array(*[F.struct(F.lit(y).alias(year), new[y].alias("_f"), flags[y].alias("correction_applied")) for y in years])
    long = wide.select(*key, F.explode(rows).alias("_r")).select(*key, "_r.*")
    w = W.partitionBy(*strata, year)
    long = long.withColumn("_f", F.greatest(F.col("_f"), F.lit(0.0)))
    long = long.withColumn("fraction_corrected", F.col("_f") / F.sum("_f").over(w)).drop("_f")
    long = long.withColumn("_m", F.greatest(F.col("fraction_corrected"), F.lit(fraction_floor)))
    return long.withColumn("fraction_model", F.col("_m") / F.sum("_m").over(w)).drop("_m")


# ---------------------------------------------------------------- hierarchical log ratios


@dataclass(frozen=True)
class CompositionTree:
    """Codes partitioned into broad groups, each with a reference code."""

    groups: dict[str, list]
    reference_code: object

    @property
    def codes(self) -> list:
        return [c for cs in self.groups.values() for c in cs]

    @property
    def reference_group(self) -> str:
        return next(g for g, cs in self.groups.items() if self.reference_code in cs)

    def reference_of(self, group: str):
        cs = self.groups[group]
        return self.reference_code if self.reference_code in cs else max(cs)

    def group_column(self, code: str) -> Column:
        out = F.lit(None).cast("string")
        for g, cs in self.groups.items():
            out = F.when(F.col(code).isin(list(cs)), F.lit(g)).otherwise(out)
        return out

    def reference_column(self, group: str, code_type: str) -> Column:
        out = F.lit(None).cast(code_type)
        for g in self.groups:
            out = F.when(F.col(group) == g, F.lit(self.reference_of(g)).cast(code_type)).otherwise(out)
        return out

    def table(self, spark: SparkSession, code: str, code_type: str = "int") -> DataFrame:
        rows = [(c, g, i + 1) for i, (g, cs) in enumerate(self.groups.items()) for c in cs]
        return small_table(spark, rows, f"{code} {code_type}, broad_group string, broad_order int")


def alr_variance(n, p, r) -> Column:
    """Sampling variance of ``log p - log r``; infinite without sampling information."""
    ok = finite(n) & (n > 0) & (p > 0) & (r > 0)
    return F.when(ok, F.try_divide(F.lit(1.0), n * p) + F.try_divide(F.lit(1.0), n * r)).otherwise(F.lit(float("inf")))


def log_ratio_observations(
    fractions: DataFrame, tree: CompositionTree, strata, year: str, code: str, fraction: str, effective: str
) -> tuple[DataFrame, DataFrame]:
    """Additive log ratios: broad groups against the reference group, and codes within groups."""
    strata = list(strata)
    code_type = fractions.schema[code].dataType.simpleString()
    x = fractions.withColumn("broad_group", tree.group_column(code))
    cell = W.partitionBy(*strata, year)
    broad = x.groupBy(*strata, year, "broad_group").agg(
        F.sum(fraction).alias("broad_fraction"), F.max(effective).alias("effective_n")
    )
    is_ref = F.col("broad_group") == tree.reference_group
    broad = broad.withColumn("_ref", F.max(F.when(is_ref, F.col("broad_fraction"))).over(cell))
    broad = broad.select(
        *strata, year, "broad_group", "broad_fraction", is_ref.alias("is_reference"),
        F.when(is_ref, 0.0).otherwise(log_ratio("broad_fraction", "_ref")).alias("log_ratio"),
        F.when(is_ref, 0.0).otherwise(alr_variance(F.col("effective_n"), F.col("broad_fraction"), F.col("_ref"))).alias("alr_variance"),
    )
    inner = W.partitionBy(*strata, year, "broad_group")
    x = x.withColumn("_refcode", tree.reference_column("broad_group", code_type))
    own_ref = F.col(code) == F.col("_refcode")
    x = x.withColumns(
        {"_g": F.sum(fraction).over(inner), "_ref": F.max(F.when(own_ref, F.col(fraction))).over(inner)}
    )
    within = x.select(
        *strata, year, code, "broad_group", (F.col(fraction) / F.col("_g")).alias("within_fraction"),
        own_ref.alias("is_reference"),
        F.when(own_ref, 0.0).otherwise(log_ratio(fraction, "_ref")).alias("log_ratio"),
        F.when(own_ref, 0.0).otherwise(alr_variance(F.col(effective), F.col(fraction), F.col("_ref"))).alias("alr_variance"),
    )
    return broad, within


def annual_log_ratios(
    broad: DataFrame, within: DataFrame, strata, year: str, code: str, years, anchors, window: int
) -> tuple[DataFrame, DataFrame]:
    """Anchors to a smoothed annual path; interpolation and smoothing act as one weight table."""
    weights = chain_weights(smoothing_weights(list(years), window), interpolation_weights(list(years), list(anchors)))
    b = apply_weights(broad, weights, [*strata, "broad_group"], year, "log_ratio")
    w = apply_weights(within, weights, [*strata, "broad_group", code], year, "log_ratio")
    return b, w


def compose_fractions(broad: DataFrame, within: DataFrame, strata, year: str, code: str) -> DataFrame:
    """Back-transform: softmax over groups times softmax within groups, closed."""
    strata = list(strata)
    b = softmax(broad, [*strata, year], "log_ratio", "_b").select(*strata, year, "broad_group", "_b")
    w = softmax(within, [*strata, year, "broad_group"], "log_ratio", "_w")
    out = w.join(b, [*strata, year, "broad_group"]).withColumn("fraction", F.col("_b") * F.col("_w"))
    return close(out.select(*strata, year, "broad_group", code, "fraction"), [*strata, year], "fraction")


def log_ratio_trends(observed_broad, observed_within, annual_broad, annual_within, strata, year: str, code: str) -> DataFrame:
    """Observed anchors and annual paths of both levels in one long table."""
    pieces = []
    for src, level, status in (
        (observed_broad, "broad", "observed"), (observed_within, "within", "observed"),
        (annual_broad, "broad", "annual"), (annual_within, "within", "annual"),
    ):
        series = F.col("broad_group") if level == "broad" else F.col(code).cast("string")
        pieces.append(
            src.select(*strata, year, F.lit(level).alias("level"), F.lit(status).alias("status"), series.alias("series"), "log_ratio")
        )
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def fit_fraction_panel(
    fractions: DataFrame, tree: CompositionTree, strata, year: str, code: str, fraction: str, effective: str,
    years, anchors, window: int,
) -> DataFrame:
    """Anchor fractions to an annual fraction panel, end to end."""
    b, w = log_ratio_observations(fractions, tree, strata, year, code, fraction, effective)
    b, w = annual_log_ratios(b, w, strata, year, code, years, anchors, window)
    return compose_fractions(b, w, strata, year, code)
