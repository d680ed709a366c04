"""Complex-survey estimation: designs, domain tables and the stratified bootstrap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions.columns import finite, or_zero, safe_ratio
from tallyloom.functions.hashing import uniform
from tallyloom.functions.quantiles import type8
from tallyloom.operators.aggregate import kish
from tallyloom.operators.grid import complete_cells
from tallyloom.operators.redistribute import redistribute_unknown


@dataclass
class SurveyDesign:
    """PSU list, level domain and cause domain of one survey."""

    psus: DataFrame
    level_domain: DataFrame
    cause_domain: DataFrame
    effective_n: DataFrame


def psu_id(psu, record) -> Column:
    """Sampling-unit id; a record without one is its own unit."""
    p = F.trim(F.col(psu).cast("string"))
    return F.when(p.isNotNull() & (p != ""), F.concat(F.lit("psu|"), p)).otherwise(
        F.concat(F.lit("record|"), F.col(record).cast("string"))
    )


def stratum_id(*parts) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("missing")) for p in parts])


def recode(c, mapping: dict, unknown) -> Column:
    """Code map with everything else, including NULL, as the unknown code."""
    out = F.lit(unknown)
    for old, new in mapping.items():
        out = F.when(F.col(c) == F.lit(old), F.lit(new)).otherwise(out)
    return out


def domain_totals(records: DataFrame, by, weight: str, name: str, eligible: Column | None = None) -> DataFrame:
    """Weighted totals of eligible records with a usable weight."""
    ok = finite(weight) & (F.col(weight) >= 0)
    x = records.filter(ok if eligible is None else ok & eligible)
    return x.groupBy(*by).agg(F.sum(weight).alias(name))


def build_design(
    records: DataFrame, weight: str, stratum: str, psu: str, level_dims, cause_dims, eligible: Column
) -> SurveyDesign:
    """Collapse records to the three tables every replicate is computed from."""
    ids = ["stratum_id", "psu_id"]
    x = records.withColumnsRenamed({stratum: "stratum_id", psu: "psu_id"})
    return SurveyDesign(
        psus=x.select(*ids).distinct(),
        level_domain=domain_totals(x, [*ids, *level_dims], weight, "weighted", eligible),
        cause_domain=domain_totals(x, [*ids, *cause_dims], weight, "weighted", eligible),
        effective_n=x.filter(eligible).agg(kish(weight).alias("effective_n")),
    )


def correct_weights(df: DataFrame, corrections: DataFrame, by, weight: str, old: str, new: str, tolerance: float = 1e-7) -> DataFrame:
    """Replace listed weights, matched by group and value within a tolerance.

    The tolerance match becomes an equi join on a rounded value and its two
    neighbours, so no pairwise comparison of records is needed.
    """
    step = tolerance * 2
    bucket = lambda c: F.floor(c / F.lit(step)).cast("bigint")
    near = corrections.select(
        *by, F.col(old).alias("_old"), F.col(new).alias("_new"),
        F.explode(F.array(bucket(F.col(old)) - 1, bucket(F.col(old)), bucket(F.col(old)) + 1)).alias("_b"),
    )
    j = df.withColumn("_b", bucket(F.col(weight))).join(near, [*by, "_b"], "left")
    hit = F.abs(F.col(weight) - F.col("_old")) < tolerance
    return j.withColumn(weight, F.when(hit, F.col("_new")).otherwise(F.col(weight))).drop("_b", "_old", "_new")


def redistribute_dimensions(df: DataFrame, dims: list[tuple[str, object, list]], keys, value: str) -> DataFrame:
    """Resolve unknown codes one dimension after another, in the given order."""
    keys = list(keys)
    for name, unknown, targets in dims:
        df = redistribute_unknown(df, name, value, [k for k in keys if k != name], unknown, targets)
    return df


def envelope_table(domain: DataFrame, dims, keys, value: str, levels: dict, effective_total: Column | float, within=()) -> DataFrame:
    """Survey envelope on a complete grid with shares and allocated effective sizes."""
    x = redistribute_dimensions(domain, dims, keys, value)
    x = complete_cells(x, [*within, *keys], [value], levels)
    total = F.sum(value).over(W.partitionBy(*within)) if within else x.agg(F.sum(value).alias("t")).scalar()
    s = safe_ratio(value, total, 0.0)
    n = F.lit(float(effective_total)) if isinstance(effective_total, (int, float)) else effective_total
    return x.withColumns({"share": s, "effective_n": s * n})


def copy_level(df: DataFrame, dim: str, src, dst) -> DataFrame:
    """Let one level of a dimension repeat another (replacing its own rows)."""
    levels = F.when(F.col(dim) == src, F.array(F.lit(src), F.lit(dst))).otherwise(F.array(F.col(dim)))
    return df.filter(F.col(dim) != dst).withColumn(dim, F.explode(levels))


def bundle(surveys: dict[str, DataFrame], keys, value: str) -> DataFrame:
    """Surveys side by side on the union of their keys; absent cells are zero."""
    out = None
    for name, df in surveys.items():
        cols = [F.when(F.lit(n == name), or_zero(value)).otherwise(0.0).alias(n) for n in surveys]
        part = df.select(*keys, *cols)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in surveys])


def reference_audit(totals: DataFrame, reference: DataFrame, keys, value: str, ref: str) -> DataFrame:
    j = totals.join(reference.select(*keys, F.col(ref).alias("reference")), list(keys), "full_outer")
    d = F.col(value) - F.col("reference")
    return j.withColumns({"difference": d, "relative": safe_ratio(d, "reference", None)})


# ---------------------------------------------------------------- bootstrap


def indexed_units(psus: DataFrame, stratum: str, psu: str, buckets: int = 64) -> DataFrame:
    """Number the units of each stratum 1..n and attach n.

    The numbering runs inside (stratum, hash bucket) and adds bucket offsets, so that
    a stratum with a third of all units is still spread over many tasks.
    """
    b = (F.conv(F.substring(F.md5(F.col(psu).cast("string")), 1, 4), 16, 10).cast("int") % buckets).alias("_b")
    x = psus.select(stratum, psu, b)
    sizes = x.groupBy(stratum, "_b").agg(F.count("*").alias("_c"))
    w = W.partitionBy(stratum).orderBy("_b")  # at most `buckets` rows
    offsets = sizes.select(
        stratum, "_b", (F.sum("_c").over(w) - F.col("_c")).alias("_off"),
        F.sum("_c").over(W.partitionBy(stratum)).alias("units"),
    )
    rn = F.row_number().over(W.partitionBy(stratum, "_b").orderBy(psu))
    return (
        x.withColumn("_rn", rn).join(offsets, [stratum, "_b"])
        .select(stratum, psu, (F.col("_off") + F.col("_rn")).cast("bigint").alias("unit_index"), "units")
    )


def bootstrap_multipliers(psus: DataFrame, stratum: str, psu: str, draws: int, seed: int, first: int = 1, buckets: int = 64) -> DataFrame:
    """How often each unit is drawn: n of n with replacement within each stratum, per draw.

    A single-unit stratum keeps multiplier one.  Units never drawn are absent (zero).
    The index of a slot is a hash of (seed, draw, stratum, slot): exact on retry.
    """
    units = indexed_units(psus, stratum, psu, buckets)
    slots = units.withColumn("draw_id", F.explode(F.sequence(F.lit(first), F.lit(first + draws - 1))))
    u = uniform(seed, F.col("draw_id"), F.col(stratum), F.col("unit_index"))
    pick = F.when(F.col("units") == 1, F.lit(1).cast("bigint")).otherwise(F.floor(u * F.col("units")).cast("bigint") + 1)
    counts = slots.groupBy("draw_id", stratum, pick.alias("unit_index")).agg(F.count("*").cast("double").alias("multiplier"))
    return counts.join(units.select(stratum, psu, "unit_index"), [stratum, "unit_index"]).select(
        "draw_id", stratum, psu, "multiplier"
    )


def replicate_totals(domain: DataFrame, multipliers: DataFrame, stratum: str, psu: str, by, value: str) -> DataFrame:
    """Weighted totals of each replicate; the domain is summed per unit before the join."""
    per_unit = domain.groupBy(stratum, psu, *by).agg(F.sum(value).alias("_v"))
    return (
        multipliers.join(per_unit, [stratum, psu])
        .groupBy("draw_id", *by).agg(F.sum(F.col("multiplier") * F.col("_v")).alias(value))
    )


def replicate_composition(replicates: DataFrame, by, value: str) -> DataFrame:
    """Shares within each replicate."""
    w = W.partitionBy("draw_id", *by)
    return replicates.withColumn("share", safe_ratio(value, F.sum(value).over(w), None))


def bootstrap_summary(replicates: DataFrame, point: DataFrame, by, value: str) -> DataFrame:
    """Standard error, type-8 95 % limits and log standard deviation of replicates."""
    by = list(by)
    usable = replicates.filter(finite(value) & (F.col(value) > 0))
    g = usable.groupBy(*by).agg(
        F.sort_array(F.collect_list(value)).alias("_a"),  # one entry per replicate
        F.stddev_samp(value).alias("standard_error"),
        F.stddev_samp(F.log(value)).alias("log_sd"),
        F.count("*").alias("replicates"),
    )
    p = point.select(*by, F.col(value).alias("point"))
    joined = g.join(p, by) if by else g.withColumn("point", p.select("point").scalar())
    return joined.select(
        *by, "point", "standard_error", type8("_a", 0.025).alias("lower"), type8("_a", 0.975).alias("upper"), "log_sd", "replicates"
    )


def dirichlet_effective_n(shares: DataFrame, point: DataFrame, by, category: str, share: str, minimum: int = 100, fallback: float = 0.0) -> DataFrame:
    """Effective size of the Dirichlet whose total share variance matches the replicates."""
    by = list(by)
    v = shares.groupBy(*by, category).agg(F.var_samp(share).alias("_v"), F.count("*").alias("_n"))
    j = v.join(point.select(*by, category, F.col(share).alias("_p")), [*by, category])
    g = j.groupBy(*by).agg(F.sum(F.col("_p") * F.col("_p")).alias("_pp"), F.sum("_v").alias("_vv"), F.min("_n").alias("_n"))
    est = F.try_divide(1.0 - F.col("_pp"), F.col("_vv")) - 1.0
    ok = (F.col("_n") >= minimum) & finite(est) & (est > 0)
    return g.select(*by, F.when(ok, est).otherwise(fallback).alias("effective_n"))
