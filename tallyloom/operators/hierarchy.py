"""Weighted many-to-many roll-ups and membership tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import or_zero, plain_label
from tallyloom.operators.aggregate import in_order, joined_labels
from tallyloom.operators.grid import complete_codes
from tallyloom.operators.validate import group_errors


def unmapped_mass(df: DataFrame, mapping: DataFrame, source: str, value: str, tolerance: float = 1e-8) -> DataFrame:
    """Source codes outside the mapping that still carry mass."""
    stray = df.join(mapping.select(source).distinct(), source, "left_anti")
    return stray.groupBy(source).agg(F.sum(or_zero(value)).alias("amount")).filter(F.abs("amount") > tolerance)


def roll_up(
    df: DataFrame, mapping: DataFrame, by, source: str, target: str, value: str, weight: str = "weight",
    complete: list | None = None, strict: bool = True, tolerance: float = 1e-8,
) -> DataFrame:
    """Map source codes to weighted targets and sum; layers of the mapping may overlap.

    Cells are summed on (group, source) before the many-to-many join, so the join
    multiplies aggregated rows rather than records.  With ``strict`` a non-zero
    source outside the mapping fails the job where it is met.
    """
    by = list(by)
    cells = df.groupBy(*by, source).agg(F.sum(or_zero(value)).alias("_v"))
    m = mapping.select(F.col(source), F.col(target).alias("_target"), F.col(weight).cast("double").alias("_w"))
    joined = cells.join(m, source, "left" if strict else "inner")
    contribution = F.col("_v") * F.col("_w")
    if strict:
        lost = F.col("_target").isNull() & (F.abs("_v") > tolerance)
        contribution = F.when(
            lost, F.raise_error(F.concat(F.lit("unmapped mass in source "), F.col(source).cast("string"))).cast("double")
        ).otherwise(contribution)
    # the check has to run on the unmapped rows too, so they are dropped after it
    summed = (
        joined.groupBy(*by, F.col("_target").alias(target)).agg(F.sum(contribution).alias(value))
        .filter(F.col(value).isNotNull())
    )
    return summed if complete is None else complete_codes(summed, by, target, complete, value)


def layer_conservation(
    df: DataFrame, rolled: DataFrame, mapping: DataFrame, by, source: str, target: str, value: str, layer: str,
    layer_column: str = "hierarchy",
) -> DataFrame:
    """Per-group error of a layer that partitions its sources."""
    part = mapping.filter(F.col(layer_column) == layer)
    before = df.join(part.select(source).distinct(), source, "left_semi")
    after = rolled.join(part.select(F.col(target)).distinct(), target, "left_semi")
    return group_errors(before, after, by, value)


def mapping_contract(mapping: DataFrame, source: str, target: str, partition_layer: str, layer_column: str = "hierarchy") -> DataFrame:
    """Per layer: sources, targets, sources with several targets, and non-unit weights.

    In the partition layer every source must have exactly one target of weight one.
    """
    per_source = mapping.groupBy(layer_column, source).agg(
        F.count_distinct(target).alias("_t"), F.min("weight").alias("_lo"), F.max("weight").alias("_hi")
    )
    targets = mapping.groupBy(layer_column).agg(F.count_distinct(target).alias("targets"))
    out = per_source.groupBy(layer_column).agg(
        F.count("*").alias("sources"),
        F.count_if(F.col("_t") > 1).alias("multi_target_sources"),
        F.count_if((F.col("_lo") != 1) | (F.col("_hi") != 1)).alias("non_unit_weights"),
    )
    ok = (F.col(layer_column) != partition_layer) | ((F.col("multi_target_sources") == 0) & (F.col("non_unit_weights") == 0))
    return out.join(targets, layer_column).withColumn("ok", ok)


def expand_list(df: DataFrame, column: str, member: str, sep: str = ";", dtype: str = "int") -> DataFrame:
    """Delimited code list to one row per member; blanks ignored."""
    out = df.withColumn(member, F.explode(F.split(F.col(column), sep))).withColumn(member, F.trim(member))
    return out.filter(F.col(member) != "").withColumn(member, F.col(member).try_cast(dtype))


def ambiguous_aliases(aliases: DataFrame, alias: str, target: str) -> DataFrame:
    """Normalised aliases that point to more than one target."""
    return (
        aliases.groupBy(plain_label(alias).alias(alias))
        .agg(F.count_distinct(target).alias("targets"))
        .filter("targets > 1")
    )


def attach_by_alias(df: DataFrame, column: str, aliases: DataFrame, alias: str, target: str) -> DataFrame:
    """Resolve free-text labels through a normalised alias table; unresolved stay NULL."""
    keyed = aliases.select(plain_label(alias).alias("_k"), F.col(target)).distinct()
    return df.withColumn("_k", plain_label(column)).join(keyed, "_k", "left").drop("_k")


def attach_labels(df: DataFrame, labels: DataFrame, key: str, label: str, strict: bool = True) -> DataFrame:
    """Label lookup; with ``strict`` an unmapped key fails the job."""
    out = df.join(labels.select(key, F.col(label).alias("_l")), key, "left")
    if strict:
        fail = F.raise_error(F.concat(F.lit(f"no label for {key} "), F.col(key).cast("string"))).cast("string")
        return out.withColumn(label, F.coalesce(F.col("_l"), fail)).drop("_l")
    return out.withColumn(label, F.col("_l")).drop("_l")


def map_measures(df: DataFrame, mapping: DataFrame, by, source: str, target: str, measures, weight: str = "weight") -> DataFrame:
    """Weighted series mapping of several measure columns at once (e.g. 20 base ages)."""
    m = mapping.select(source, F.col(target).alias("_target"), F.col(weight).cast("double").alias("_w"))
    joined = df.join(m, source, "inner")
    return joined.groupBy(*by, F.col("_target").alias(target)).agg(
        *[F.sum(F.col(c) * F.col("_w")).alias(c) for c in measures]
    )


def supported_series(mapping: DataFrame, available: DataFrame, series: str, source: str, weight: str = "weight") -> DataFrame:
    """Which series can be rebuilt exactly from the available source codes.

    A series is dropped when a component is missing or when components overlap (a
    code enters with more than weight one); the reason and the missing codes are
    reported.
    """
    per_code = mapping.groupBy(series, source).agg(F.sum(weight).alias("_w"))
    have = available.select(source).distinct().withColumn("_have", F.lit(True))
    missing = F.when(F.col("_have").isNull(), F.col(source).cast("string"))
    flagged = per_code.join(have, source, "left").withColumn("_missing", missing)
    flagged = in_order(flagged, [series], "_missing")
    out = flagged.groupBy(series).agg(
        F.count("*").alias("components"),
        F.count("_missing").alias("missing"),
        F.count_if(F.col("_w") > 1 + 1e-12).alias("overlapping"),
        joined_labels("_missing", "missing_codes"),
    )
    reason = F.when(F.col("missing") > 0, "missing_component").when(F.col("overlapping") > 0, "overlapping_components").otherwise("supported")
    return out.withColumn("status", reason)


def membership_differences(configured: DataFrame, derived: DataFrame, series: str, code: str) -> DataFrame:
    """Both-way difference between a configured and a hierarchy-derived membership."""
    keys = [series, code]
    a, b = configured.select(*keys).distinct(), derived.select(*keys).distinct()
    return (
        a.join(b, keys, "left_anti").withColumn("side", F.lit("configured_only"))
        .unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("derived_only")))
    )
