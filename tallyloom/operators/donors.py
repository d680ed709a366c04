"""Hierarchical donors: borrow a composition from the first level that has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import or_zero
from tallyloom.operators.grid import literal_levels


def donor_table(cells: DataFrame, levels: dict[str, list[str]], code: str, codes, value: str, extra: dict | None = None) -> DataFrame:
    """Composition of every donor level as one row: ``_level, keys, _mass (map), _total``.

    All levels come from one GROUPING SETS aggregate.  The map holds at most one
    entry per code because the codes are summed before they are gathered.  ``extra``
    maps output names to columns that are summed alongside (stratum level measures
    must then be carried on a single code row per stratum).
    """
    extra = extra or {}
    keys = list(dict.fromkeys(k for ks in levels.values() for k in ks))
    base = cells.filter(F.col(code).isin(list(codes)))
    sets = [[F.col(k) for k in ks] + [F.col(code)] for ks in levels.values()]
    flags = [F.grouping(k).alias(f"_g_{k}") for k in keys]
    sums = base.groupingSets(sets, *[F.col(k) for k in keys], F.col(code)).agg(
        F.sum(or_zero(value)).alias("_v"), *[F.sum(or_zero(c)).alias(n) for n, c in extra.items()], *flags
    )
    level = F.lit(None).cast("string")
    for name, ks in levels.items():
        hit = F.lit(True)
        for k in keys:
            hit = hit & (F.col(f"_g_{k}") == (0 if k in ks else 1))
        level = F.when(hit, F.lit(name)).otherwise(level)
    return (
        sums.withColumn("_level", level)
        .groupBy("_level", *keys)
        .agg(
            F.map_from_entries(F.collect_list(F.struct(F.col(code), F.col("_v")))).alias("_mass"),
            F.sum("_v").alias("_total"),
            *[F.sum(n).alias(n) for n in extra],
        )
    )


def borrow(
    targets: DataFrame, table: DataFrame, levels: dict[str, list[str]], code: str, codes,
    tolerance: float = 1e-12, final_level: str = "equal", valid_codes=None, extra: tuple[str, ...] = (),
) -> DataFrame:
    """Expand each target cell over the codes with the first usable donor composition.

    ``targets`` has one row per cell.  ``valid_codes`` is an optional array column
    expression with the codes allowed in the closing equal split.  Adds ``code,
    donor_share, donor_level, donor_total, valid_targets``.
    """
    out = targets
    chosen = None
    for i, (name, ks) in enumerate(levels.items()):
        t = table.filter((F.col("_level") == name) & (F.col("_total") > tolerance))
        fields = [F.lit(name).alias("name"), F.col("_mass").alias("mass"), F.col("_total").alias("total")]
        t = t.select(*ks, F.struct(*fields, *[F.col(n) for n in extra]).alias(f"_d{i}"))
        # a level without keys is a single row: read it once instead of joining
        out = out.join(t, ks, "left") if ks else out.withColumn(f"_d{i}", t.select(f"_d{i}").scalar())
        chosen = F.col(f"_d{i}") if chosen is None else F.coalesce(chosen, F.col(f"_d{i}"))
    out = out.withColumn("_d", chosen).drop(*[f"_d{i}" for i in range(len(levels))])
    allowed = literal_levels(codes) if valid_codes is None else valid_codes
    out = out.withColumn("_ok", allowed).withColumn(code, F.explode(literal_levels(codes)))
    have = F.col("_d").isNotNull()
    equal = F.when(F.array_contains("_ok", F.col(code)), 1.0 / F.size("_ok")).otherwise(0.0)
    share = F.when(have, F.coalesce(F.element_at(F.col("_d.mass"), F.col(code)), F.lit(0.0)) / F.col("_d.total"))
    positive = F.size(F.filter(F.map_values(F.col("_d.mass")), lambda v: v > 0))
    return out.select(
        *targets.columns,
        code,
        F.when(have, share).otherwise(equal).alias("donor_share"),
        F.coalesce(F.col("_d.name"), F.lit(final_level)).alias("donor_level"),
        F.coalesce(F.col("_d.total"), F.lit(0.0)).alias("donor_total"),
        F.when(have, positive).otherwise(F.size("_ok")).alias("valid_targets"),
        *[F.coalesce(F.col(f"_d.{n}"), F.lit(0.0)).alias(n) for n in extra],
    )
