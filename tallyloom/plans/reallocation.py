"""Misclassified counts moved to the cause they belong to, end to end."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import safe_ratio
from tallyloom.operators import regress
from tallyloom.session import materialise


@dataclass
class Reallocation:
    """Column names, code sets and model settings of one reallocation."""

    place: str
    sex: str
    year: str
    code: str
    member: str
    members: list
    value: str
    model_codes: list
    destination: dict
    receiver: object
    base: float
    base_period: int
    early: tuple[int, int]
    age: str | None = None
    trend_ages: list | None = None
    age_weight: Column | None = None
    exempt: Column | None = None
    direct_codes: list = field(default_factory=list)
    source_map: dict | None = None

    @property
    def cell(self) -> list[str]:
        return [self.place, self.sex, *([self.age] if self.age else [])]


def pseudo_causes(cells: DataFrame, spec: Reallocation) -> DataFrame:
    """Collapse source codes to modelled groups; direct codes pass through unchanged."""
    if spec.source_map is None:
        return cells
    target = F.lit(None).cast(cells.schema[spec.code].dataType)
    for group, codes in spec.source_map.items():
        target = F.when(F.col(spec.code).isin(list(codes)), F.lit(group)).otherwise(target)
    target = F.when(F.col(spec.code).isin(list(spec.direct_codes)), F.col(spec.code)).otherwise(target)
    keys = [c for c in cells.columns if c not in (spec.code, spec.value)]
    x = cells.withColumn(spec.code, target).filter(F.col(spec.code).isNotNull())
    return x.groupBy(*keys, spec.code).agg(F.sum(spec.value).alias(spec.value))


def fit(panel: DataFrame, spec: Reallocation) -> tuple[DataFrame, DataFrame]:
    """Background trends and all-cause intercepts from a (cell, year, code) panel."""
    t = F.log1p(F.greatest(F.lit(0.0), F.col(spec.year) - F.lit(spec.base)))
    rows = panel.filter(F.col(spec.code).isin(spec.model_codes)).withColumn("_t", t)
    trend_rows = rows if spec.trend_ages is None else rows.filter(F.col(spec.age).isin(spec.trend_ages))
    # counts enter the Poisson model rounded half to even
    trend_rows = trend_rows.withColumn("_y", F.rint(spec.value))
    keys = [spec.code, spec.place, spec.sex]
    full = regress.poisson_trend(trend_rows, keys, "_t", "_y", "population", min_points=2)
    # only causes with a cell that has no model need the common slope
    full = materialise(full, "trend-models")
    lacking = full.filter(F.col("model_status") == "no_model").select(spec.code).distinct()
    wanted = trend_rows.join(lacking, [spec.code], "left_semi")
    common = regress.poisson_main_effects(wanted, [spec.code], "_t", [spec.place, spec.sex], "_y", "population")
    trends = regress.with_fallback(full, common, keys, [spec.code])
    total = rows.groupBy(*spec.cell, spec.year).agg(
        F.sum(spec.value).alias("_d"), F.max("population").alias("_n"), F.max("prevalence").alias("_x")
    )
    early = total.filter(F.col(spec.year).between(*spec.early)).withColumn("_rate", safe_ratio("_d", "_n", None, 1e5))
    return trends, regress.zero_intercepts(early, spec.cell, "_x", "_rate")


def apply(cells: DataFrame, panel: DataFrame, trends: DataFrame, intercepts: DataFrame, spec: Reallocation, draw: tuple[str, ...] = ()) -> DataFrame:
    """Excess over the background, allocated to sub-groups and moved to the receiver.

    ``draw`` adds a draw key to every join, so a block of draws is one pass.
    """
    draw = list(draw)
    base = panel.filter((F.col(spec.year) == spec.base_period) & F.col(spec.code).isin(spec.model_codes))
    per_cause = regress.intercept_by_cause(base, [*draw, *spec.cell], spec.code, spec.model_codes, spec.value, intercepts)
    weight = spec.age_weight if spec.age_weight is not None else F.lit(1.0)
    exempt = spec.exempt if spec.exempt is not None else F.lit(False)
    model = panel.filter(F.col(spec.code).isin(spec.model_codes))
    x = regress.expected_and_excess(
        model, trends, per_cause, [*draw, spec.code, spec.place, spec.sex], [*draw, *spec.cell, spec.code], spec.year, spec.value,
        "population", weight, spec.base, exempt,
    )
    keys = [*draw, *spec.cell, spec.year, spec.code]
    pseudo = pseudo_causes(cells, spec)
    moving = pseudo.filter(F.col(spec.code).isin([*spec.model_codes, *spec.direct_codes]))
    direct = moving.filter(F.col(spec.code).isin(spec.direct_codes)).groupBy(*keys).agg(F.sum(spec.value).alias("excess"))
    amount = x.select(*keys, "excess").unionByName(direct)
    alloc = regress.allocate_excess(moving, amount, keys, spec.member, spec.members, spec.value, "excess")
    affected = [c for cs in spec.source_map.values() for c in cs] if spec.source_map else list(spec.model_codes)
    return regress.reassemble(
        cells, alloc, [*draw, *spec.cell, spec.year, spec.member], spec.code, spec.value, [*affected, *spec.direct_codes],
        spec.destination, spec.receiver,
    )


def reallocate(cells: DataFrame, population: DataFrame, prevalence: DataFrame, spec: Reallocation) -> DataFrame:
    """Point estimate: build the panel once, fit, and move the excess."""
    pseudo = pseudo_causes(cells, spec)
    panel = pseudo.groupBy(*spec.cell, spec.year, spec.code).agg(F.sum(spec.value).alias(spec.value))
    pop_keys = [c for c in population.columns if c != "population"]
    prev_keys = [c for c in prevalence.columns if c != "prevalence"]
    panel = panel.join(population, pop_keys, "left").join(prevalence, prev_keys, "left")
    panel = materialise(panel, "reallocation-panel")
    trends, intercepts = fit(panel, spec)
    return apply(cells, panel, trends, intercepts, spec)
