"""The point-estimate run: stages from verified groups to the published cube.

Every stage is a DataFrame program; a ``StageStore`` writes its output once, which
gives restart points and keeps plans short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import aggregate, calibrate, compose, grid, hierarchy, rates, redistribute
from tallyloom.plans import study as cfg
from tallyloom.plans.certificates import analysis_groups
from tallyloom.plans.reallocation import Reallocation, apply, fit, pseudo_causes
from tallyloom.plans.study import CELL, KEY, STRATA, Study
from tallyloom.sources.stage import StageStore


@dataclass
class PointInputs:
    """Tables of one run; survey and register tables are already standardised."""

    groups: DataFrame  # verified groups with num
    population: DataFrame  # Popgroup, Sex, DeathYear, age5, Death_Prov, Pop
    survey_counts: DataFrame  # STRATA, nbdcode, year, count, effective_n (complete grid)
    adjusted: DataFrame  # Death_Prov, Sex, DeathYear, age5, adjusted
    envelope_survey: DataFrame  # Death_Prov, Sex, age5, DeathYear, survey, level
    prevalence: DataFrame  # Death_Prov, DeathYear, age5, prevalence
    register: DataFrame  # Death_Prov, Sex, age5, DeathYear, inj, npr
    za_mapping: DataFrame  # nbdcode, za_code, weight, hierarchy
    schedule: DataFrame  # Sex, age5, L00, L03, L015
    asr_weights: DataFrame  # standard_age, F


def clean_cells(groups: DataFrame, s: Study) -> DataFrame:
    """Exclusions, annual cells with the interpolated year, and the three unknown categories."""
    g = analysis_groups(groups)
    affected = (F.col("nbdcode") == 143) & (F.col("age5") == 3)
    by = ["Death_Prov", "Sex", "nbdcode", "age5", "Popgroup"]
    if s.interpolated:
        x = aggregate.annual_with_correction(g, by, "DeathYear", "num", affected, *s.interpolated)
    else:
        x = aggregate.grouped_sum(g, [*by, "DeathYear"], ["num"])
    x = redistribute.redistribute_unknown(x, "Sex", "num", [k for k in KEY if k != "Sex"], 8, [1, 2], drop_zero=True)
    x = redistribute.redistribute_unknown(x, "age5", "num", [k for k in KEY if k != "age5"], 999, s.ages, drop_zero=True)
    x = redistribute.redistribute_with_reference(
        x, "Popgroup", "num", ["Death_Prov", "Sex", "nbdcode", "age5"], "DeathYear", 8, s.groups, list(s.reference_years), s.early_max, drop_zero=True
    )
    return x.withColumnRenamed("num", "Deaths").select(*KEY, "Deaths")


def injury_fractions(counts: DataFrame, s: Study, draw=()) -> DataFrame:
    """Survey counts per anchor year to an annual fraction panel, borrowing where strata are empty."""
    strata = [*draw, *STRATA]
    levels = {n: [*draw, "year", *ks] for n, ks in cfg.DONOR_LEVELS.items()}
    f = compose.counts_to_fractions(counts, [*strata, "year"], "nbdcode", cfg.INJURY_CODES, "count", levels, "effective_n")
    f = f.withColumn("fraction", F.greatest("fraction", F.lit(1e-8)))
    f = compose.close(f, [*strata, "year"], "fraction")
    return compose.fit_fraction_panel(
        f, cfg.INJURY_TREE, strata, "year", "nbdcode", "fraction", "effective_n", s.year_list, s.anchors, s.smoothing_window
    )


def split_injuries(cells: DataFrame, panel: DataFrame, draw=()) -> DataFrame:
    """Natural cells as they are; the injury total of each cell split by the fraction panel."""
    keys = [*draw, *CELL]
    injury = cells.filter(F.col("nbdcode").isin(cfg.RAW_INJURY_CODES))
    p = panel.withColumnRenamed("year", "DeathYear").select(*keys, "nbdcode", "fraction")
    split = redistribute.apply_fractions(injury, p, keys, "nbdcode", "Deaths", "fraction")
    natural = cells.filter(~F.col("nbdcode").isin(cfg.RAW_INJURY_CODES))
    return natural.select(*keys, "nbdcode", "Deaths").unionByName(split)


def is_injury():
    return F.col("nbdcode").isin(cfg.INJURY_CODES)


def complete(cells: DataFrame, adjusted: DataFrame, register: DataFrame, s: Study) -> tuple[DataFrame, DataFrame]:
    """Registration completeness, then the register's trend in the last years."""
    folded = cells.withColumn("age5", F.when(F.col("age5") == 1, 2).otherwise(F.col("age5")))
    comp = aggregate.component_table(folded, ["Death_Prov", "Sex", "DeathYear", "age5"], F.col("Popgroup") == 1, is_injury(), "Deaths")
    scalars = calibrate.completeness_scalars(
        comp, adjusted, ["Death_Prov", "Sex", "age5"], "DeathYear", s.freeze_year, copy=("age5", 2, 1)
    )
    residual = (F.col("Popgroup") == 1) & ~is_injury()
    x = calibrate.apply_scalars(cells, scalars, ["Death_Prov", "Sex", "DeathYear", "age5"], residual, "Deaths")
    x = x.withColumn("inj", F.when(is_injury(), 1).otherwise(2))
    x = calibrate.trend_adjust(
        x, register, ["Death_Prov", "Sex", "age5", "inj"], "DeathYear", s.register_start, list(s.register_calibration), "Deaths", "npr", copy=("age5", 2, 1)
    )
    return calibrate.merge_codes(x, "nbdcode", {142: 141}, CELL, "Deaths"), scalars


def envelope_factors(cells: DataFrame, survey: DataFrame, s: Study, draw=()) -> DataFrame:
    """Level and profile of injuries against the surveys, for every year."""
    keys = [*draw, "Death_Prov", "Sex", "age5"]
    routine = cells.filter(F.col("DeathYear").isin(s.envelope_anchors)).groupBy(*keys, "DeathYear").agg(
        F.sum(F.when(is_injury(), F.col("Deaths")).otherwise(0.0)).alias("routine")
    )
    x = routine.join(survey, [*[d for d in draw if d in survey.columns], "Death_Prov", "Sex", "age5", "DeathYear"])
    first = s.envelope_anchors[0]
    x = x.withColumn("active", ~((F.col("DeathYear") == first) & F.col("age5").isin(1, 2)))
    year = "DeathYear"
    smoothing = ("age5", compose.smoothing_weights(s.ages, s.smoothing_window))
    if draw:
        # draws are further "years" of the profile: one composite period key
        x = x.withColumn("_period", F.struct(*[F.col(d) for d in draw], F.col(year)))
        a = calibrate.level_profile_anchors(x, "_period", ["Death_Prov", "Sex", "age5"], "routine", "survey", "level", "active", smooth=smoothing)
        a = a.select(*[F.col(f"_period.{d}").alias(d) for d in draw], F.col(f"_period.{year}").alias(year), *[c for c in a.columns if c != "_period"])
    else:
        a = calibrate.level_profile_anchors(x, year, keys, "routine", "survey", "level", "active", smooth=smoothing)
    inactive = (F.col(year) <= first) & F.col("age5").isin(1, 2)
    return calibrate.annual_factors(a, year, keys, s.year_list, s.envelope_anchors, inactive)


def calibrate_injuries(cells: DataFrame, factors: DataFrame, draw=()) -> DataFrame:
    """Move mass between injury and natural causes inside each cell to meet the yearly level."""
    cell = ["Death_Prov", "Sex", "Popgroup", "age5"]
    two = cells.groupBy(*draw, "DeathYear", *cell).agg(
        F.sum(F.when(is_injury(), F.col("Deaths")).otherwise(0.0)).alias("a"), F.sum(F.when(is_injury(), 0.0).otherwise(F.col("Deaths"))).alias("b")
    )
    x = two.join(factors, [*draw, "DeathYear", "Death_Prov", "Sex", "age5"])
    done = calibrate.calibrate_to_level(x, [*draw, "DeathYear"], cell, "a", "b", "log_profile", "log_level_ratio", "calibration_active")
    return calibrate.scale_classes(cells, done, [*draw, "DeathYear", *cell], is_injury(), "Deaths")


def hiv_spec(s: Study) -> Reallocation:
    return Reallocation(
        place="Death_Prov", sex="Sex", year="DeathYear", code="nbdcode", member="Popgroup", members=s.groups, value="Deaths",
        model_codes=list(cfg.HIV_GROUPS), destination=cfg.HIV_DESTINATION, receiver=cfg.HIV_CODE, base=float(s.years[0]), base_period=s.years[0],
        early=(s.years[0], s.years[0] + 6), age="age5", trend_ages=[18, 19], age_weight=cfg.hiv_age_weight(),
        exempt=(F.col("age5") >= 18) | (F.col("age5") == 1) | F.col("nbdcode").isin(cfg.HIV_UNMODELLED) | ((F.col("nbdcode") == 219) & (F.col("age5") < 6)),
        direct_codes=cfg.HIV_DIRECT, source_map={k: list(v) for k, v in cfg.HIV_GROUPS.items()},
    )


def hiv_panel(cells: DataFrame, population: DataFrame, prevalence: DataFrame, s: Study, draw=()) -> DataFrame:
    spec = hiv_spec(s)
    p = pseudo_causes(cells, spec).groupBy(*draw, *spec.cell, spec.year, spec.code).agg(F.sum("Deaths").alias("Deaths"))
    pop = population.groupBy("Death_Prov", "Sex", "DeathYear", "age5").agg(F.sum("Pop").alias("population"))
    return p.join(pop, ["Death_Prov", "Sex", "DeathYear", "age5"], "left").join(prevalence, ["Death_Prov", "DeathYear", "age5"], "left")


def redistribute_causes(cells: DataFrame, draw=(), multipliers: DataFrame | None = None) -> redistribute.EnvelopeResult:
    """Ordered rules on wide cells, then plausibility with envelope totals and donors."""
    keys = [*draw, *CELL]
    wide = grid.pivot_codes(cells, keys, "nbdcode", cfg.ALL_CODES, "Deaths")
    name = None
    if multipliers is not None:
        wide, name = wide.join(multipliers, "draw_id", "left"), "multipliers"
    moved = redistribute.compiled_moves(wide, keys, cfg.MOVE_RULES, cfg.ALL_CODES, multipliers=name)
    long = redistribute.masses_long(moved, keys, cfg.ALL_CODES, "nbdcode", "Deaths")
    levels = {n: [*draw, *ks] for n, ks in cfg.FALLBACK_LEVELS.items()}
    return redistribute.renormalise_envelopes(
        long, keys, "nbdcode", "Deaths", {"natural": cfg.NATURAL_CODES, "injury": cfg.INJURY_CODES}, cfg.EXCLUSIONS, levels,
        equal_codes={"natural": cfg.NATURAL_TARGETS},
    )


def run_point(i: PointInputs, s: Study, store: StageStore) -> dict[str, DataFrame]:
    """All stages in order; the returned tables are read back from the store."""
    out: dict[str, DataFrame] = {}
    clean = out["clean"] = store.write(clean_cells(i.groups, s), "02_clean")
    panel = out["fractions"] = store.write(injury_fractions(i.survey_counts, s), "03_fractions")
    split = store.write(split_injuries(clean, panel), "03_split")
    done, scalars = complete(split, i.adjusted, i.register, s)
    out["scalars"] = store.write(scalars, "04_scalars")
    done = store.write(done, "04_completed")
    out["factors"] = factors = store.write(envelope_factors(done, i.envelope_survey, s), "04_factors")
    cal = out["calibrated"] = store.write(calibrate_injuries(done, factors), "04_calibrated")
    hiv = store.write(hiv_panel(cal, i.population, i.prevalence, s), "05_panel")
    spec = hiv_spec(s)
    trends, intercepts = fit(hiv, spec)
    out["trends"], out["intercepts"] = store.write(trends, "05_trends"), store.write(intercepts, "05_intercepts")
    moved = out["reallocated"] = store.write(apply(cal, hiv, out["trends"], out["intercepts"], spec), "05_reallocated")
    res = redistribute_causes(moved)
    out["redistributed"] = red = store.write(res.cells, "06_redistributed")
    out["fallback"] = store.write(res.fallback, "06_fallback")
    za = hierarchy.roll_up(red, i.za_mapping, CELL, "nbdcode", "za_code", "Deaths").withColumnRenamed("za_code", "nbdcode")
    out["yll"] = y = store.write(rates.yll(za, i.schedule, ["Sex", "age5"], "Deaths"), "07_yll")
    den = rates.denominators(i.population, "Death_Prov", "Popgroup", "Sex", "DeathYear", "age5", "Pop", s.ages[1:])
    cube = rates.final_cube(
        y.withColumn("age", F.col("age5") - 1), den, i.asr_weights, places=s.provinces, national=s.national
    )
    out["cube"] = store.write(cube, "08_cube", sort_by=["Grouping", "Sex", "nbdcode", "DeathYear", "Age"])
    return out
