"""Joint uncertainty: a block of draws as one DataFrame program.

``draw_id`` is part of every key.  Blocks are independent, appended to a partitioned
store, and a restart computes only the blocks that are not complete.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.hashing import seed_of
from tallyloom.operators import aggregate, draws, grid, survey, validate
from tallyloom.plans import point
from tallyloom.plans import study as cfg
from tallyloom.plans.reallocation import apply
from tallyloom.plans.study import CELL, Study
from tallyloom.session import materialise
from tallyloom.sources import stores

DRAW = ("draw_id",)


@dataclass
class JointInputs:
    """What a draw perturbs, from a finished point run."""

    completed: DataFrame  # cells before calibration
    scalars: DataFrame  # completeness scalars
    survey_psus: DataFrame  # stratum_id, psu_id
    survey_level: DataFrame  # stratum_id, psu_id, Death_Prov, Sex, age5, DeathYear, weighted
    survey_counts: DataFrame  # fraction input per stratum and anchor
    trends: DataFrame
    intercepts: DataFrame
    population: DataFrame
    prevalence: DataFrame
    calibrated: DataFrame | None = None  # with redistributed: what the preflight rebuilds and compares
    redistributed: DataFrame | None = None
    survey_causes: DataFrame | None = None  # stratum_id, psu_id, the strata, nbdcode, year, weighted: anchors that follow the bootstrap


def completeness_draws(j: JointInputs, s: Study, first: int, last: int, seed: int) -> DataFrame:
    """Mean-one factor per draw and province on the residual class."""
    affected = (F.col("Popgroup") == 1) & ~point.is_injury()
    spread = draws.log_dispersion(
        j.scalars.filter("age5 <> 1"), j.completed.filter(affected), ["Death_Prov", "Sex", "age5"], "Death_Prov", "DeathYear", "s2", "Deaths", s.freeze_year
    )
    f = draws.lognormal_factors(spread, "Death_Prov", "log_sd", first, last, seed)
    return draws.apply_factors(draws.with_draws(j.completed, first, last), f, [*DRAW, "Death_Prov"], affected, "Deaths")


def survey_envelope_draws(j: JointInputs, s: Study, m: DataFrame, first: int, last: int) -> DataFrame:
    """Replicate survey envelope and level per draw, from unit multipliers ``m``."""
    keys = ["Death_Prov", "Sex", "age5", "DeathYear"]
    rep = survey.replicate_totals(j.survey_level, m, "stratum_id", "psu_id", keys, "weighted")
    full = grid.complete_cells(
        rep, [*DRAW, *keys], ["weighted"],
        {"draw_id": list(range(first, last + 1)), "Death_Prov": s.provinces, "Sex": [1, 2], "age5": s.ages, "DeathYear": s.envelope_anchors},
    )
    level = rep.groupBy(*DRAW, "DeathYear").agg(F.sum("weighted").alias("level"))
    return full.withColumnRenamed("weighted", "survey").join(level, [*DRAW, "DeathYear"])


def replicate_counts(j: JointInputs, m: DataFrame, first: int, last: int) -> DataFrame:
    """Cause counts of the resampled units, for the anchors whose records carry units.

    The multipliers are those of the level, so level and composition of a draw belong together.
    """
    keys = [*cfg.STRATA, "nbdcode", "year"]
    years = j.survey_causes.select("year").distinct()
    rep = survey.replicate_totals(j.survey_causes, m, "stratum_id", "psu_id", keys, "weighted")
    keep = draws.with_draws(j.survey_counts.join(years, "year", "left_semi").select(*keys, "effective_n"), first, last)
    out = keep.join(rep, [*DRAW, *keys], "left")
    return out.select(*DRAW, *keys, F.coalesce("weighted", F.lit(0.0)).alias("count"), "effective_n")


def fraction_draws(j: JointInputs, s: Study, m: DataFrame, first: int, last: int, seed) -> DataFrame:
    """Anchor compositions of each draw, then the usual annual path.

    Anchors with unit records follow the bootstrap; the others are drawn from a Dirichlet.
    """
    fixed = j.survey_counts
    if j.survey_causes is not None:
        fixed = fixed.join(j.survey_causes.select("year").distinct(), "year", "left_anti")
    counts = dirichlet_counts(fixed, first, last, seed)
    if j.survey_causes is not None:
        counts = counts.unionByName(replicate_counts(j, m, first, last))
    return point.injury_fractions(counts, s, DRAW)


def dirichlet_counts(survey_counts: DataFrame, first: int, last: int, seed) -> DataFrame:
    """Counts of each anchor with its composition drawn around the observed one."""
    group = [*cfg.STRATA, "year"]
    total = survey_counts.groupBy(*group).agg(F.sum("count").alias("_t"))
    x = survey_counts.join(total, group).withColumn("f", F.when(F.col("_t") > 0, F.col("count") / F.col("_t")).otherwise(0.0))
    d = draws.dirichlet_draws(x.filter("_t > 0"), group, "nbdcode", "f", "effective_n", first, last, seed)
    keep = survey_counts.select(*group, "nbdcode", "count", "effective_n").join(total, group)
    drawn = draws.with_draws(keep, first, last).join(d, [*DRAW, *group, "nbdcode"], "left")
    return drawn.withColumn("count", F.coalesce(F.col("draw_fraction") * F.col("_t"), F.lit(0.0))).drop("_t", "draw_fraction")


def run_block(j: JointInputs, s: Study, first: int, last: int, seed: int) -> dict[str, DataFrame]:
    """Draws first..last: completeness, surveys, calibration, fractions, reallocation, redistribution."""
    base = materialise(completeness_draws(j, s, first, last, seed_of(seed, "completeness")), "draw-completeness")
    m = survey.bootstrap_multipliers(j.survey_psus, "stratum_id", "psu_id", last - first + 1, seed_of(seed, "injury_envelope"), first)
    m = materialise(m, "draw-multipliers")
    factors = point.envelope_factors(base, survey_envelope_draws(j, s, m, first, last), s, DRAW)
    cal = materialise(point.calibrate_injuries(base, factors, DRAW), "draw-calibrated")
    split = materialise(point.split_injuries(cal, fraction_draws(j, s, m, first, last, seed_of(seed, "injury")), DRAW), "draw-split")
    spec = point.hiv_spec(s)
    panel = materialise(point.hiv_panel(split, j.population, j.prevalence, s, DRAW), "draw-panel")
    model = seed_of(seed, "hiv_model")
    trends = draws.draw_slopes(j.trends, [spec.code, spec.place, spec.sex], first, last, model, shared=[spec.code])
    intercepts = draws.draw_intercepts(j.intercepts, spec.cell, first, last, model)
    moved = materialise(apply(split, panel, trends, intercepts, spec, DRAW), "draw-reallocated")
    multipliers = draws.rule_multipliers(base.sparkSession, cfg.MOVE_RULES, first, last, seed_of(seed, "redistribution"))
    red = materialise(point.redistribute_causes(moved, DRAW, multipliers).cells, "draw-redistributed")
    checks = validate.report(
        validate.group_totals_preserved(base, cal, [*DRAW, *CELL], "Deaths", name="calibration"),
        validate.group_totals_preserved(cal, split, [*DRAW, *CELL], "Deaths", name="fractions"),
        validate.group_totals_preserved(split, moved, [*DRAW, *CELL], "Deaths", name="reallocation"),
        validate.group_totals_preserved(moved, red, [*DRAW, *CELL], "Deaths", name="redistribution"),
        validate.group_totals_preserved(base, red, DRAW, "Deaths", name="propagation"),
        validate.group_totals_preserved(cal.filter(point.is_injury()), split.filter(point.is_injury()), [*DRAW, *CELL], "Deaths", name="injury envelope"),
        validate.non_negative(red, ["Deaths"]),
    )
    return {"cells": red, "checks": checks, "multipliers": multipliers}


def report_series(cells: DataFrame, s: Study) -> DataFrame:
    """Series of each draw with one column per base age, for provinces and for population groups.

    ``scope`` tells the two apart; the place column of the other scope is NULL. Provinces also have
    the national row, and both scopes both sexes.
    """
    series = F.array(
        F.concat(F.lit("nbd_"), F.col("nbdcode").cast("string")), F.lit("all_causes"), F.when(point.is_injury(), F.lit("all_injuries"))
    )
    x = cells.withColumn("cause_id", F.explode(F.array_compact(series)))
    x = x.groupBy("draw_id", "Death_Prov", "Popgroup", "Sex", "DeathYear", "cause_id", "age5").agg(F.sum("Deaths").alias("Deaths"))
    scopes = []
    for scope, place, margins in (("province", "Death_Prov", {"Death_Prov": s.national, "Sex": 3}), ("population_group", "Popgroup", {"Sex": 3})):
        keys = ["draw_id", place, "Sex", "DeathYear", "cause_id", "age5"]
        m = aggregate.margins(x.groupBy(*keys).agg(F.sum("Deaths").alias("Deaths")), keys, margins, ["Deaths"])
        m = m.withColumns({"age": F.col("age5") - 1, "scope": F.lit(scope)})
        scopes.append(grid.pivot_codes(m, ["draw_id", "scope", place, "Sex", "DeathYear", "cause_id"], "age", [a - 1 for a in s.ages], "Deaths", prefix="age_"))
    return scopes[0].unionByName(scopes[1], allowMissingColumns=True)


def preflight(j: JointInputs, s: Study) -> DataFrame:
    """The point run's last stages again, from its calibrated cells, against what it saved.

    One row as of ``validate.table_error``; drawing starts only if no cell is over tolerance.
    """
    panel = materialise(point.hiv_panel(j.calibrated, j.population, j.prevalence, s), "preflight-panel")
    moved = materialise(apply(j.calibrated, panel, j.trends, j.intercepts, point.hiv_spec(s)), "preflight-moved")
    red = point.redistribute_causes(moved).cells
    return validate.table_error(j.redistributed, red, [*CELL, "nbdcode"], "Deaths")


def run_joint(j: JointInputs, s: Study, path: str, draws_total: int, per_block: int, seed: int, policy=validate.Policy.RAISE) -> DataFrame:
    """Append missing blocks of draws to the store and return the store."""
    spark = j.completed.sparkSession
    todo = list(range(-(-draws_total // per_block)))
    if j.calibrated is not None and j.redistributed is not None and (off := preflight(j, s).first())["over_tolerance"]:
        raise AssertionError(f"the point run cannot be rebuilt: {off.asDict()}")
    if stores.store_exists(spark, path):
        todo = sorted(r["draw_block"] for r in stores.pending_blocks(spark, path, draws_total, per_block).collect())
    for b in todo:
        first = b * per_block + 1
        out = run_block(j, s, first, min(first + per_block - 1, draws_total), seed)
        validate.enforce(out["checks"], policy)
        stores.write_draw_block(report_series(out["cells"], s), path, b)
    return spark.read.parquet(path)
