"""From a written draw store to the published interval store.

The steps: the store holds exactly its draws; the rate standardised inside a draw gives the published rate when it
is fed with the point estimates; counts and rates of every series and age specification, and fractions
formed inside each draw, get their limits; points and limits are aligned key by key; the store is written by scope, sex and age.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.columns import finite, safe_ratio
from tallyloom.operators import summarise, validate
from tallyloom.operators.hierarchy import map_measures
from tallyloom.operators.rates import asr_wide
from tallyloom.session import materialise
from tallyloom.sources import stores

#: Relative error within which the rate of a draw must reproduce the published one.
ASR_TOLERANCE = 1e-8
#: Age code of a fraction, which has no age specification of its own.
ALL_AGES = 25


@dataclass
class IntervalInputs:
    by: list[str]  # what a cell of the store is, partition columns of the interval store included
    age_columns: list[str]
    mapping: DataFrame  # cause_id, series_id, weight
    population: DataFrame  # by, series_id and the columns below: denominators by base age
    population_columns: list[str]
    weights: list[float]  # of the standard population, youngest ages as one
    age_specs: dict[int, tuple[list[int], list[int]]]  # age code: base ages of counts, base ages of denominators
    asr_code: int
    points: DataFrame  # by, series_id, age_id, measure (count, asr, fraction), point
    point_draw: DataFrame  # the point estimates in the form of one draw
    fractions: dict[str, tuple[list, list]] = field(default_factory=dict)  # series: causes above, causes below
    normalise: Callable[[DataFrame], DataFrame] = lambda store: store  # from the columns of the store to ``by``


def joint_cells(store: DataFrame, offset: int = 10) -> DataFrame:
    """The store of ``joint.run_joint`` with one place column: population groups follow the provinces by ``offset``."""
    place = F.coalesce(F.col("Death_Prov"), F.col("Popgroup") + offset).cast("int")
    ages = [c for c in store.columns if c.startswith("age_")]
    return store.select("draw_id", F.col("scope").alias("storage_scope"), F.col("Sex").alias("sex_code"), place.alias("geography_code"), F.col("DeathYear").alias("year"), "cause_id", *ages)


#: What a cell of ``joint_cells`` is.
JOINT_BY = ["storage_scope", "sex_code", "geography_code", "year"]


def asr_errors(i: IntervalInputs, tolerance: float = ASR_TOLERANCE) -> DataFrame:
    """Published standardised rates that the calculation of the draws does not reproduce from the point estimates.

    A rate that only one side has is an error too.
    """
    keys = [*i.by, "series_id"]
    mapped = map_measures(i.point_draw, i.mapping, i.by, "cause_id", "series_id", i.age_columns)
    found = mapped.join(i.population, keys, "left").select(*keys, asr_wide(i.age_columns, i.population_columns, i.weights).alias("calculated"))
    known = i.points.filter("measure = 'asr'").select(*keys, F.col("point").alias("published"))
    both = found.filter(finite("calculated")).join(known.filter(finite("published")), keys, "full")
    error = F.abs(F.col("calculated") - F.col("published")) / F.greatest(F.lit(1.0), F.abs(F.col("published")))
    return both.withColumn("relative_error", error).filter(F.col("relative_error").isNull() | (F.col("relative_error") > tolerance))


def intervals(store: DataFrame, i: IntervalInputs, total: int) -> DataFrame:
    """Limits of counts, standardised rates and fractions: by, series_id, age_id, measure and the summary."""
    cube = summarise.interval_cube(
        store, i.mapping, i.by, i.age_columns, {c: n for c, (n, _) in i.age_specs.items()}, i.population, i.population_columns, i.weights, i.asr_code, total
    )
    cube = cube.withColumn("measure", F.when(F.col("age_id") == i.asr_code, "asr").otherwise("count"))
    if i.fractions:
        counted = store.select("draw_id", *i.by, "cause_id", sum((F.col(c) for c in i.age_columns), F.lit(0.0)).alias("deaths"))
        above, below = ({s: f[k] for s, f in i.fractions.items()} for k in (0, 1))
        f = summarise.fraction_intervals(counted, i.by, "cause_id", "deaths", above, below)
        cube = cube.unionByName(f.withColumns({"age_id": F.lit(ALL_AGES), "measure": F.lit("fraction")}))
    return cube


def with_denominators(cube: DataFrame, i: IntervalInputs) -> DataFrame:
    """Crude rates of counts: limits over the denominator of the age specification, which draws do not change."""
    ages = F.array(
        *[F.struct(F.lit(c).alias("age_id"), sum((F.col(i.population_columns[a]) for a in d), F.lit(0.0)).alias("population")) for c, (_, d) in i.age_specs.items()]
    )
    keys = [*i.by, "series_id"]
    p = i.population.select(*keys, F.explode(ages).alias("_a")).select(*keys, "_a.*", F.lit("count").alias("measure"))
    out = cube.join(p, [*keys, "age_id", "measure"], "left")
    return out.withColumns({f"rate_{c}": safe_ratio(c, "population", None, 1e5) for c in ("point", "lower", "upper")})


def align(cube: DataFrame, points: DataFrame, keys) -> DataFrame:
    """Points beside their limits, with ``alignment``: aligned, point_only or draws_only; a zero point needs no draws."""
    p = points.withColumn("_has_point", F.lit(True))
    out = cube.withColumn("_has_draws", F.lit(True)).join(p, list(keys), "full")
    zero = F.col("_has_draws").isNull() & (F.col("point") == 0)
    limit = {c: F.when(zero, F.lit(0.0)).otherwise(F.col(c)) for c in ("lower", "upper")}
    status = F.when(F.col("_has_point").isNull(), "draws_only").when(F.col("_has_draws").isNull() & ~zero, "point_only").otherwise("aligned")
    return out.withColumns({**limit, "alignment": status}).drop("_has_point", "_has_draws")


def publish_intervals(
    spark: SparkSession, draws: str, out: str, i: IntervalInputs, total: int, policy=validate.Policy.RAISE, partitions=tuple(stores.INTERVAL_PARTITIONS)
) -> DataFrame:
    """Write the interval store of the draw store at ``draws`` to ``out``, and return it."""
    store = spark.read.parquet(draws)
    keys = [*i.by, "series_id", "age_id", "measure"]
    problems = {"draw ids": stores.draw_id_differences(store, total), "standardised rates": asr_errors(i)}
    for name, found in problems.items():
        if (first := found.first()) is not None:
            raise AssertionError(f"{name}: {first.asDict()}")
    cube = materialise(align(intervals(i.normalise(store), i, total), i.points, keys), "intervals")
    unmatched = cube.filter("alignment <> 'aligned'").agg(F.count("*").alias("failures"))
    # the mean of equal draws may differ from them in the last digit
    order = cube.filter("lower > median OR median > upper OR abs(mean - greatest(min, least(mean, max))) > 1e-9 * greatest(1, abs(mean))").agg(F.count("*").alias("failures"))
    checks = validate.report(
        *[x.select(F.lit(n).alias("check"), "failures", F.lit(0.0).alias("worst"), (F.col("failures") == 0).alias("ok")) for n, x in (("points and draws align", unmatched), ("limits in order", order))]
    )
    validate.enforce(checks, policy)
    stores.write_intervals(with_denominators(cube, i), out, list(partitions))
    return spark.read.parquet(out)
