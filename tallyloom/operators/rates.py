"""Rates, standardisation, years of life lost and the published cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions.ages import AGGREGATE_AGES
from tallyloom.functions.columns import add_all, finite, or_zero, safe_ratio
from tallyloom.operators.aggregate import margins

YLL_MEASURES = ["YLL00", "YLL03", "YLL015"]


def discounted_years(life: str | Column) -> dict[str, Column]:
    """Remaining years undiscounted and at 3 % and 1.5 % continuous discounting."""
    x = F.col(life) if isinstance(life, str) else life
    disc = lambda r: F.when(x >= 0, (1.0 - F.exp(-r * x)) / r)
    return {"L00": x.cast("double"), "L03": disc(0.03), "L015": disc(0.015)}


def yll(cells: DataFrame, schedule: DataFrame, keys, value: str) -> DataFrame:
    """Deaths times remaining years; a cell without a schedule entry fails the job."""
    j = cells.join(schedule.select(*keys, "L00", "L03", "L015"), list(keys), "left")
    fail = F.raise_error(F.lit("no life-table entry for a death cell")).cast("double")
    years = {
        m: F.coalesce(F.col(l), fail) * F.col(value) for m, l in zip(YLL_MEASURES, ("L00", "L03", "L015"))
    }
    return j.withColumns(years).drop("L00", "L03", "L015")


def append_total(df: DataFrame, by, dim: str, code, measures, base=None) -> DataFrame:
    """Rows plus their total over one dimension."""
    src = df if base is None else df.filter(F.col(dim).isin(list(base)))
    return margins(src, [*by, dim], {dim: code}, measures)


def denominators(population: DataFrame, place: str, group: str, sex: str, year: str, age: str, value: str, ages: list, offset: int = 10, shift: int = 1) -> DataFrame:
    """Database denominators: ages shifted, a structural zero for the age without one, both groupings.

    Each population row is emitted once per grouping, so both come out of one aggregate.
    """
    x = population.filter(F.col(age).isin(ages)).select(
        F.explode(F.array(F.col(place).cast("int"), (F.col(group) + offset).cast("int"))).alias("Grouping"),
        sex, year, (F.col(age) - shift).cast("int").alias("age"), or_zero(value).alias("Pop"),
    )
    cells = x.groupBy("Grouping", sex, year, "age").agg(F.sum("Pop").alias("Pop"))
    # the newborn row is derived from the first age present in each series
    first = cells.groupBy("Grouping", sex, year).agg(F.lit(0).alias("age"), F.lit(0.0).alias("Pop"))
    return cells.unionByName(first)


def _age_roles(age: str, groups: dict) -> list[Column]:
    """The age itself and every aggregate age, each flagged as numerator and denominator member."""
    own = F.struct(F.col(age).cast("int").alias("code"), F.lit(True).alias("n"), F.lit(True).alias("d"))
    return [own] + [
        F.struct(F.lit(code).alias("code"), F.col(age).isin(num).alias("n"), F.col(age).isin(den).alias("d"))
        for code, (num, den) in groups.items()
    ]


def age_groups(df: DataFrame, by, age: str, numerators, denominators_, groups: dict | None = None) -> DataFrame:
    """Base ages plus aggregate ages whose numerator and denominator may use different members.

    One explode and one aggregate: a row carries a flag for each role it plays.
    """
    picked = F.filter(F.array(*_age_roles(age, groups or AGGREGATE_AGES)), lambda r: r["n"] | r["d"])
    x = df.withColumn("_r", F.explode(picked))
    aggs = [F.coalesce(F.sum(F.when(F.col("_r.n"), or_zero(c))), F.lit(0.0)).alias(c) for c in numerators]
    aggs += [F.coalesce(F.sum(F.when(F.col("_r.d"), or_zero(c))), F.lit(0.0)).alias(c) for c in denominators_]
    return x.groupBy(*by, F.col("_r.code").alias(age)).agg(*aggs)


def standard_age(age: str | Column, collapsed: int = 2) -> Column:
    """Standard-population cell of a database age: the youngest ages share cell 1."""
    a = F.col(age) if isinstance(age, str) else age
    return F.when(a <= collapsed, 1).otherwise(a - (collapsed - 1)).cast("int")


def standard_weights(df: DataFrame, age: str, percent: str) -> DataFrame:
    """Standard-population table: percent to fraction, unusable rows dropped."""
    return df.select(F.col(age).cast("int").alias("standard_age"), (F.col(percent).cast("double") / 100.0).alias("F")).filter(
        F.col("standard_age").isNotNull() & finite("F")
    )


def age_standardise(cells: DataFrame, by, age: str, deaths: str, population: str, weights: DataFrame, ages=range(0, 20), collapsed: int = 2, population_free: int = 0) -> DataFrame:
    """Directly standardised rate per 100,000 over the ages that have a rate.

    The collapsed youngest cell takes deaths of all its ages and population of the
    ages that have one.  Weights are renormalised over the usable ages.
    """
    base = cells.filter(F.col(age).isin(list(ages)))
    pop = F.when((F.col(age) > collapsed) | (F.col(age) != population_free), or_zero(population)).otherwise(0.0)
    r = base.groupBy(*by, standard_age(age, collapsed).alias("standard_age")).agg(
        F.sum(or_zero(deaths)).alias("_d"), F.sum(pop).alias("_p")
    )
    r = r.join(weights, "standard_age").withColumn("_rate", F.when(F.col("_p") > 0, F.col("_d") / F.col("_p")))
    usable = finite("_rate") & finite("F")
    num = F.sum(F.when(usable, F.col("_rate") * F.col("F")))
    den = F.sum(F.when(usable, F.col("F")))
    return r.groupBy(*by).agg(F.when(den > 0, 1e5 * num / den).alias("ASR"))


def age_standardise_over(cells: DataFrame, by, age: str, deaths: str, population: str, weights: DataFrame, ages=range(0, 20), collapsed: int = 2, population_free: int = 0, name: str = "ASR") -> DataFrame:
    """The same rate attached to every row of its series, without evaluating the cells twice.

    ``cells`` holds one row per (series, age); a series has at most one row per age code.
    """
    w = W.partitionBy(*by)
    base = F.col(age).isin(list(ages))
    young = base & (F.col(age) <= collapsed)
    d, p = or_zero(deaths), or_zero(population)
    x = cells.join(weights.withColumnRenamed("F", "_f"), F.when(base, standard_age(age, collapsed)) == F.col("standard_age"), "left").drop("standard_age")
    x = x.withColumns(
        {
            "_yd": F.sum(F.when(young, d)).over(w),
            "_yp": F.sum(F.when(young & (F.col(age) != population_free), p)).over(w),
            "_yf": F.max(F.when(young, F.col("_f"))).over(w),
        }
    )
    old = base & (F.col(age) > collapsed) & (p > 0) & finite("_f")
    num = F.coalesce(F.sum(F.when(old, F.col("_f") * F.try_divide(d, p))).over(w), F.lit(0.0))
    den = F.coalesce(F.sum(F.when(old, F.col("_f"))).over(w), F.lit(0.0))
    use = (F.col("_yp") > 0) & finite("_yf")
    num = num + F.when(use, F.col("_yf") * F.try_divide(F.col("_yd"), F.col("_yp"))).otherwise(0.0)
    den = den + F.when(use, F.col("_yf")).otherwise(0.0)
    x = x.withColumns({"_num": num, "_den": den})
    return x.withColumn(name, F.when(F.col("_den") > 0, 1e5 * F.try_divide(F.col("_num"), F.col("_den")))).drop("_f", "_yd", "_yp", "_yf", "_num", "_den")


def asr_wide(deaths: list[str], population: list[str], weights: list[float], collapsed: int = 2) -> Column:
    """The same rate from 20 death and 20 population columns of one row: no shuffle per draw."""
    u5 = (add_all([or_zero(c) for c in deaths[: collapsed + 1]]), add_all([or_zero(c) for c in population[1 : collapsed + 1]]))
    pairs = [u5, *[(or_zero(d), or_zero(p)) for d, p in zip(deaths[collapsed + 1 :], population[collapsed + 1 :])]]
    num = add_all([F.when(p > 0, w * F.try_divide(d, p)).otherwise(0.0) for (d, p), w in zip(pairs, weights)])
    den = add_all([F.when(p > 0, F.lit(w)).otherwise(0.0) for (_, p), w in zip(pairs, weights)])
    return F.when(den > 0, 1e5 * F.try_divide(num, den))


def crude_rate(deaths, population) -> Column:
    return safe_ratio(deaths, population, None, 1e5)


def series_rates(cells: DataFrame, by, cause: str, age: str, deaths: str, population: str, series: DataFrame, ages: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Rates of derived series: deaths add over causes, the denominator is carried once per age.

    ``series``: (cause, series_id); ``ages``: (age, age_id, in_numerator, in_denominator).
    The denominators of the causes in one source age must agree.
    """
    by = list(by)
    x = cells.join(series, cause).groupBy(*by, "series_id", age).agg(
        F.sum(or_zero(deaths)).alias("_d"), F.max(population).alias("_p"), F.min(population).alias("_q")
    )
    p = F.when(F.col("_p") - F.col("_q") > tolerance, F.raise_error(F.lit("denominators differ within an age")).cast("double")).otherwise(F.col("_p"))
    x = x.withColumn("_p", p).join(ages, age)
    g = x.groupBy(*by, "series_id", "age_id").agg(
        F.coalesce(F.sum(F.when(F.col("in_numerator"), F.col("_d"))), F.lit(0.0)).alias("deaths"),
        F.coalesce(F.sum(F.when(F.col("in_denominator"), F.col("_p"))), F.lit(0.0)).alias("population"),
    )
    return g.withColumn("crude_rate", crude_rate("deaths", "population"))


def comparison_series(cells: DataFrame, by, cause: str, deaths: str, members: DataFrame) -> DataFrame:
    """Counts and fractions of numerator over denominator code sets.

    ``members``: (cause, series_id, in_numerator, in_denominator).
    """
    j = cells.join(members, cause)
    g = j.groupBy(*by, "series_id").agg(
        F.coalesce(F.sum(F.when(F.col("in_numerator"), or_zero(deaths))), F.lit(0.0)).alias("count"),
        F.coalesce(F.sum(F.when(F.col("in_denominator"), or_zero(deaths))), F.lit(0.0)).alias("denominator"),
    )
    return g.withColumn("fraction", safe_ratio("count", "denominator", None))


def base_population_wide(cells: DataFrame, by, age: str, population: str, ages) -> DataFrame:
    """Base-age denominators as one row with a column per age."""
    wide = cells.groupBy(*by).pivot(age, list(ages)).agg(F.max(population))
    return wide.select(*by, *[F.coalesce(F.col(f"`{a}`"), F.lit(0.0)).alias(f"pop_{a}") for a in ages])


def final_cube(
    deaths: DataFrame, population: DataFrame, weights: DataFrame, place: str = "Death_Prov", group: str = "Popgroup",
    code: str = "nbdcode", year: str = "DeathYear", sex: str = "Sex", places=range(1, 10), national: int = 10,
    offset: int = 10, zero_code: int = 140, merge_code: int = 141, female_only=(42, 43), male_only=(46,),
) -> DataFrame:
    """Deaths and YLL with denominators on every grouping, sex and age code, with crude inputs and ASR.

    ``deaths``: place, group, code, year, sex, age (0-19), Deaths, YLL00, YLL03, YLL015.
    ``population``: the output of ``denominators``.
    """
    measures = ["Deaths", *YLL_MEASURES]
    x = deaths.filter(F.col(place).isin(list(places)))
    x = x.withColumn("Grouping", F.explode(F.array(F.col(place).cast("int"), (F.col(group) + offset).cast("int"))))
    # each cell also carries an all-zero entry for the structural code
    entries = F.array(
        F.struct(F.col(code).cast("int").alias("c"), *[or_zero(m).alias(m) for m in measures]),
        F.struct(F.lit(zero_code).alias("c"), *[F.lit(0.0).alias(m) for m in measures]),
    )
    keys = ["Grouping", sex, year, "age"]
    x = x.select(*keys, F.explode(entries).alias("_e")).select(*keys, F.col("_e.c").alias(code), *[f"_e.{m}" for m in measures])
    x = x.groupBy(*keys, code).agg(*[F.sum(m).alias(m) for m in measures])
    x = x.join(population.select(*keys, "Pop"), keys, "left")
    missing = F.col("Pop").isNull() & (F.col("Deaths") > 0)
    x = x.withColumn("Pop", F.when(missing, F.raise_error(F.lit("no denominator for a death cell")).cast("double")).otherwise(or_zero("Pop")))
    # aggregate ages, the national row, both sexes and the code merge leave in one
    # explode each and meet in a single aggregate
    roles = F.filter(F.array(*_age_roles("age", AGGREGATE_AGES)), lambda r: r["n"] | r["d"])
    is_place = F.col("Grouping").isin(list(places))
    where = F.when(is_place, F.array(F.col("Grouping"), F.lit(national))).otherwise(F.array(F.col("Grouping")))
    x = x.withColumn("_r", F.explode(roles)).withColumn("_g", F.explode(where)).withColumn("_s", F.explode(F.array(F.col(sex), F.lit(3))))
    wrong_sex = (F.col("_s") == 3) & (
        (F.col(code).isin(list(female_only)) & (F.col(sex) != 2)) | (F.col(code).isin(list(male_only)) & (F.col(sex) != 1))
    )
    pop = F.when(F.col("_r.d") & ~wrong_sex, F.col("Pop")).otherwise(0.0)
    folded = F.when(F.col(code) == merge_code, zero_code).otherwise(F.col(code)).cast("int")
    sums = [F.sum(F.when(F.col("_r.n"), F.col(m)).otherwise(0.0)).alias(m) for m in measures]
    # merged codes share a denominator: the larger one counts, not their sum
    largest = F.greatest(F.sum(F.when(F.col(code) != merge_code, pop).otherwise(0.0)), F.sum(F.when(F.col(code) == merge_code, pop).otherwise(0.0)))
    cube = x.groupBy(
        F.col("_g").alias("Grouping"), F.col("_s").alias(sex), year, F.col("_r.code").alias("age"), folded.alias(code)
    ).agg(*sums, largest.alias("Pop"))
    by = ["Grouping", sex, code, year]
    return age_standardise_over(cube, by, "age", "Deaths", "Pop", weights).withColumnRenamed("age", "Age")
