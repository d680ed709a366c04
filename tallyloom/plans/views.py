"""Report-side views: slices of the cube, model comparison and composition summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions.columns import finite, or_zero, safe_ratio
from tallyloom.operators.grid import complete_cells, spread_join
from tallyloom.operators.validate import table_error

# ---------------------------------------------------------------- slices


def slice_cube(cube: DataFrame, filters: dict, measure: str, years: tuple[str, int, int] | None = None, keep=()) -> DataFrame:
    """Filtered slice with one measure.

    Filters are plain equality or IN predicates on scan columns, so Spark pushes them to
    the files and prunes partitions; only the kept columns and the measure are read.
    """
    out = cube
    for name, wanted in filters.items():
        if wanted is None:
            continue
        vals = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        out = out.filter(F.col(name) == F.lit(vals[0]) if len(vals) == 1 else F.col(name).isin(vals))
    if years:
        name, lo, hi = years
        out = out.filter(F.col(name).between(lo, hi))
    return out.select(*keep, F.col(measure).alias("estimate"))


def draw_slice(draws: DataFrame, filters: dict, keys, value: str, expected: int) -> DataFrame:
    """Slice of the draw grid; a cell without every draw fails the job."""
    x = slice_cube(draws, filters, value, keep=[*keys, "draw_id"])
    w = x.groupBy(*keys).agg(F.count_distinct("draw_id").alias("_n"))
    ok = F.when(F.col("_n") != expected, F.raise_error(F.lit("a cell lacks draws")).cast("bigint")).otherwise(F.col("_n"))
    return x.join(w.select(*keys, ok.alias("n_draws")), list(keys))


def interval_slice(store: DataFrame, filters: dict, measure: str, keep=()) -> DataFrame:
    """Point and limits for deaths, crude rate (limits over population) or ASR."""
    if measure not in ("deaths", "crude_rate", "asr"):
        raise ValueError(f"unknown measure {measure}")
    out = store
    for name, vals in filters.items():
        out = out.filter(F.col(name).isin(list(vals)))
    cols = []
    for part in ("point", "lower", "upper"):
        if measure == "deaths":
            cols.append(F.col(f"deaths_{part}").alias(part))
        elif measure == "crude_rate":
            cols.append(safe_ratio(f"deaths_{part}", "population", None, 1e5).alias(part))
        else:
            cols.append(F.col(f"asr_{part}").alias(part))
    return out.select(*keep, *cols)


def attach_intervals(points: DataFrame, intervals: DataFrame, keys, structural_zero: Column, point: str) -> DataFrame:
    """Left join of limits to points; declared structural zeros get zero limits, others stay NULL."""
    j = points.join(intervals.select(*keys, "lower", "upper", F.col("n_draws")), list(keys), "left")
    zero = structural_zero & (F.col(point) == 0)
    fill = lambda c: F.when(F.col(c).isNull() & zero, 0.0).otherwise(F.col(c)).alias(c)
    others = [c for c in j.columns if c not in ("lower", "upper")]
    return j.select(*others, fill("lower"), fill("upper"))


def point_draw_alignment(points: DataFrame, summary: DataFrame, keys, point: str, mean: str) -> DataFrame:
    """Error between points and draw means on the union of keys."""
    return table_error(points, summary.select(*keys, F.col(mean).alias(point)), keys, point)


def profile_slice(cells: DataFrame, years, groups: dict, cause: str, age: str, year: str, value: str, ages) -> DataFrame:
    """Age profile of broad causes for chosen years on a complete grid."""
    label = F.lit(None).cast("string")
    for g, cs in groups.items():
        label = F.when(F.col(cause).isin(list(cs)), F.lit(g)).otherwise(label)
    x = cells.filter(F.col(year).isin(list(years))).withColumn("broad", label).filter(F.col("broad").isNotNull())
    return complete_cells(x, ["broad", year, age], [value], {"broad": list(groups), year: list(years), age: list(ages)})


# ---------------------------------------------------------------- comparison of models


def rates_long(rates: DataFrame, keys, measures) -> DataFrame:
    """One row per finite measure."""
    return rates.unpivot([*keys], list(measures), "measure", "estimate").filter(finite("estimate"))


def model_differences(rows: DataFrame, model: str, keys, first: str, second: str, value: str = "estimate") -> DataFrame:
    """Two models side by side with coverage and difference metrics.

    Both models are picked in one aggregate over the long table; no self join.
    """
    g = rows.filter(F.col(model).isin(first, second)).groupBy(*keys).agg(
        F.max(F.when(F.col(model) == first, F.col(value))).alias("estimate_a"),
        F.max(F.when(F.col(model) == second, F.col(value))).alias("estimate_b"),
    )
    a, b = F.col("estimate_a"), F.col("estimate_b")
    coverage = (
        F.when(finite(a) & finite(b), "matched").when(finite(a), f"{first}_only").when(finite(b), f"{second}_only").otherwise("missing")
    )
    return g.withColumns(
        {
            "coverage": coverage,
            "absolute_difference": b - a,
            "relative_difference": safe_ratio(b - a, F.abs(a), None),
            "ratio": safe_ratio(b, a, None),
            "symmetric_percent_difference": safe_ratio(2.0 * (b - a), F.abs(a) + F.abs(b), None, 100.0),
        }
    )


def percent_to_proportion(df: DataFrame, by, value: str, threshold: float = 1.5) -> DataFrame:
    """Series stored as percentages are divided by 100: judged by the 99th percentile of |x|.

    The percentile lies between two neighbours in order. Whether it exceeds the threshold
    follows from how many values do, and where the threshold falls between the two, from
    the values next to it, so no group's values are held together.
    """
    x = F.abs(F.col(value))
    high = x > threshold
    g = df.groupBy(*by).agg(
        F.count(value).alias("_n"), F.count_if(~high).alias("_c"), F.max(F.when(~high, x)).alias("_lo"), F.min(F.when(high, x)).alias("_hi")
    )
    at = (F.col("_n") - 1) * 0.99
    between = F.col("_lo") + (at - F.floor(at)) * (F.col("_hi") - F.col("_lo"))
    above = F.when(F.floor(at) >= F.col("_c"), True).when(F.ceil(at) < F.col("_c"), False).otherwise(between > threshold)
    scale = g.select(*by, F.when(above, 100.0).otherwise(1.0).alias("_s"))
    return spread_join(df, scale, list(by)).withColumn(value, F.col(value) / F.col("_s")).drop("_s")


def harmonise_external(df: DataFrame, maps: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Map external labels to canonical codes; rows with an unmapped label are returned separately.

    ``maps``: column -> (column, code) table.
    """
    out = df
    missing = F.lit(False)
    for column, table in maps.items():
        code = [c for c in table.columns if c != column][0]
        out = out.join(table, column, "left")
        missing = missing | F.col(code).isNull()
    flagged = out.withColumn("_m", missing)
    return flagged.filter("not _m").drop("_m"), flagged.filter("_m").drop("_m")


def composition_comparison(
    observed: DataFrame, observed_value: str, model: DataFrame, model_value: str, envelope: DataFrame, cell, code: str, by, group: str
) -> DataFrame:
    """Observed and modelled composition of broad groups, weighted by the envelope."""
    j = (
        observed.select(*cell, code, F.col(observed_value).alias("_o"))
        .join(model.select(*cell, code, group, F.col(model_value).alias("_m")), [*cell, code])
        .join(envelope, list(cell))
    )
    g = j.groupBy(*by, group).agg(F.sum(F.col("_o") * F.col("envelope")).alias("_o"), F.sum(F.col("_m") * F.col("envelope")).alias("_m"))
    w = W.partitionBy(*by)
    return g.select(
        *by, group, safe_ratio("_o", F.sum("_o").over(w), None).alias("survey_share"), safe_ratio("_m", F.sum("_m").over(w), None).alias("model_share")
    )


def source_table(counts: DataFrame, code: str, source: str, sources, value: str) -> DataFrame:
    """Counts and percentages by code with one column pair per source."""
    s = counts.withColumn("_p", 100.0 * safe_ratio(value, F.sum(or_zero(value)).over(W.partitionBy(source)), None))
    wide = s.groupBy(code).pivot(source, list(sources)).agg(F.sum(value).alias("n"), F.sum("_p").alias("p"))
    cols = []
    for x in sources:
        cols += [F.col(f"`{x}_n`").alias(f"n_{x}"), F.col(f"`{x}_p`").alias(f"percent_{x}")]
    return wide.select(code, *cols)


# ---------------------------------------------------------------- report checks


def report_checks(cube: DataFrame, comparisons: DataFrame | None = None, national: int = 10, person: int = 3, tolerance: float = 1e-6) -> DataFrame:
    """Named checks of a published cube: ``check, status, failures``.

    ``cube``: geography, sex, year, series, age, deaths, population, crude_rate and
    optionally lower/upper.  Additivity is tested with signed sums in one aggregate
    per check.
    """
    def row(name, failures: DataFrame):
        f = failures.agg(F.count("*").alias("failures"))
        return f.select(F.lit(name).alias("check"), F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"), "failures")

    keys = ["sex", "year", "series", "age"]
    signed = F.when(F.col("geography") == national, -F.col("deaths")).otherwise(F.col("deaths"))
    geo = cube.groupBy(*keys).agg(F.sum(signed).alias("e"), F.max(F.abs("deaths")).alias("m")).filter(F.abs("e") > tolerance * F.greatest(F.lit(1.0), F.col("m")))
    keys = ["geography", "year", "series", "age"]
    signed = F.when(F.col("sex") == person, -F.col("deaths")).otherwise(F.col("deaths"))
    sex = cube.groupBy(*keys).agg(F.sum(signed).alias("e"), F.max(F.abs("deaths")).alias("m")).filter(F.abs("e") > tolerance * F.greatest(F.lit(1.0), F.col("m")))
    rate = F.abs(F.col("crude_rate") - safe_ratio("deaths", "population", None, 1e5))
    rates = cube.filter(rate > tolerance * F.greatest(F.lit(1.0), F.abs("crude_rate")))
    checks = [row("national_is_sum", geo), row("person_is_sum", sex), row("rate_arithmetic", rates)]
    if "lower" in cube.columns:
        checks.append(row("interval_order", cube.filter((F.col("lower") > F.col("upper")) | (F.col("lower") > F.col("deaths") + tolerance) | (F.col("upper") < F.col("deaths") - tolerance))))
    if comparisons is not None:
        checks.append(row("fraction_in_unit_interval", comparisons.filter(F.col("fraction").isNotNull() & ((F.col("fraction") < 0) | (F.col("fraction") > 1)))))
        arithmetic = F.abs(F.col("fraction") - safe_ratio("count", "denominator", None)) > tolerance
        checks.append(row("fraction_arithmetic", comparisons.filter(arithmetic)))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def additive_ages(cells: DataFrame, by, age: str, value: str, groups: dict[int, list[int]], tolerance: float = 1e-6) -> DataFrame:
    """Aggregate ages that do not equal the sum of their members."""
    out = None
    for code, members in groups.items():
        signed = F.when(F.col(age) == code, -F.col(value)).when(F.col(age).isin(members), F.col(value)).otherwise(0.0)
        e = cells.groupBy(*by).agg(F.sum(signed).alias("error"), F.sum(F.when(F.col(age) == code, F.abs(value))).alias("_m"))
        e = e.filter(F.abs("error") > tolerance * F.greatest(F.lit(1.0), F.col("_m"))).withColumn(age, F.lit(code)).drop("_m")
        out = e if out is None else out.unionByName(e)
    return out
