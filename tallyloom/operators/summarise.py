"""From draws to intervals.

Draws of one cell are never gathered into an array. Limits are order statistics: a cell's draws are numbered in order of
value by a window, which streams and spills, and an aggregate on the same key picks the numbers it needs; both
use one exchange, and any number of draws will do. What is shuffled before that is packed, with a column for
each draw of a block, so that the key of a cell travels once for ``SLOTS`` draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.columns import finite, safe_ratio
from tallyloom.operators.rates import asr_wide, comparison_series
from tallyloom.session import small_table

#: Draws that share one row of a packed table.
SLOTS = 32
#: The quantiles of a summary.
LIMITS = {"median": 0.5, "lower": 0.025, "upper": 0.975}


def pack_draws(rows: DataFrame, keys, value: str, slots: int = SLOTS) -> DataFrame:
    """(keys, draw_pack, d0 ... ): sums of ``value`` with a column for each draw of a pack; draw ids count from 1."""
    at = F.col("draw_id") - 1
    slot = F.pmod(at, F.lit(slots))
    sums = [F.sum(F.when(slot == k, F.col(value))).alias(f"d{k}") for k in range(slots)]
    return rows.groupBy(*keys, F.floor(at / slots).cast("int").alias("draw_pack")).agg(*sums)


def unpack_draws(packed: DataFrame, keys, value: str) -> DataFrame:
    """(keys, value): one row per draw of a packed table, without the order of draws."""
    slots = [F.col(c) for c in packed.columns if c not in keys and c != "draw_pack"]
    return packed.select(*keys, F.explode(F.array(*slots)).alias(value)).filter(F.col(value).isNotNull())


def _around(n: Column, p: float) -> tuple[Column, Column, Column]:
    """Numbers of the two order statistics around a type-8 quantile of n values, and the weight of the second."""
    h = n * F.lit(float(p)) + F.lit((p + 1.0) / 3.0)
    j = F.floor(h)
    hold = lambda i: F.least(F.greatest(i, F.lit(1)), n)
    return hold(j), hold(j + 1), h - j


def summarise_draws(draws: DataFrame, keys, value: str, expected: int | None = None) -> DataFrame:
    """Mean, median, sd, extremes and type-8 95 % limits over the draws of each key.

    With ``expected``, a key with another number of finite draws fails the job.
    """
    keys = list(keys)
    own = W.partitionBy(*keys)
    x = draws.filter(finite(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    x = x.withColumns({"_i": F.row_number().over(own.orderBy("_v")), "_n": F.count("*").over(own)})
    picks = []
    for name, p in LIMITS.items():
        lo, hi, _ = _around(F.col("_n"), p)
        picks += [F.max(F.when(F.col("_i") == lo, F.col("_v"))).alias(f"_{name}_lo"), F.max(F.when(F.col("_i") == hi, F.col("_v"))).alias(f"_{name}_hi")]
    g = x.groupBy(*keys).agg(
        F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.count("*").alias("n_draws"), *picks
    )
    if expected is not None:
        off = F.raise_error(F.lit("unexpected number of draws for a cell")).cast("bigint")
        g = g.withColumn("n_draws", F.when(F.col("n_draws") != expected, off).otherwise(F.col("n_draws")))
    limit = {}
    for name, p in LIMITS.items():
        lo, hi, weight = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), _around(F.col("n_draws"), p)[2]
        limit[name] = F.when(lo == hi, lo).otherwise(lo * (1.0 - weight) + hi * weight).alias(name)
    return g.select(*keys, "mean", limit["median"], "sd", "min", "max", limit["lower"], limit["upper"], "n_draws")


def enrich(summary: DataFrame, point: DataFrame | None = None, keys=(), point_value: str = "point") -> DataFrame:
    """Coefficient of variation, width, relative width and Monte-Carlo error of the mean."""
    out = summary
    if point is not None:
        out = out.join(point.select(*keys, F.col(point_value).alias("point")), list(keys), "left")
    base = F.col("point") if point is not None else F.col("mean")
    width = F.col("upper") - F.col("lower")
    return out.withColumns(
        {
            "cv": F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")),
            "interval_width": width,
            "relative_interval_width": F.when(base > 0, width / base),
            "monte_carlo_se_mean": F.col("sd") / F.sqrt("n_draws"),
        }
    )


def convergence(draws: DataFrame, keys, value: str, checkpoints: list[int], total: int) -> DataFrame:
    """Limits after the first n draws for several n, against all draws: a draw goes to every checkpoint that has it."""
    keys = list(keys)
    points = F.array(*[F.lit(p) for p in sorted({max(1, c) for c in [*checkpoints, total] if c <= total})])
    x = draws.withColumn("_at", F.explode(F.filter(points, lambda p: p >= F.col("draw_id")))).drop("n_draws")
    s = summarise_draws(x, [*keys, "_at"], value).drop("n_draws").withColumnRenamed("_at", "n_draws")
    own = W.partitionBy(*keys)
    out = []
    for name in ("lower", "median", "upper"):
        last = F.max(F.when(F.col("n_draws") == total, F.col(name))).over(own)
        out += [F.col(name), (F.col(name) - last).alias(f"{name}_change_from_final")]
    return s.select(*keys, "n_draws", *out)


def co_movement(draws: DataFrame, keys, code: str, driver, value: str) -> DataFrame:
    """How each cause moves with a driver cause across draws, from one-pass moments."""
    keys = list(keys)
    d = draws.filter(F.col(code) == F.lit(driver)).select(*keys, "draw_id", F.col(value).alias("_d"))
    j = draws.filter(F.col(code) != F.lit(driver)).join(d, [*keys, "draw_id"])
    g = j.groupBy(*keys, code).agg(
        F.count_distinct("draw_id").alias("n_draws"), F.avg(value).alias("mean_cause"), F.stddev_samp(value).alias("sd_cause"),
        F.avg("_d").alias("mean_driver"), F.stddev_samp("_d").alias("sd_driver"),
        F.covar_samp(value, "_d").alias("covariance"),
        F.var_samp("_d").alias("_vd"),
    )
    live = (F.col("sd_cause") > 0) & (F.col("sd_driver") > 0)
    return g.withColumns(
        {
            "correlation": F.when(live, F.col("covariance") / (F.col("sd_cause") * F.col("sd_driver"))),
            "slope": F.when(F.col("sd_driver") > 0, F.col("covariance") / F.col("_vd")),
        }
    ).drop("_vd")


def incomplete_keys(draws: DataFrame, keys, expected: int) -> DataFrame:
    """Keys that do not occur exactly once in every draw."""
    g = draws.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct("draw_id").alias("draws"))
    return g.filter((F.col("rows") != expected) | (F.col("draws") != expected))


def intervals_with_rates(summary: DataFrame, population: DataFrame, keys, value: str = "population") -> DataFrame:
    """Crude-rate limits from count limits and a fixed denominator."""
    j = summary.join(population.select(*keys, F.col(value).alias("_p")), list(keys), "left")
    return j.withColumns({f"{c}_rate": safe_ratio(c, "_p", None, 1e5) for c in ("mean", "lower", "upper")}).drop("_p")


def interval_cube(
    wide_draws: DataFrame, mapping: DataFrame, by, age_columns: list[str], age_specs: dict[int, list[int]],
    population: DataFrame | None = None, population_columns: list[str] | None = None, weights: list[float] | None = None,
    asr_code: int | None = None, expected: int | None = None, slots: int = SLOTS,
) -> DataFrame:
    """Intervals for every series x age specification, age-standardised within each draw.

    ``wide_draws`` has one row per (draw, cell, cause) with a column per base age; ``mapping`` has cause_id, series_id, weight.
    A sum over ages and a standardised rate are linear in the causes, so each row gives all its values in one
    explode, and the first aggregate adds up causes and packs draws at once.
    """
    by = list(by)
    x = wide_draws.join(mapping.select("cause_id", "series_id", F.col("weight").cast("double").alias("_w")), "cause_id")
    if population is not None:
        x = x.join(population, [*by, "series_id"], "left")
    total = lambda ages: sum((F.col(age_columns[a]) for a in ages), F.lit(0.0))
    values = {int(code): total(ages) for code, ages in age_specs.items()}
    if asr_code is not None:
        values[int(asr_code)] = asr_wide(age_columns, population_columns, weights)
    specs = F.array(*[F.struct(F.lit(code).alias("age_id"), (v * F.col("_w")).alias("value")) for code, v in values.items()])
    long = x.select("draw_id", *by, "series_id", F.explode(specs).alias("_s")).select("draw_id", *by, "series_id", "_s.age_id", "_s.value")
    keys = [*by, "series_id", "age_id"]
    return summarise_draws(unpack_draws(pack_draws(long, keys, "value", slots), keys, "value"), keys, "value", expected)


def fraction_intervals(draws: DataFrame, by, code: str, value: str, numerators: dict, denominators: dict, expected: int | None = None) -> DataFrame:
    """Intervals of a fraction formed inside each draw; one aggregate adds up numerator and denominator."""
    rows = [(c, s, c in set(numerators[s]), c in set(denominators[s])) for s in numerators for c in sorted({*numerators[s], *denominators[s]})]
    kind = draws.schema[code].dataType.simpleString()
    members = small_table(draws.sparkSession, rows, f"{code} {kind}, series_id string, in_numerator boolean, in_denominator boolean")
    inside = comparison_series(draws, ["draw_id", *by], code, value, members)
    return summarise_draws(inside, [*by, "series_id"], "fraction", expected)
