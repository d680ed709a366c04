"""Monte-Carlo draws with ``draw_id`` as an ordinary key column.

There is no loop over draws: a component is drawn for every (draw, key) at once
and joined on those keys, so a block of draws is one Spark job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions.columns import Z_LOWER, Z_UPPER, finite, or_zero, safe_ratio
from tallyloom.functions.gamma import gamma_mean_one, log_gamma_draw
from tallyloom.functions.hashing import normal
from tallyloom.session import small_table

EPSILON = 2.220446049250313e-16


def draw_ids(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("draw_id"))


def with_draws(df: DataFrame, first: int, last: int) -> DataFrame:
    """Repeat cells for a block of draws."""
    return df.withColumn("draw_id", F.explode(F.sequence(F.lit(first), F.lit(last))))


# ---------------------------------------------------------------- completeness


def log_dispersion(
    scalars: DataFrame, cells: DataFrame, keys, place: str, period: str, scalar: str, value: str, freeze
) -> DataFrame:
    """Spread of the completeness scalar over time within each place, on the log scale.

    Sex and age are collapsed first: per place and period the ratio of adjusted to
    unadjusted counts; then the weighted mean and standard deviation of its log.
    """
    keys = list(keys)
    mass = cells.groupBy(*keys, period).agg(F.sum(or_zero(value)).alias("_adj"))
    x = scalars.filter(F.col(period) <= freeze).join(mass, [*keys, period], "left")
    ok = finite(scalar) & (F.col(scalar) > 0) & finite("_adj") & (F.col("_adj") > 0)
    x = x.filter(ok).withColumn("_pre", F.col("_adj") / F.col(scalar))
    t = x.groupBy(place, period).agg(F.sum("_adj").alias("_a"), F.sum("_pre").alias("_p"), F.count("*").alias("_c"))
    t = t.withColumn("_r", F.col("_a") / F.col("_p")).withColumn("_l", F.log("_r"))
    w = W.partitionBy(place)  # one row per period
    t = t.withColumn("_m", F.sum(F.col("_p") * F.col("_l")).over(w) / F.sum("_p").over(w))
    spread = F.sum(F.col("_p") * F.pow(F.col("_l") - F.col("_m"), 2)) / F.sum("_p")
    g = t.groupBy(place).agg(
        F.count("*").alias("years"), F.sum("_c").alias("contributing_cells"), F.sum("_p").alias("pre_adjustment"),
        F.sum("_a").alias("adjusted"), F.max("_m").alias("mean_log"), F.sqrt(spread).alias("log_sd"),
        F.min("_r").alias("minimum"), F.percentile("_r", F.lit(0.5)).alias("median"), F.max("_r").alias("maximum"),
    )
    half = -0.5 * F.col("log_sd") * F.col("log_sd")
    return g.withColumns(
        {
            "aggregate_ratio": F.col("adjusted") / F.col("pre_adjustment"),
            "factor_lower": F.exp(half + Z_LOWER * F.col("log_sd")),
            "factor_median": F.exp(half),
            "factor_upper": F.exp(half + Z_UPPER * F.col("log_sd")),
        }
    )


def dispersion_exclusions(scalars: DataFrame, cells: DataFrame, keys, period: str, scalar: str, value: str, freeze, copied: Column | None = None) -> DataFrame:
    """Why scalar rows did not enter the dispersion: one count per reason, in one pass."""
    keys = list(keys)
    mass = cells.groupBy(*keys, period).agg(F.sum(or_zero(value)).alias("_adj"))
    x = scalars.join(mass, [*keys, period], "left")
    copied = F.lit(False) if copied is None else copied
    before = F.col(period) <= freeze
    bad_s = ~finite(scalar) | (F.col(scalar) <= 0)
    bad_w = ~finite("_adj") | (F.col("_adj") <= 0)
    reasons = {
        "after_freeze": ~before,
        "copied_row": before & copied,
        "invalid_scalar": before & ~copied & bad_s,
        "no_weight": before & ~copied & ~bad_s & bad_w,
    }
    row = x.agg(*[F.coalesce(F.count_if(c), F.lit(0)).alias(n) for n, c in reasons.items()])
    return row.unpivot([], list(reasons), "reason", "rows")


def lognormal_factors(parameters: DataFrame, place: str, log_sd: str, first: int, last: int, seed: int) -> DataFrame:
    """Mean-one lognormal factor for every (draw, place)."""
    x = with_draws(parameters.select(place, F.col(log_sd).alias("_s")), first, last)
    z = normal(seed, F.col("draw_id"), "completeness", F.col(place))
    return x.select("draw_id", place, z.alias("standard_normal"), F.exp(-0.5 * F.col("_s") * F.col("_s") + F.col("_s") * z).alias("factor"))


def apply_factors(cells: DataFrame, factors: DataFrame, keys, affected: Column, value: str) -> DataFrame:
    """Multiply the affected cells of each draw by their factor."""
    j = cells.join(factors.select(*keys, "factor"), list(keys), "left")
    f = F.when(affected, F.coalesce("factor", F.lit(1.0))).otherwise(1.0)
    return j.withColumn(value, F.col(value) * f).drop("factor")


# ---------------------------------------------------------------- Dirichlet and Gamma


def _key(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def dirichlet_draws(
    compositions: DataFrame, group, code: str, fraction: str, effective: str, first: int, last: int, seed: int,
    floor: float = EPSILON, component: str = "composition",
) -> DataFrame:
    """Dirichlet draw per group: Gammas at ``fraction * n``, normalised on the log scale.

    Groups are the *sampling* groups: cells that borrowed one donor composition share
    its draw by joining on that group.  Without sampling information the floored
    fraction is returned unchanged.
    """
    group = list(group)
    wg = W.partitionBy(*group)
    p = F.greatest(or_zero(fraction), F.lit(floor))
    x = compositions.select(*group, code, p.alias("_p"), or_zero(effective).alias("_n"))
    x = x.withColumn("_p", F.col("_p") / F.sum("_p").over(wg))
    x = with_draws(x, first, last)
    shape = F.greatest(F.col("_p") * F.col("_n"), F.lit(floor))
    key = _key(seed, F.col("draw_id"), component, *[F.col(g) for g in group], F.col(code))
    x = x.withColumn("_lg", F.when(F.col("_n") > 0, log_gamma_draw(key, shape)).otherwise(F.log("_p")))
    wd = W.partitionBy("draw_id", *group)
    x = x.withColumn("_e", F.exp(F.col("_lg") - F.max("_lg").over(wd)))
    return x.select("draw_id", *group, code, (F.col("_e") / F.sum("_e").over(wd)).alias("draw_fraction"))


def subset_gamma_shape(n: int) -> float:
    """Gamma shape whose Dirichlet share variance equals that of a random non-empty subset of n."""
    if n < 2:
        raise ValueError("at least two targets")
    expected = sum(math.comb(n, k) / k for k in range(1, n + 1)) / (2**n - 1)
    variance = expected / n - 1.0 / n**2
    return ((n - 1) / (n**2 * variance) - 1.0) / n


def rule_multipliers(spark: SparkSession, rules, first: int, last: int, seed: int) -> DataFrame:
    """Positive mean-one target weights per draw and rule, packed for the rule fold.

    One row per draw: ``multipliers: map<rule_id, array<double>>``.  Rules with one
    target need no weights.
    """
    rows = [
        (r.rule_id, i, int(t), float(subset_gamma_shape(len(r.targets))))
        for r in rules if len(r.targets) > 1 for i, t in enumerate(r.targets)
    ]
    slots = small_table(spark, rows, "rule_id string, slot int, target int, shape double")
    x = with_draws(slots, first, last)
    g = gamma_mean_one(_key(seed, F.col("draw_id"), "targets", F.col("rule_id"), F.col("target")), F.col("shape"))
    x = x.withColumn("_g", g)
    per_rule = x.groupBy("draw_id", "rule_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "_g"))), lambda s: s["_g"]).alias("_a"), F.avg("_g").alias("_m")
    )
    scaled = per_rule.select("draw_id", "rule_id", F.transform("_a", lambda v: v / F.col("_m")).alias("_a"))
    return scaled.groupBy("draw_id").agg(F.map_from_entries(F.collect_list(F.struct("rule_id", "_a"))).alias("multipliers"))


def multiplier_audit(multipliers: DataFrame) -> DataFrame:
    """Spread of the stochastic target weights over draws and rules."""
    long = multipliers.select("draw_id", F.explode("multipliers").alias("rule_id", "_a")).select(
        "draw_id", "rule_id", F.posexplode("_a").alias("slot", "m")
    )
    per = long.groupBy("draw_id", "rule_id").agg(
        F.min("m").alias("lo"), F.max("m").alias("hi"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("*").alias("targets")
    )
    return per.agg(
        F.count_distinct("rule_id").alias("stochastic_rules"), F.avg(safe_ratio("sd", "mean", None)).alias("mean_multiplier_cv"),
        F.min("lo").alias("min_multiplier"), F.max("hi").alias("max_multiplier"), F.avg("mean").alias("mean_multiplier"),
        F.sum("targets").alias("target_count"),
    )


# ---------------------------------------------------------------- coefficients


def draw_slopes(
    fits: DataFrame, keys, first: int, last: int, seed, shared=(), fallback: str = "main_effect_fallback", component: str = "trend"
) -> DataFrame:
    """Normal draw of each slope from its variance.

    Rows whose ``model_status`` is ``fallback`` hold one common coefficient per ``shared`` keys
    and get one random number for each; every other row has its own.
    """
    x = with_draws(fits, first, last)
    own = normal(seed, F.col("draw_id"), component, *[F.col(k) for k in keys])
    common = normal(seed, F.col("draw_id"), component, fallback, *[F.col(k) for k in shared])
    z = F.when(F.col("model_status") == fallback, common).otherwise(own) if shared else own
    sd = F.sqrt(F.greatest(or_zero("var_g"), F.lit(0.0)))
    return x.withColumn("g", F.when(F.col("var_g").isNotNull(), F.col("g") + sd * z).otherwise(F.col("g")))


def draw_intercepts(fits: DataFrame, keys, first: int, last: int, seed: int, log_scale: bool = False) -> DataFrame:
    """Normal draw of each intercept, back-transformed and floored at zero; fixed without a variance."""
    x = with_draws(fits, first, last)
    z = normal(seed, F.col("draw_id"), "intercept", *[F.col(k) for k in keys])
    linear = F.col("linear_intercept") + F.sqrt(F.greatest(or_zero("intercept_variance"), F.lit(0.0))) * z
    drawn = F.exp(linear) if log_scale else linear
    value = F.when(F.col("intercept_variance").isNotNull() & F.col("linear_intercept").isNotNull(), drawn).otherwise(F.col("intercept"))
    return x.withColumn("intercept", F.greatest(F.lit(0.0), value))


def draw_pair(a: Column, b: Column, vaa: Column, vab: Column, vbb: Column, *key) -> tuple[Column, Column]:
    """Bivariate normal draw in closed form (Cholesky with negative residue truncated)."""
    z1, z2 = normal(*key, "1"), normal(*key, "2")
    l11 = F.sqrt(F.greatest(vaa, F.lit(0.0)))
    l21 = F.coalesce(F.try_divide(vab, l11), F.lit(0.0))
    l22 = F.sqrt(F.greatest(vbb - l21 * l21, F.lit(0.0)))
    return a + l11 * z1, b + l21 * z1 + l22 * z2


def covariance_root(covariance: Column, sweeps: int = 10) -> Column:
    """Root of a flattened covariance, flattened by rows; negative eigenvalues are truncated.

    Cyclic Jacobi rotations as one fold over the pairs of coordinates: each turns two rows and columns so that their
    common entry vanishes.  Convergence is quadratic, so ten sweeps suffice for the small matrices of a model.
    """
    k = F.sqrt(F.size(covariance).cast("double")).cast("int")
    cells = F.sequence(F.lit(0), k * k - 1)

    def at(m, i, j):
        return F.get(m, (i * k + j).cast("int"))

    def row(n):
        return F.floor(n / k).cast("int")

    def turned(m, p, q, c, s, by_row: bool):
        """Coordinates p and q of every column (or row) replaced by their rotation."""

        def entry(v, n):
            i, j = row(n), n % k
            mine, other = (i, j) if by_row else (j, i)
            a = at(m, p, other) if by_row else at(m, other, p)
            b = at(m, q, other) if by_row else at(m, other, q)
            return F.when(mine == p, c * a - s * b).when(mine == q, s * a + c * b).otherwise(v)

        return F.transform(m, entry)

    def rotate(state, pair):
        p, q, m = pair["p"], pair["q"], state["m"]
        theta = (at(m, q, q) - at(m, p, p)) / (2.0 * at(m, p, q))
        t = F.when(theta < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) / (F.abs(theta) + F.sqrt(theta * theta + 1.0))
        c = F.lit(1.0) / F.sqrt(t * t + 1.0)
        out = F.struct(
            turned(turned(m, p, q, c, t * c, True), p, q, c, t * c, False).alias("m"), turned(state["v"], p, q, c, t * c, False).alias("v")
        )
        return F.when(F.abs(at(m, p, q)) > 1e-300, out).otherwise(state)

    symmetric = F.transform(cells, lambda n: (F.get(covariance, n) + at(covariance, n % k, row(n))) / 2.0)
    unit = F.transform(cells, lambda n: (row(n) == n % k).cast("double"))
    above = F.filter(cells, lambda n: row(n) < n % k)
    pairs = F.transform(above, lambda n: F.struct(row(n).alias("p"), (n % k).cast("int").alias("q")))
    order = F.flatten(F.array_repeat(pairs, sweeps))
    return F.aggregate(
        order, F.struct(symmetric.alias("m"), unit.alias("v")), rotate,
        lambda s: F.transform(s["v"], lambda v, n: v * F.sqrt(F.greatest(at(s["m"], n % k, n % k), F.lit(0.0)))),
    )


def mvn_draws(fits: DataFrame, keys, mean: str, covariance: str, first: int, last: int, seed: int) -> DataFrame:
    """k-variate normal draws: each fit is factored once, each draw multiplies its root by hash normals."""
    x = with_draws(fits.withColumn("_root", covariance_root(F.col(covariance))), first, last)
    k = F.size(mean)
    z = F.transform(F.sequence(F.lit(1), k), lambda j: normal(seed, F.col("draw_id"), "mvn", *[F.col(c) for c in keys], j))
    x = x.withColumn("_z", z)
    product = F.transform(
        F.col(mean),
        lambda m, i: m + F.aggregate(F.zip_with(F.slice("_root", i * k + 1, k), F.col("_z"), lambda r, s: r * s), F.lit(0.0), lambda a, b: a + b),
    )
    return x.withColumn("coefficients", product).drop("_root", "_z")
