"""Grouped regressions and the reallocation of misclassified counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions.columns import finite, or_zero
from tallyloom.operators.grid import complete_codes
from tallyloom.session import materialise

# ---------------------------------------------------------------- least squares


def ols(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """Simple regression per group from one-pass moments, with the intercept's variance.

    NULL coefficients where there are fewer than two points or no spread in x;
    NULL variance without residual degrees of freedom.
    """
    ok = finite(x) & finite(y)
    xv, yv = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    g = df.groupBy(*by).agg(
        F.count(F.when(ok, F.lit(1))).alias("n"),
        F.avg(xv).alias("_mx"), F.avg(yv).alias("_my"),
        F.regr_sxx(yv, xv).alias("_sxx"), F.regr_sxy(yv, xv).alias("_sxy"), F.regr_syy(yv, xv).alias("_syy"),
        F.min(xv).alias("_lo"), F.max(xv).alias("_hi"),
        F.percentile(yv, F.lit(0.5)).alias("median_y"),
    )
    fit = (F.col("n") >= 2) & (F.col("_hi") > F.col("_lo"))
    slope = F.when(fit, F.try_divide(F.col("_sxy"), F.col("_sxx")))
    g = g.withColumn("slope", slope).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    rss = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    s2 = F.when(F.col("n") > 2, rss / (F.col("n") - 2))
    var = s2 * (F.try_divide(F.lit(1.0), F.col("n").cast("double")) + F.try_divide(F.col("_mx") * F.col("_mx"), F.col("_sxx")))
    return g.withColumn("intercept_variance", var).select(*by, "n", "intercept", "slope", "intercept_variance", "median_y")


def base_year(df: DataFrame, by, prevalence: str, year: str, latest: float) -> DataFrame:
    """Year at which prevalence extrapolates to zero: the smallest group intercept, capped at ``latest``."""
    fit = ols(df, by, prevalence, year)
    candidate = F.when(F.col("intercept") < latest, F.col("intercept")).otherwise(latest)
    return fit.agg(F.coalesce(F.min(candidate), F.lit(latest)).alias("base_year"))


def zero_intercepts(df: DataFrame, by, x: str, rate: str, log_scale: bool = False) -> DataFrame:
    """Rate at zero exposure per group; the median rate where no line can be fitted, never negative.

    With ``log_scale`` the regression is on log rates (positive rates only) and the
    result is back-transformed; the variance stays on the fitting scale.
    """
    if log_scale:
        y = F.when(finite(rate) & (F.col(rate) > 0), F.log(rate))
        fit = ols(df.withColumn("_y", y), by, x, "_y")
        value, spare = F.exp("intercept"), F.exp("median_y")
        # the fallback is the median of the rates, and a median commutes with exp only on odd counts
        med = df.filter(finite(rate) & (F.col(rate) > 0) & finite(x)).groupBy(*by).agg(F.percentile(rate, F.lit(0.5)).alias("_med"))
        fit = fit.join(med, list(by), "left")
        spare = F.col("_med")
    else:
        fit = ols(df, by, x, rate)
        value, spare = F.col("intercept"), F.col("median_y")
    status = F.when(F.col("intercept").isNotNull(), "log_linear_model" if log_scale else "linear_model").otherwise("fixed_fallback")
    point = F.greatest(F.lit(0.0), F.coalesce(value, spare, F.lit(0.0)))
    return fit.select(*by, "n", point.alias("intercept"), F.col("intercept").alias("linear_intercept"), "intercept_variance", status.alias("status"))


# ---------------------------------------------------------------- Poisson rates


def poisson_trend(
    df: DataFrame, by, x: str, count: str, exposure: str, iterations: int = 25, max_points: int = 10_000,
    min_points: int = 2,
) -> DataFrame:
    """log(rate) = constant + g * x per group, Poisson with offset log(exposure).

    A model that is saturated in its grouping factors equals independent
    two-parameter fits, one per group.  Points are summed per distinct x first, so a
    group holds one element per time point; Newton steps run on that short array with
    a closed-form 2x2 solve.  An all-zero group has no slope.
    """
    by = list(by)
    pts = (
        df.filter(finite(x) & (or_zero(exposure) > 0))
        .groupBy(*by, x).agg(F.sum(or_zero(count)).alias("_y"), F.sum(or_zero(exposure)).alias("_n"))
        .groupBy(*by)
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col("_y").alias("y"), F.log("_n").alias("o")))).alias("_p"),
            F.sum("_y").alias("_sy"), F.sum("_n").alias("_sn"), F.count("*").alias("points"),
        )
    )
    guard = F.when(F.col("points") > max_points, F.raise_error(F.lit("too many distinct time points")).cast("double"))
    start = F.struct(F.coalesce(guard, F.log(F.col("_sy") / F.col("_sn"))).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("step"))
    zero5 = F.struct(*[F.lit(0.0).alias(n) for n in ("u0", "u1", "h0", "h1", "h2")])

    def newton(s, _):
        def moments(acc, p):
            mu = F.exp(F.least(p["o"] + s["a"] + s["b"] * p["x"], F.lit(700.0)))
            r = p["y"] - mu
            return F.struct(
                (acc["u0"] + r).alias("u0"), (acc["u1"] + p["x"] * r).alias("u1"), (acc["h0"] + mu).alias("h0"),
                (acc["h1"] + p["x"] * mu).alias("h1"), (acc["h2"] + p["x"] * p["x"] * mu).alias("h2"),
            )

        def solve(m):
            det = m["h0"] * m["h2"] - m["h1"] * m["h1"]
            da = F.coalesce(F.try_divide(m["h2"] * m["u0"] - m["h1"] * m["u1"], det), F.lit(0.0))
            db = F.coalesce(F.try_divide(m["h0"] * m["u1"] - m["h1"] * m["u0"], det), F.lit(0.0))
            return F.struct(
                (s["a"] + da).alias("a"), (s["b"] + db).alias("b"), F.greatest(F.abs(da), F.abs(db)).alias("step")
            )

        return F.aggregate(F.col("_p"), zero5, moments, solve)

    usable = (F.col("_sy") > 0) & (F.col("points") >= min_points)
    fit = pts.withColumn("_f", F.when(usable, F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, newton)))

    def info(acc, p):
        mu = F.exp(F.least(p["o"] + F.col("_f.a") + F.col("_f.b") * p["x"], F.lit(700.0)))
        return F.struct((acc["h0"] + mu).alias("h0"), (acc["h1"] + p["x"] * mu).alias("h1"), (acc["h2"] + p["x"] * p["x"] * mu).alias("h2"))

    zero3 = F.struct(*[F.lit(0.0).alias(n) for n in ("h0", "h1", "h2")])
    fit = fit.withColumn("_h", F.when(F.col("_f").isNotNull(), F.aggregate(F.col("_p"), zero3, info)))
    det = F.col("_h.h0") * F.col("_h.h2") - F.col("_h.h1") * F.col("_h.h1")
    good = F.col("_f.step") < 1e-8
    return fit.select(
        *by, F.when(good, F.col("_f.a")).alias("constant"), F.when(good, F.col("_f.b")).alias("g"),
        F.when(good, F.try_divide(F.col("_h.h2"), det)).alias("var_constant"),
        F.when(good, F.try_divide(F.col("_h.h0"), det)).alias("var_g"),
        F.when(good, F.try_divide(-F.col("_h.h1"), det)).alias("cov"),
        F.when(good, "full_interaction").otherwise("no_model").alias("model_status"),
        "points",
    )


def _indicators(levels: Column, level: Column) -> Column:
    return F.transform(levels, lambda v: (v == level).cast("double"))


def _eliminate(matrix: Column, rows: Column, width: Column) -> Column:
    """Gauss-Jordan elimination of a positive semi-definite system, flattened by rows.

    ``rows`` are the unknowns and ``width`` the columns with the right-hand sides.  An unknown without
    information of its own (a pivot of zero) becomes zero.
    """

    def pivot(a, k):
        p = F.get(a, k * width + k)

        def entry(v, n):
            i, j = F.floor(n / width).cast("int"), n % width
            unit = F.get(a, k * width + j) / p
            weak = F.when((i == k) | (j == k), F.lit(0.0)).otherwise(v)
            return F.when(p > 1e-12, F.when(i == k, unit).otherwise(v - F.get(a, i * width + k) * unit)).otherwise(weak)

        return F.transform(a, entry)

    return F.aggregate(F.sequence(F.lit(0), rows - 1), matrix, pivot)


def poisson_main_effects(df: DataFrame, by, x: str, factors: list[str], count: str, exposure: str, passes: int = 25) -> DataFrame:
    """Common slope per group with additive factor effects (the fallback model).

    The first factor is absorbed: for given other coefficients its effects have a closed form, and what
    remains is a multinomial likelihood of a few coefficients (the slope and the other factors' levels but
    one).  The first factor may have any number of levels, because a Newton pass is one fold over the points of each of its
    levels and one small sum over the levels; put the largest factor first.  The inverse of
    the remaining information holds the variance of the slope of the whole model.

    A level without counts says nothing about the slope and is left out, as are rows that lack a level
    of another factor than the first.  A group with fewer than three points, without counts
    or without spread in ``x`` inside any level of the first factor, or whose last step still moves, has no slope.
    """
    by, (first, *others) = list(by), factors
    cells = (
        df.filter(finite(x) & (or_zero(exposure) > 0))
        .groupBy(*by, *factors, x).agg(F.sum(or_zero(count)).alias("_y"), F.sum(or_zero(exposure)).alias("_n"))
    )
    z = F.array(F.col(x).cast("double"))
    for n, f in enumerate(others):
        levels = cells.groupBy(*by, f).agg(F.sum("_y").alias("_s")).filter("_s > 0").groupBy(*by).agg(F.sort_array(F.collect_list(f)).alias(f"_l{n}"))
        cells = cells.join(levels, by, "left")
        level = F.col(f)
        beyond = F.slice(f"_l{n}", 2, F.greatest(F.size(f"_l{n}") - 1, F.lit(0)))
        z = F.concat(z, _indicators(beyond, level))
    seen = F.lit(True)
    for n, f in enumerate(others):
        seen = seen & F.coalesce(F.array_contains(f"_l{n}", F.col(f)), F.lit(False))
    point = F.when(seen, F.struct(z.alias("z"), F.col("_y").alias("y"), F.log("_n").alias("o")))
    strata = cells.groupBy(*by, first).agg(F.collect_list(point).alias("_p"), F.sum(F.when(seen, F.col("_y"))).alias("_t"), F.count("*").alias("_c"))
    strata = materialise(strata.drop(first), "main-effect-strata")
    live = strata.filter("_t > 0")
    head = live.groupBy(*by).agg(F.max(F.size(F.get("_p", F.lit(0))["z"])).alias("_k"))
    zeros = F.transform(F.sequence(F.lit(1), F.col("_k")), lambda _: F.lit(0.0))
    fit = head.select(*by, zeros.alias("_b"), F.lit(None).cast("double").alias("_step"), F.lit(None).cast("double").alias("_v"))
    for _ in range(passes):
        fit = materialise(_concentrated_pass(live, fit, by), "main-effect-coefficients")
        if fit.filter("_step >= 1e-10").isEmpty():
            break
    rows = strata.groupBy(*by).agg(F.sum("_c").alias("rows"))
    fit = fit.select(*[F.col(k).alias(f"_by_{k}") for k in by], "_b", "_step", "_v")
    same = [rows[k].eqNullSafe(fit[f"_by_{k}"]) for k in by]
    out = rows.join(fit, same, "left")
    good = (F.col("rows") >= 3) & (F.col("_step") < 1e-8) & F.col("_v").between(1e-300, 1e300)
    return out.select(*by, F.when(good, F.get("_b", F.lit(0))).alias("g"), F.when(good, F.col("_v")).alias("var_g"), "rows")


def _concentrated_pass(strata: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """One Newton step of the coefficients ``_b`` with the size of the slope's step and its variance."""
    few = fit.select(*[F.col(k).alias(f"_by_{k}") for k in by], "_b")
    x = strata.join(few, [strata[k].eqNullSafe(few[f"_by_{k}"]) for k in by])

    def total(of: str) -> str:
        return f"aggregate({of}, 0D, (t, u) -> t + u)"

    def weighted(of: str) -> str:
        return total(f"zip_with(_p, _w, (q, w) -> w * {of})")

    x = x.selectExpr(*by, "_b", "_t", "_p", f"transform(_p, q -> q.o + {total('zip_with(q.z, _b, (u, v) -> u * v)')}) AS _e")
    x = x.selectExpr(*by, "_b", "_t", "_p", "transform(_e, e -> exp(e - array_max(_e))) AS _w", "sequence(0, size(_b) - 1) AS _at")
    x = x.selectExpr("*", f"{total('_w')} AS _sw").selectExpr("*", f"transform(_at, i -> {weighted('q.z[i]')} / _sw) AS _m")
    # moments about the mean do not cancel
    spread = f"flatten(transform(_at, i -> transform(_at, j -> _t / _sw * {weighted('(q.z[i] - _m[i]) * (q.z[j] - _m[j])')})))"
    score = "transform(_at, i -> aggregate(_p, 0D, (t, q) -> t + q.y * (q.z[i] - _m[i])))"
    entries = x.selectExpr(*by, "_b", f"posexplode(concat({spread}, {score})) AS (_i, _x)")
    sums = entries.groupBy(*by, "_b", "_i").agg(F.sum("_x").alias("_x"))
    sums = sums.groupBy(*by, "_b").agg(F.expr("transform(array_sort(collect_list(struct(_i, _x))), e -> e._x)").alias("_s"))
    # information, score and the first unit vector side by side
    row, column = "int(n div (_k + 2))", "n % (_k + 2)"
    side = f"CASE WHEN {column} < _k THEN _s[{row} * _k + {column}] WHEN {column} = _k THEN _s[_k * _k + {row}] WHEN n = _k + 1 THEN 1D ELSE 0D END"
    sums = sums.selectExpr("*", "size(_b) AS _k").selectExpr("*", f"transform(sequence(0, _k * (_k + 2) - 1), n -> {side}) AS _a")
    sums = sums.withColumn("_a", _eliminate(F.col("_a"), F.col("_k"), F.col("_k") + 2))
    spreads = "_s[0] > 1e-12"
    return sums.selectExpr(
        *by, "transform(_b, (b, i) -> b + _a[i * (_k + 2) + _k]) AS _b", f"CASE WHEN {spreads} THEN abs(_a[_k]) END AS _step",
        f"CASE WHEN {spreads} THEN _a[_k + 1] END AS _v",
    )


def with_fallback(full: DataFrame, fallback: DataFrame, by, shared) -> DataFrame:
    """Take the common slope where the full model has none, and say which was used."""
    f = fallback.select(*shared, F.col("g").alias("_g"), F.col("var_g").alias("_v"))
    j = full.join(f, list(shared), "left")
    use = (F.col("model_status") == "no_model") & F.col("_g").isNotNull()
    return j.withColumns(
        {
            "g": F.when(use, F.col("_g")).otherwise(F.col("g")),
            "var_g": F.when(use, F.col("_v")).otherwise(F.col("var_g")),
            "model_status": F.when(use, "main_effect_fallback").otherwise(F.col("model_status")),
        }
    ).drop("_g", "_v")


# ---------------------------------------------------------------- background and excess


def intercept_by_cause(base: DataFrame, by, code: str, codes, value: str, intercepts: DataFrame, intercept: str = "intercept") -> DataFrame:
    """Share of each cause in the base period times the all-cause intercept.

    A zero base total leaves the share NULL: no composition is invented.
    """
    by = list(by)
    grid = complete_codes(base, by, code, codes, value)
    total = F.sum(value).over(W.partitionBy(*by))
    j = grid.withColumn("_share", F.when(total > 0, F.col(value) / total)).join(
        intercepts.select(*by, F.col(intercept).alias("_i")), by, "left"
    )
    return j.select(*by, code, (F.col("_share") * F.coalesce("_i", F.lit(0.0))).alias("cause_intercept"))


def expected_and_excess(
    panel: DataFrame, trends: DataFrame, intercepts: DataFrame, trend_keys, intercept_keys, year: str, count: str,
    population: str, age_weight: Column, base: float | Column, exempt: Column,
) -> DataFrame:
    """Expected background counts and the excess above them.

    background = intercept * (1 + t) ** (age weight * g) * population / 100,000, capped
    at the observed count; exempt rows and rows without a model have no excess.
    """
    x = panel.join(trends.select(*trend_keys, "g", "model_status"), list(trend_keys), "left")
    x = x.join(intercepts.select(*intercept_keys, "cause_intercept"), list(intercept_keys), "left")
    t = F.greatest(F.lit(0.0), F.col(year) - (base if isinstance(base, Column) else F.lit(float(base))))
    rate = F.col("cause_intercept") * F.pow(1.0 + t, age_weight * F.col("g"))
    x = x.withColumn("_rate", rate)
    expected = F.col("_rate") * F.col(population) / 1e5
    expected = F.when(finite(expected) & (expected >= 0), expected).otherwise(0.0)
    no_model = F.coalesce(F.col("model_status").isin("no_model", "excluded"), F.lit(True))
    keep = no_model | (expected > F.col(count)) | F.coalesce(exempt, F.lit(False)) | ~finite("_rate")
    x = x.withColumn("expected", F.when(keep, F.col(count)).otherwise(expected))
    return x.withColumn("excess", F.greatest(F.lit(0.0), F.col(count) - F.col("expected"))).drop("_rate", "cause_intercept", "g")


def allocate_excess(
    counts: DataFrame, excess: DataFrame, keys, member: str, members, value: str, amount: str
) -> DataFrame:
    """Split an excess over sub-groups by their counts, never above a sub-group's count."""
    keys, members = list(keys), list(members)
    totals = excess.groupBy(*keys).agg(F.sum(or_zero(amount)).alias("_d"))
    both = counts.select(*keys, member, or_zero(value).alias(value)).unionByName(
        totals.select(*keys, F.lit(None).cast(counts.schema[member].dataType).alias(member), F.lit(0.0).alias(value))
    )
    grid = complete_codes(both, keys, member, members, value)
    tot = F.sum(value).over(W.partitionBy(*keys))
    share = F.when(tot > 0, F.col(value) / tot).otherwise(1.0 / len(members))
    j = grid.withColumn("_share", share).join(totals, keys, "left")
    moved = F.least(F.col(value), F.greatest(F.lit(0.0), F.coalesce("_d", F.lit(0.0)) * F.col("_share")))
    return j.withColumn("transferred", moved).withColumn("retained", F.col(value) - F.col("transferred")).drop("_share", "_d")


def reassemble(
    original: DataFrame, allocation: DataFrame, keys, code: str, value: str, affected, destination: dict, receiver
) -> DataFrame:
    """Unaffected counts, retained counts on their destination code, transferred counts on the receiver."""
    keys = list(keys)
    ctype = original.schema[code].dataType
    kept = original.filter(~F.col(code).isin(list(affected))).select(*keys, code, or_zero(value).alias(value))
    dest = F.lit(None).cast(ctype)
    for old, new in destination.items():
        dest = F.when(F.col(code) == F.lit(old), F.lit(new).cast(ctype)).otherwise(dest)
    # one pass over the allocation emits both the retained and the transferred part
    parts = F.array(
        F.struct(dest.alias(code), F.col("retained").alias(value)),
        F.struct(F.lit(receiver).cast(ctype).alias(code), F.col("transferred").alias(value)),
    )
    moved = allocation.select(*keys, F.explode(parts).alias("_p")).select(*keys, "_p.*").filter(F.col(code).isNotNull())
    out = kept.unionByName(moved).groupBy(*keys, code).agg(F.sum(value).alias(value))
    return out.withColumn(value, F.when(finite(value) & (F.col(value) >= 0), F.col(value)).otherwise(0.0))
