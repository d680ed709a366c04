"""Completeness scalars, registration trend, and level/profile calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions.columns import add_all, clamp_residue, finite, logistic, or_zero, safe_exp, safe_ratio
from tallyloom.operators.compose import interpolation_weights, weight_table
from tallyloom.operators.grid import complete_cells, literal_levels
from tallyloom.session import materialise

# ---------------------------------------------------------------- completeness


def completeness_panel(
    supplied: DataFrame, keys: dict[str, list], age: str, ages: list, supplied_ages: list, copy_to: int, copy_from: int,
    value: str = "completeness", strict: bool = False,
) -> DataFrame:
    """Full panel of completeness factors.

    Supplied ages use the input, every other age is one; an absent or invalid
    supplied value is one (or fails when strict); one age copies another.
    """
    dims = [*keys, age]
    panel = complete_cells(
        supplied.filter(F.col(age).isin(supplied_ages)), dims, [value], {**keys, age: [a for a in ages if a != copy_to]},
        fill=float("nan"),
    )
    usable = finite(value) & (F.col(value) >= 0)
    other = F.raise_error(F.lit("invalid completeness value")).cast("double") if strict else F.lit(1.0)
    v = F.when(~F.col(age).isin(supplied_ages), F.lit(1.0)).when(usable, F.col(value)).otherwise(other)
    panel = panel.withColumn(value, v)
    # the copied age is emitted from its donor row: no second scan of the panel
    targets = F.when(F.col(age) == copy_from, F.array(F.lit(copy_from), F.lit(copy_to))).otherwise(F.array(F.col(age)))
    return panel.withColumn(age, F.explode(targets))


def adjusted_totals(
    totals: DataFrame, completeness: DataFrame, keys, value: str, divisor_when: Column, divisor: float,
    factor: str = "completeness",
) -> DataFrame:
    """Adjusted totals: a one-off divisor where stated, then the completeness factor (default one)."""
    keys = list(keys)
    v = F.when(divisor_when, or_zero(value) / F.lit(divisor)).otherwise(or_zero(value))
    j = totals.withColumn(value, v).join(completeness.select(*keys, F.col(factor).alias("_c")), keys, "left")
    return j.groupBy(*keys).agg(F.sum(F.col(value) * F.coalesce(F.col("_c"), F.lit(1.0))).alias(value))


def _freeze(df: DataFrame, keys, period: str, freeze, columns) -> DataFrame:
    """Hold columns at their value of the freeze period afterwards (kept if that is absent)."""
    ref = df.filter(F.col(period) == freeze).select(*keys, *[F.col(c).alias(f"_{c}_f") for c in columns])
    out = df.join(ref, list(keys), "left")
    for c in columns:
        held = F.when((F.col(period) > freeze) & F.col(f"_{c}_f").isNotNull(), F.col(f"_{c}_f")).otherwise(F.col(c))
        out = out.withColumn(c, held)
    return out.drop(*[f"_{c}_f" for c in columns])


def completeness_scalars(
    components: DataFrame, adjusted: DataFrame, keys, period: str, freeze, total: str = "adjusted",
    copy: tuple[str, int, int] | None = None, tolerance: float = 1e-10,
) -> DataFrame:
    """Scalars that make four observed components meet an adjusted total.

    ``components`` has ``d11 d12 d21 d22`` per key and period, ``d12`` being the
    residual component.  The others are scaled down by ``s1`` when they alone exceed
    the total; the residual component is scaled by ``s2`` to fill what is left.
    """
    keys = list(keys)
    x = components.join(adjusted.select(*keys, period, F.col(total).alias("_adj")), [*keys, period], "left")
    everything = add_all(["d11", "d12", "d21", "d22"])
    missing = F.col("_adj").isNull() & (F.col(period) <= freeze)
    adj = F.when(missing, everything).otherwise(F.coalesce(F.col("_adj"), everything))
    x = x.withColumns({"_adj": adj, "_missing": missing, "_obs": F.col("d11") + F.col("d21") + F.col("d22")})
    x = x.withColumn("s1", safe_ratio("_adj", "_obs", 1.0))
    x = x.withColumn("_others", F.when(F.col("s1") < 1, F.col("_obs") * F.col("s1")).otherwise(F.col("_obs")))
    x = x.withColumn("s2", F.when(F.col("d12") > 0, F.try_divide(F.col("_adj") - F.col("_others"), F.col("d12"))).otherwise(1.0))
    out = {}
    for s in ("s1", "s2"):
        c = F.when((F.col(s) < 0) & (F.col(s) >= -tolerance), 0.0).otherwise(F.col(s))
        out[s] = F.when(~finite(s) | (F.col(s) < -tolerance), F.raise_error(F.lit(f"invalid completeness scalar {s}")).cast("double")).otherwise(c)
    x = x.withColumns(out).select(*keys, period, "s1", "s2")
    if copy:
        age, src, dst = copy
        ages = F.when(F.col(age) == src, F.array(F.lit(src), F.lit(dst))).otherwise(F.array(F.col(age)))
        x = x.filter(F.col(age) != dst).withColumn(age, F.explode(ages))
    return _freeze(x, keys, period, freeze, ["s1", "s2"])


def apply_scalars(cells: DataFrame, scalars: DataFrame, keys, residual: Column, value: str) -> DataFrame:
    """Residual class takes ``s2``; every other class takes ``s1`` only where it shrinks."""
    j = cells.join(scalars.select(*keys, "s1", "s2"), list(keys), "left")
    scale = F.when(residual, F.coalesce("s2", F.lit(1.0))).when(F.coalesce("s1", F.lit(1.0)) < 1, F.col("s1")).otherwise(1.0)
    v = F.col(value) * scale
    return j.withColumn(value, F.when(finite(v) & (v >= 0), v).otherwise(0.0)).drop("s1", "s2")


def trend_adjust(
    cells: DataFrame, register: DataFrame, keys, period: str, start, calibration: list, value: str, register_value: str,
    copy: tuple[str, int, int] | None = None,
) -> DataFrame:
    """Follow a second source's trend from ``start`` on.

    The second source is put on the level of the cells over the calibration periods,
    then each later cell is scaled by (scaled source / cell total).  No usable source
    means no adjustment.  ``copy`` = (age, source age, copied age) treats one age as
    part of another when forming ratios.
    """
    keys = list(keys)
    k = {c: F.col(c) for c in keys}
    if copy:
        age, src, dst = copy
        k[age] = F.when(F.col(age) == dst, F.lit(src)).otherwise(F.col(age))
    key_cols = [k[c].alias(c) for c in keys]
    totals = cells.groupBy(*key_cols, period).agg(F.sum(or_zero(value)).alias("_d"))
    second = register.groupBy(*keys, period).agg(F.sum(or_zero(register_value)).alias("_r"))
    in_cal = F.col(period).isin(calibration)
    both = (
        totals.filter(in_cal).select(*keys, "_d", F.lit(0.0).alias("_r"))
        .unionByName(second.filter(in_cal).select(*keys, F.lit(0.0).alias("_d"), "_r"))
        .groupBy(*keys).agg(F.sum("_d").alias("_d"), F.sum("_r").alias("_r"))
    )
    rescale = both.select(*keys, F.when(F.col("_r") > 0, F.try_divide(F.col("_d"), F.col("_r"))).alias("_k"))
    future = (
        totals.filter(F.col(period) >= start)
        .join(second, [*keys, period], "left").join(rescale, keys, "left")
    )
    scaled = F.col("_r") * F.col("_k")
    ratio = F.when((F.col("_d") > 0) & scaled.isNotNull(), scaled / F.col("_d")).otherwise(1.0)
    scalar = future.select(*keys, period, ratio.alias("_s"))
    if copy:
        age, src, dst = copy
        ages = F.when(F.col(age) == src, F.array(F.lit(src), F.lit(dst))).otherwise(F.array(F.col(age)))
        scalar = scalar.withColumn(age, F.explode(ages))
    out = cells.join(scalar, [*keys, period], "left")
    s = F.when(F.col(period) >= start, F.coalesce("_s", F.lit(1.0))).otherwise(1.0)
    return out.withColumn(value, F.col(value) * s).drop("_s")


def merge_codes(df: DataFrame, code: str, merges: dict, by, value: str) -> DataFrame:
    """Fold codes into others and re-sum."""
    c = F.col(code)
    for old, new in merges.items():
        c = F.when(F.col(code) == old, F.lit(new)).otherwise(c)
    return df.groupBy(*by, c.alias(code)).agg(F.sum(or_zero(value)).alias(value))


def national_view(cells: DataFrame, by, value: str, parameters: DataFrame | None = None, keys=()) -> DataFrame:
    """Totals over the dropped dimensions with optional parameters attached."""
    out = cells.groupBy(*by).agg(F.sum(or_zero(value)).alias(value))
    return out if parameters is None else out.join(parameters, list(keys), "left")


def lagged_panel(
    source: DataFrame, place: str, year: str, value: str, places: list, years: list, ages: list, lag_of_age: Column,
    age: str, substitute: dict | None = None, fallback: tuple[int, int] | None = None, freeze_after: int | None = None,
) -> DataFrame:
    """Value at (year - lag(age)), with substituted source years, a fallback year and a freeze.

    ``fallback`` = (year, donor year): a missing value in ``year`` takes the donor
    year's value.  After ``freeze_after`` every year repeats that year's value.
    """
    span = [y for y in years if freeze_after is None or y <= freeze_after]
    grid = source.select(place).filter(F.col(place).isin(places)).distinct()
    grid = grid.withColumn(year, F.explode(literal_levels(span))).withColumn(age, F.explode(literal_levels(ages)))
    src = F.col(year) - lag_of_age
    for old, new in (substitute or {}).items():
        src = F.when(src == old, F.lit(new)).otherwise(src)
    values = source.groupBy(place, F.col(year).alias("_src")).agg(F.max(value).alias(value))
    panel = grid.withColumn("_src", src.cast("int")).join(values, [place, "_src"], "left").drop("_src")
    w = W.partitionBy(place, age)  # one row per year
    if fallback:
        y, donor = fallback
        lent = F.max(F.when(F.col(year) == donor, F.col(value))).over(w)
        panel = panel.withColumn(value, F.when((F.col(year) == y) & ~finite(value), lent).otherwise(F.col(value)))
    if freeze_after is not None:
        later = [y for y in years if y > freeze_after]
        if later:
            ys = F.when(F.col(year) == freeze_after, literal_levels([freeze_after, *later])).otherwise(F.array(F.col(year)))
            panel = panel.withColumn(year, F.explode(ys))
    return panel


# ---------------------------------------------------------------- level and profile anchors


def floored_profile(value: Column, use: Column, window, floor: float) -> Column:
    """Share of the used rows, floored; equal shares where nothing is positive (not yet closed)."""
    v = F.when(use & finite(value) & (value > 0), value).otherwise(0.0)
    total = F.sum(v).over(window)
    equal = F.try_divide(F.lit(1.0), F.sum(F.when(use, 1.0).otherwise(0.0)).over(window))
    return F.when(use, F.greatest(F.when(total > 0, v / total).otherwise(equal), F.lit(floor))).otherwise(0.0)


def level_profile_anchors(
    cells: DataFrame, year: str, cell, routine: str, survey: str, level: str, active: str, floor: float = 1e-10,
    smooth: tuple[str, dict] | None = None,
) -> DataFrame:
    """Survey-to-routine level ratio per year and smoothed log profile per cell.

    Profiles are floored shares over the active cells of a year; an inactive cell
    keeps log profile zero.  ``smooth`` = (dimension, weight table) smooths the log
    profile along one dimension within the remaining cell dimensions.
    """
    cell = list(cell)
    wy = W.partitionBy(year)  # one row per cell of the year
    on = F.col(active)
    x = cells.select(year, *cell, or_zero(routine).alias("_r"), or_zero(survey).alias("_s"), F.col(level).alias("_l"), active)
    x = x.withColumns(
        {"_rt": F.sum("_r").over(wy), "_rp": floored_profile(F.col("_r"), on, wy, floor), "_sp": floored_profile(F.col("_s"), on, wy, floor)}
    )
    x = x.withColumns({c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(wy)), F.lit(0.0)) for c in ("_rp", "_sp")})
    ratio = safe_ratio("_l", "_rt", None)
    out = x.select(
        year, *cell, active, F.col("_rp").alias("routine_share"), F.col("_sp").alias("survey_share"),
        F.when(on, F.log("_sp") - F.log("_rp")).otherwise(0.0).alias("raw_log_profile"),
        ratio.alias("level_ratio"), F.log(ratio).alias("log_level_ratio"),
    )
    if smooth is None:
        return out.withColumn("log_profile", F.col("raw_log_profile"))
    dim, weights = smooth
    # every cell contributes to its neighbours and carries its own attributes to itself,
    # so that smoothing needs one aggregate and no self join
    w = weight_table(out.sparkSession, weights, "_target", dim)
    others = [c for c in cell if c != dim]
    own = F.col(dim) == F.col("_target")
    keep = [active, "routine_share", "survey_share", "raw_log_profile", "level_ratio", "log_level_ratio"]
    g = out.join(w, dim).groupBy(year, *others, F.col("_target").alias(dim)).agg(
        F.sum(F.col("raw_log_profile") * F.col("_w")).alias("_sm"), *[F.max(F.when(own, F.col(c))).alias(c) for c in keep]
    )
    g = g.filter(F.col(active).isNotNull())
    return g.select(year, *cell, *keep, F.when(F.col(active), F.col("_sm")).otherwise(0.0).alias("log_profile"))


def annual_factors(anchors: DataFrame, year: str, cell, years: list, anchor_years: list, inactive: Column | None = None) -> DataFrame:
    """Log-linear path of profile and level between anchors, held outside them.

    ``anchors`` holds every cell at every anchor year; a gap fails the job.
    """
    w = weight_table(anchors.sparkSession, interpolation_weights(years, anchor_years), "_target", year)
    path = anchors.join(w, year).groupBy(*cell, F.col("_target").alias(year)).agg(
        F.sum(F.col("log_profile") * F.col("_w")).alias("log_profile"),
        F.sum(F.col("log_level_ratio") * F.col("_w")).alias("log_level_ratio"), F.sum("_w").alias("_w"),
    )
    gap = F.raise_error(F.lit("a cell lacks an anchor year")).cast("double")
    path = path.withColumn("log_profile", F.when(F.abs(F.col("_w") - 1.0) < 1e-9, F.col("log_profile")).otherwise(gap)).drop("_w")
    out = path.withColumns({"profile_factor": safe_exp("log_profile"), "level_ratio": safe_exp("log_level_ratio")})
    return out.withColumn("calibration_active", F.lit(True) if inactive is None else ~inactive)


# ---------------------------------------------------------------- bounded calibration

#: Largest relative distance of a calibrated group from its target.
MAX_RESIDUAL = 1e-7
#: Width of a bin of log-odds.  A cell lies within half a width of its bin's centre, where the series of the logistic
#: function to fifth order is off by less than 1e-12 of its value.
BIN_WIDTH = 1 / 16


def _bin_sums(d: str, then: str) -> str:
    """SQL: the sum of ``e * logistic(eta + d)`` over the bins of a group and its slope, as ``r.f`` and ``r.df`` in ``then``."""
    f = (
        "v.b.m0 * v.s + v.q * (v.b.m1 + v.b.m2 / 2 * (1 - 2 * v.s) + v.b.m3 / 6 * (1 - 6 * v.q)"
        " + v.b.m4 / 24 * (1 - 2 * v.s) * (1 - 12 * v.q) + v.b.m5 / 120 * (1 - 30 * v.q + 120 * v.q * v.q))"
    )
    df = (
        "v.q * (v.b.m0 + v.b.m1 * (1 - 2 * v.s) + v.b.m2 / 2 * (1 - 6 * v.q)"
        " + v.b.m3 / 6 * (1 - 2 * v.s) * (1 - 12 * v.q) + v.b.m4 / 24 * (1 - 30 * v.q + 120 * v.q * v.q))"
    )
    odds = f"transform(_bins, b -> struct(b AS b, 1D / (1D + exp(-(b.c + {d}))) AS s))"
    terms = f"transform({odds}, v -> struct(v.b AS b, v.s AS s, v.s * (1D - v.s) AS q))"
    return f"aggregate({terms}, struct(0D AS f, 0D AS df), (t, v) -> struct(t.f + {f} AS f, t.df + {df} AS df), r -> {then})"


def _root(steps: int = 80) -> str:
    """SQL: the root d of a group by Newton steps inside a shrinking bracket."""
    newton = "(z.d - try_divide(r.f - _t, r.df))"
    lo, hi = "if(r.f < _t, z.d, z.lo)", "if(r.f < _t, z.hi, z.d)"
    inside = f"coalesce({newton} > {lo} AND {newton} < {hi}, false)"
    moved = f"if({inside}, {newton}, ({lo} + {hi}) / 2)"
    still = f"abs({moved} - z.d) <= 1e-15 * (1 + abs(z.d))"
    step = _bin_sums("z.d", f"struct({lo} AS lo, {hi} AS hi, {moved} AS d, {still} AS still)")
    start = "struct(_lo AS lo, _hi AS hi, (_lo + _hi) / 2 AS d, false AS still)"
    return f"aggregate(sequence(1, {steps}), {start}, (z, n) -> if(z.still, z, {step}), z -> z.d)"


def calibrate_to_level(
    cells: DataFrame, group, cell, first: str, second: str, log_profile: str, log_level: str, active: str,
    tolerance: float = 1e-10,
) -> DataFrame:
    """Split each cell total between two classes so that the group meets its level target.

    Per group find d with ``sum(e * logistic(log(first/second) + profile + d)) = target``
    over the adjustable cells, where ``e`` is the cell total, and keep every cell
    total.  Inactive and one-sided cells stay as they are.

    The cells are written once and scanned twice.  The first scan adds them up to a histogram of log-odds per
    group: a bin holds the sums of ``e`` times the powers of the distance from its centre, from which the group's sum
    follows for any d to about 1e-12 of its value.  Bins are partial sums, so a group may be arbitrarily large; they
    are as many as sixteenths lie between its least and greatest log-odds.  The root is found on the bins by Newton steps in
    an analytic bracket, and the second scan applies it.  A group whose root misses the target by more than
    ``MAX_RESIDUAL`` of it fails the job.
    """
    group, cell = list(group), list(cell)
    x = cells.select(
        *group, *cell, or_zero(first).alias("_a"), or_zero(second).alias("_b"), F.col(log_profile).alias("_p"),
        F.col(log_level).alias("_l"), F.col(active).alias("_act"),
    )
    x = x.withColumn("_on", F.coalesce("_act", F.lit(False)) & (F.col("_a") > tolerance) & (F.col("_b") > tolerance))
    x = x.withColumns(
        {
            "_e": F.col("_a") + F.col("_b"),
            "_eta": F.when(F.col("_on"), F.log("_a") - F.log("_b") + F.col("_p")),
        }
    )
    x = materialise(x, "calibration-cells")
    on = F.col("_on")
    # a cell without log-odds lies in no bin, and its group fails the residual check
    number = F.when(on & finite("_eta"), F.floor(F.col("_eta") / BIN_WIDTH))
    centre = (F.col("_bin") + 0.5) * BIN_WIDTH
    moments = [F.sum(F.when(F.col("_bin").isNotNull(), F.col("_e") * F.pow(F.col("_eta") - centre, F.lit(k)))).alias(f"m{k}") for k in range(6)]
    bins = x.withColumn("_bin", number).groupBy(*group, "_bin").agg(
        F.sum(F.when(~on, F.col("_a"))).alias("_fixed"), F.sum(F.when(on, F.col("_a"))).alias("_adj"), F.sum(F.when(on, F.col("_e"))).alias("_max"),
        F.min(F.when(on, F.col("_eta"))).alias("_lo_eta"), F.max(F.when(on, F.col("_eta"))).alias("_hi_eta"), F.max("_l").alias("_lev"), *moments,
    )
    entry = F.struct(centre.alias("c"), *[f"m{k}" for k in range(6)])
    g = bins.groupBy(*group).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("_fixed", "_adj", "_max")],
        F.min("_lo_eta").alias("_lo_eta"), F.max("_hi_eta").alias("_hi_eta"), F.max("_lev").alias("_lev"),
        F.collect_list(F.when(F.col("_bin").isNotNull(), entry)).alias("_bins"),
    )
    target = (F.col("_fixed") + F.col("_adj")) * safe_exp("_lev") - F.col("_fixed")
    g = g.withColumn("_t", target)
    off = F.col("_max").isNotNull() & (F.col("_max") > 0) & (
        ~finite("_t") | (F.col("_t") < 0) | (F.col("_t") > F.col("_max") + tolerance)
    )
    g = g.withColumn("_t", F.when(off, F.raise_error(F.lit("level target outside the adjustable envelope")).cast("double")).otherwise(F.col("_t")))
    p = F.least(F.greatest(F.try_divide(F.col("_t"), F.col("_max")), F.lit(1e-300)), F.lit(1.0 - 1e-16))
    logit = F.log(p) - F.log1p(-p)
    # fresh aliases keep the small side distinct from the cells it is joined to
    fresh = [F.col(k).alias(k) for k in group]
    bounds = g.filter("_max > 0").select(
        *fresh, "_t", "_bins", (logit - F.col("_hi_eta") - 1e-9).alias("_lo"), (logit - F.col("_lo_eta") + 1e-9).alias("_hi"),
    )
    met = bounds.withColumn("_d", F.expr(_root())).withColumn("_f", F.expr(_bin_sums("_d", "r.f")))
    close = F.abs(F.col("_f") - F.col("_t")) <= MAX_RESIDUAL * F.greatest(F.abs(F.col("_t")), F.lit(1.0))
    missed = F.raise_error(F.lit("calibration does not meet its level")).cast("double")
    delta = met.select(*fresh, F.when(F.coalesce(close, F.lit(False)), F.col("_d")).otherwise(missed).alias("_d"))
    out = x.join(delta, group, "left")
    solved = F.col("_on") & F.col("_d").isNotNull()
    a_new = F.when(solved, F.col("_e") * logistic(F.col("_eta") + F.col("_d"))).otherwise(F.col("_a"))
    out = out.withColumn("first_after", clamp_residue(a_new, tolerance))
    out = out.withColumn("second_after", clamp_residue(F.col("_e") - F.col("first_after"), tolerance))
    return out.select(
        *group, *cell, F.col("_a").alias("first_before"), F.col("_b").alias("second_before"), "first_after", "second_after",
        F.col("_on").alias("adjustable"), F.coalesce(F.col("_d"), F.lit(0.0)).alias("intercept"),
        safe_ratio("first_after", "_a", 1.0).alias("first_scale"), safe_ratio("second_after", "_b", 1.0).alias("second_scale"),
    )


def scale_classes(detail: DataFrame, calibrated: DataFrame, keys, first: Column, value: str) -> DataFrame:
    """Carry the class scales of a calibrated cell to its detailed causes."""
    keys = list(keys)
    j = detail.join(calibrated.select(*keys, "first_scale", "second_scale"), keys, "left")
    s = F.when(first, F.col("first_scale")).otherwise(F.col("second_scale"))
    return j.withColumn(value, F.col(value) * F.coalesce(s, F.lit(1.0))).drop("first_scale", "second_scale")
