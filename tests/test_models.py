import math

import numpy as np
import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from tallyloom.functions import hashing
from tallyloom.functions.quantiles import type8
from tallyloom.operators import calibrate, compose, draws, redistribute, regress, summarise, survey

FAILED = (PySparkException, Py4JError)


def test_weight_tables():
    w = compose.interpolation_weights(list(range(1997, 2020)), [2000, 2009, 2017])
    assert math.isclose(w[2005, 2000], 4 / 9) and math.isclose(w[2005, 2009], 5 / 9) and (2005, 2017) not in w
    assert w[2013, 2009] == w[2013, 2017] == 0.5 and w[1997, 2000] == 1.0 and w[2019, 2017] == 1.0
    s = compose.smoothing_weights(list(range(1, 11)), 5)
    assert [s[5, j] * 9 for j in (3, 4, 5, 6, 7)] == pytest.approx([1, 2, 3, 2, 1])
    assert math.isclose(sum(v for (i, _), v in s.items() if i == 1), 1.0)
    with pytest.raises(ValueError):
        compose.smoothing_weights([1, 2, 3], 4)


def test_composition_round_trip_at_anchors(spark):
    tree = compose.CompositionTree({"x": [1, 2], "y": [3]}, 3)
    data = [(y, c, f, 50.0) for y, fs in ((2000, (0.2, 0.3, 0.5)), (2002, (0.1, 0.1, 0.8))) for c, f in zip((1, 2, 3), fs)]
    f = spark.createDataFrame(data, "yr int, code int, f double, n double")
    panel = compose.fit_fraction_panel(f, tree, [], "yr", "code", "f", "n", [2000, 2001, 2002], [2000, 2002], 1)
    got = {(r["yr"], r["code"]): r["fraction"] for r in panel.collect()}
    for y, c, v, _ in data:
        assert math.isclose(got[y, c], v, rel_tol=1e-12)
    assert math.isclose(sum(v for (y, _), v in got.items() if y == 2001), 1.0)


def test_anchor_correction_extrapolates_and_floors(spark):
    data = [(1, 2000, 0.0, True), (1, 2009, 0.1, True), (1, 2017, 0.3, True), (2, 2000, 1.0, False), (2, 2009, 0.9, False), (2, 2017, 0.7, False)]
    f = spark.createDataFrame(data, "code int, yr int, f double, zero boolean")
    fix = [compose.AnchorCorrection(1, 2000, 2009, 2017, require_source_zero=True)]
    out = {(r["yr"], r["code"]): r for r in compose.correct_anchors(f, [], "code", "yr", "f", "zero", fix, [2000, 2009, 2017]).collect()}
    assert math.isclose(out[2000, 1]["fraction_corrected"], 1e-5 / (1 + 1e-5)) and out[2000, 1]["correction_applied"]
    assert out[2009, 1]["fraction_corrected"] == 0.1 and not out[2009, 1]["correction_applied"]


def test_log_ratio_needs_positive_input(spark):
    from tallyloom.functions.columns import log_ratio

    with pytest.raises(FAILED):
        spark.createDataFrame([(0.0, 1.0)], "a double, b double").select(log_ratio("a", "b")).collect()


def test_completeness_scalars_fill_and_freeze(spark):
    comp = spark.createDataFrame(
        [("p", 2010, 10.0, 40.0, 20.0, 20.0), ("p", 2011, 50.0, 10.0, 30.0, 20.0), ("p", 2012, 1.0, 1.0, 1.0, 1.0)],
        "k string, yr int, d11 double, d12 double, d21 double, d22 double",
    )
    adj = spark.createDataFrame([("p", 2010, 130.0), ("p", 2011, 50.0)], "k string, yr int, adjusted double")
    got = {r["yr"]: (r["s1"], r["s2"]) for r in calibrate.completeness_scalars(comp, adj, ["k"], "yr", 2011).collect()}
    assert got[2010] == (2.6, 2.0)  # (130 - 50) / 40
    assert got[2011] == (0.5, 0.0) and got[2012] == got[2011]


def cal(spark, data, level):
    df = spark.createDataFrame(data, "yr int, cell int, a double, b double, lp double, act boolean").withColumn("ll", F.lit(math.log(level)))
    return {r["cell"]: r for r in calibrate.calibrate_to_level(df, ["yr"], ["cell"], "a", "b", "lp", "ll", "act").collect()}


def test_calibration_meets_target_and_keeps_cells(spark):
    got = cal(spark, [(1, 1, 30.0, 70.0, 0.3, True), (1, 2, 20.0, 80.0, -0.2, True)], 1.2)
    assert math.isclose(sum(r["first_after"] for r in got.values()), 60.0, abs_tol=1e-8)
    assert all(math.isclose(r["first_after"] + r["second_after"], 100.0) for r in got.values())


def test_calibration_leaves_inactive_and_one_sided_cells(spark):
    got = cal(spark, [(1, 1, 5.0, 95.0, 0.0, False), (1, 2, 45.0, 55.0, 0.0, True), (1, 3, 0.0, 9.0, 0.0, True)], 1.2)
    assert got[1]["first_after"] == 5.0 and got[3]["first_after"] == 0.0
    assert math.isclose(got[2]["first_after"], 55.0, abs_tol=1e-8)


def test_calibration_extreme_profile(spark):
    got = cal(spark, [(1, 1, 30.0, 70.0, -800.0, True), (1, 2, 20.0, 80.0, 0.0, True)], 1.0)
    assert math.isclose(sum(r["first_after"] for r in got.values()), 50.0, abs_tol=1e-7)
    with pytest.raises(FAILED):
        cal(spark, [(1, 1, 30.0, 70.0, 0.0, True)], 4.0)


def test_annual_factor_between_anchors(spark):
    a = spark.createDataFrame(
        [(2009, 1, math.log(1.5), math.log(1.5)), (2017, 1, math.log(0.8), math.log(0.8))], "yr int, cell int, log_profile double, log_level_ratio double"
    )
    got = {r["yr"]: r["profile_factor"] for r in calibrate.annual_factors(a, "yr", ["cell"], [2005, 2013, 2019], [2009, 2017]).collect()}
    assert math.isclose(got[2013], math.sqrt(1.5 * 0.8)) and math.isclose(got[2005], 1.5) and math.isclose(got[2019], 0.8)
    with pytest.raises(FAILED):
        calibrate.annual_factors(a.filter("yr = 2009"), "yr", ["cell"], [2013], [2009, 2017]).collect()


def test_trend_adjustment(spark):
    cells = spark.createDataFrame([(1, 2015, 10.0), (1, 2016, 10.0), (1, 2017, 6.0), (2, 2017, 3.0)], "k int, yr int, v double")
    reg = spark.createDataFrame([(1, 2015, 20.0), (1, 2016, 20.0), (1, 2017, 24.0)], "k int, yr int, r double")
    out = calibrate.trend_adjust(cells, reg, ["k"], "yr", 2017, [2015, 2016], "v", "r")
    assert rows(out, "k", "yr", "v") == [(1, 2015, 10.0), (1, 2016, 10.0), (1, 2017, 12.0), (2, 2017, 3.0)]


def test_lag_fallback_and_freeze(spark):
    src = spark.createDataFrame([(1, 2003, 3.0), (1, 2007, 7.0)], "p int, yr int, v double")
    out = calibrate.lagged_panel(
        src, "p", "yr", "v", [1], list(range(2007, 2012)), [2], F.lit(1), "age", substitute={2008: 2007}, fallback=(2009, 2008), freeze_after=2009
    )
    assert {r["yr"]: r["v"] for r in out.collect()} == {2007: None, 2008: 7.0, 2009: 7.0, 2010: 7.0, 2011: 7.0}


def test_type8_matches_definition(spark):
    x = [float(i) for i in range(1, 11)]
    df = spark.createDataFrame([(x,)], "a array<double>")
    got = df.select(type8("a", 0.025), type8("a", 0.5), type8("a", 0.975)).first()
    expect = np.quantile(x, [0.025, 0.5, 0.975], method="median_unbiased")
    assert list(got) == pytest.approx(list(expect))


def test_summary_rejects_missing_draws(spark):
    d = spark.createDataFrame([(i, 1, float(i)) for i in range(1, 11)], "draw_id int, k int, v double")
    assert summarise.summarise_draws(d, ["k"], "v", expected=10).first()["n_draws"] == 10
    with pytest.raises(FAILED):
        summarise.summarise_draws(d, ["k"], "v", expected=11).collect()
    assert summarise.incomplete_keys(d, ["k"], 11).count() == 1


def test_co_movement(spark):
    rows_ = [(i, c, v) for i in range(1, 6) for c, v in (("d", float(i)), ("x", 10.0 - i), ("k", 4.0))]
    out = summarise.co_movement(spark.createDataFrame(rows_, "draw_id int, c string, v double"), [], "c", "d", "v")
    got = {r["c"]: (r["correlation"], r["slope"]) for r in out.collect()}
    assert got["x"] == pytest.approx((-1.0, -1.0)) and got["k"] == (None, 0.0)


def test_bootstrap_is_repeatable_and_balanced(spark):
    units = spark.createDataFrame([(s, f"{s}-{u}") for s, n in ((1, 30), (2, 1), (3, 7)) for u in range(n)], "s int, u string")
    a = survey.bootstrap_multipliers(units, "s", "u", 25, 9)
    b = survey.bootstrap_multipliers(units.repartition(3), "s", "u", 25, 9)
    assert rows(a, "draw_id", "s", "u", "multiplier") == rows(b, "draw_id", "s", "u", "multiplier")
    per = {(r["draw_id"], r["s"]): r["m"] for r in a.groupBy("draw_id", "s").agg(F.sum("multiplier").alias("m")).collect()}
    assert len(per) == 75 and all(per[d, s] == {1: 30, 2: 1, 3: 7}[s] for d, s in per)


def test_component_seeds(spark):
    r = spark.range(1, 3).withColumnRenamed("id", "draw_id").select(hashing.component_seed(5, "draw_id", 3)).collect()
    assert [x[0] for x in r] == [5 + 10007 + 3, 5 + 20014 + 3]
    one = spark.range(1).select(hashing.component_seed(2147483647, F.lit(0), 0)).first()[0]
    assert one == 1


def test_normal_and_lognormal_moments(spark):
    z = spark.range(20000).select(hashing.normal("s", F.col("id")).alias("z")).agg(F.avg("z"), F.stddev_samp("z")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 1) < 0.02
    f = draws.lognormal_factors(spark.createDataFrame([("p", 0.3)], "p string, sd double"), "p", "sd", 1, 5000, 1)
    assert abs(f.agg(F.avg("factor")).first()[0] - 1) < 0.02


def test_gamma_shapes_and_weights(spark):
    assert math.isclose(draws.subset_gamma_shape(2), 0.25) and math.isclose(draws.subset_gamma_shape(3), 0.28888888888888886)
    rules = redistribute.parse_rules("a | 1 | 2 3 4 |\nb | 5 | 6 |")
    m = draws.rule_multipliers(spark, rules, 1, 50, 3)
    for r in m.collect():
        assert list(r["multipliers"]) == ["a"] and math.isclose(sum(r["multipliers"]["a"]), 3.0) and min(r["multipliers"]["a"]) > 0
    again = draws.rule_multipliers(spark, rules, 1, 50, 3).repartition(3)
    assert sorted(map(str, m.collect())) == sorted(map(str, again.collect()))
    audit = draws.multiplier_audit(m).first()
    assert audit["stochastic_rules"] == 1 and math.isclose(audit["mean_multiplier"], 1.0)


def test_stochastic_rules_conserve(spark):
    rules = redistribute.parse_rules("a | 1 | 2 3 4 |")
    x = draws.with_draws(spark.createDataFrame([(9.0, 1.0, 2.0, 0.0)], "c1 double, c2 double, c3 double, c4 double"), 1, 30)
    out = redistribute.apply_move_rules(x.join(draws.rule_multipliers(spark, rules, 1, 30, 3), "draw_id"), rules, multipliers="multipliers")
    sums = [r[0] for r in out.select(F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4")).collect()]
    assert sums == pytest.approx([12.0] * 30) and out.select(F.count_distinct("c2")).first()[0] > 20


def test_dirichlet_mean_and_closure(spark):
    c = spark.createDataFrame([("g", k, f, 40.0) for k, f in zip("abc", (0.5, 0.3, 0.2))], "g string, k string, f double, n double")
    d = draws.dirichlet_draws(c, ["g"], "k", "f", "n", 1, 2000, 5).cache()
    mean = {r["k"]: (r["m"], r["v"]) for r in d.groupBy("k").agg(F.avg("draw_fraction").alias("m"), F.var_samp("draw_fraction").alias("v")).collect()}
    for k, f in zip("abc", (0.5, 0.3, 0.2)):
        assert abs(mean[k][0] - f) < 0.01 and abs(mean[k][1] - f * (1 - f) / 41) < 0.001
    assert d.groupBy("draw_id").agg(F.sum("draw_fraction").alias("s")).filter(F.abs(F.col("s") - 1) > 1e-12).count() == 0
    fixed = draws.dirichlet_draws(c.withColumn("n", F.lit(0.0)), ["g"], "k", "f", "n", 1, 2, 5)
    assert {round(r["draw_fraction"], 12) for r in fixed.collect()} == {0.5, 0.3, 0.2}


def test_ols_closed_form(spark):
    x, y = [1.0, 2.0, 4.0, 7.0], [2.1, 3.9, 8.4, 13.8]
    f = regress.ols(spark.createDataFrame([(1, a, b) for a, b in zip(x, y)] + [(2, 1.0, 5.0), (2, 1.0, 7.0)], "g int, x double, y double"), ["g"], "x", "y")
    got = {r["g"]: r for r in f.collect()}
    b, a = np.polyfit(x, y, 1)
    rss = sum((yy - a - b * xx) ** 2 for xx, yy in zip(x, y))
    sxx = sum((xx - np.mean(x)) ** 2 for xx in x)
    assert got[1]["intercept"] == pytest.approx(a) and got[1]["slope"] == pytest.approx(b)
    assert got[1]["intercept_variance"] == pytest.approx(rss / 2 * (1 / 4 + np.mean(x) ** 2 / sxx))
    assert got[2]["intercept"] is None and got[2]["median_y"] == 6.0


def test_poisson_trend_agrees_with_glm(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rng = np.random.default_rng(4)
    data = [(t, float(np.log1p(t)), float(rng.poisson(80 * (1 + t) ** 0.3)), 1000.0 + 10 * t) for t in range(20)]
    df = spark.createDataFrame([(1, *d) for d in data], "grp int, t int, x double, y double, n double")
    fit = regress.poisson_trend(df, ["grp"], "x", "y", "n").first()
    glr = GeneralizedLinearRegression(family="poisson", link="log", labelCol="y", offsetCol="o", maxIter=50, tol=1e-12)
    m = glr.fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(df.withColumn("o", F.log("n"))))
    assert fit["g"] == pytest.approx(m.coefficients[0], rel=1e-8) and fit["constant"] == pytest.approx(m.intercept, rel=1e-8)
    assert math.sqrt(fit["var_g"]) == pytest.approx(m.summary.coefficientStandardErrors[0], rel=1e-6)
    zero = regress.poisson_trend(df.withColumn("y", F.lit(0.0)), ["grp"], "x", "y", "n").first()
    assert zero["g"] is None and zero["model_status"] == "no_model"


def test_poisson_main_effects_agree_with_glm(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rng = np.random.default_rng(9)
    data, flat = [], []
    for place in range(5):
        for sex in range(3):
            for t in range(8):
                y = float(rng.poisson(40 * (1 + place) * (1 + t) ** 0.4 / (1 + sex)))
                data.append(("a", place, sex, float(np.log1p(t)), y, 1000.0 + 7 * t))
                flat.append((*[float(place == p) for p in range(1, 5)], *[float(sex == s) for s in (1, 2)], *data[-1][3:]))
    # a place without counts and a level without counts change nothing; a group without counts has no slope
    empty = [("a", 99, 0, 0.5, 0.0, 50.0), ("a", 1, 7, 0.5, 0.0, 50.0), ("b", 1, 1, 0.1, 0.0, 5.0), ("b", 1, 1, 0.2, 0.0, 5.0), ("b", 1, 1, 0.3, 0.0, 5.0)]
    # one point of each place tells nothing of a slope
    single = [("c", p, 1, 0.1 * p, 5.0, 50.0) for p in range(6)]
    df = spark.createDataFrame(data + empty + single, "grp string, place int, sex int, x double, y double, n double")
    fit = {r["grp"]: r for r in regress.poisson_main_effects(df, ["grp"], "x", ["place", "sex"], "y", "n").collect()}
    names = [*[f"p{i}" for i in range(4)], "s1", "s2", "x", "y", "n"]
    wide = spark.createDataFrame(flat, ", ".join(f"{c} double" for c in names)).withColumn("o", F.log("n"))
    glr = GeneralizedLinearRegression(family="poisson", link="log", labelCol="y", offsetCol="o", maxIter=50, tol=1e-12)
    m = glr.fit(VectorAssembler(inputCols=names[:7], outputCol="features").transform(wide))
    assert fit["a"]["g"] == pytest.approx(m.coefficients[6], rel=1e-7)
    assert math.sqrt(fit["a"]["var_g"]) == pytest.approx(m.summary.coefficientStandardErrors[6], rel=1e-6)
    assert fit["a"]["rows"] == 122 and fit["b"]["g"] is None and fit["c"]["g"] is None
    assert regress.poisson_main_effects(df.limit(0), ["grp"], "x", ["place", "sex"], "y", "n").count() == 0


def test_zero_base_total_gives_no_share(spark):
    base = spark.createDataFrame([(1, "a", 0.0), (2, "a", 3.0), (2, "b", 1.0)], "k int, c string, n double")
    ic = spark.createDataFrame([(1, 10.0), (2, 10.0)], "k int, intercept double")
    got = {(r["k"], r["c"]): r["cause_intercept"] for r in regress.intercept_by_cause(base, ["k"], "c", ["a", "b"], "n", ic).collect()}
    assert got == {(1, "a"): None, (1, "b"): None, (2, "a"): 7.5, (2, "b"): 2.5}


def test_allocation_is_bounded_and_conserves(spark):
    counts = spark.createDataFrame([(1, 1, 6.0), (1, 2, 2.0), (2, 1, 5.0)], "k int, g int, n double")
    exc = spark.createDataFrame([(1, 4.0), (3, 2.0)], "k int, excess double")
    out = regress.allocate_excess(counts, exc, ["k"], "g", [1, 2], "n", "excess")
    got = {(r["k"], r["g"]): (r["transferred"], r["retained"]) for r in out.collect()}
    assert got[1, 1] == (3.0, 3.0) and got[1, 2] == (1.0, 1.0) and got[2, 1] == (0.0, 5.0) and got[3, 1] == (0.0, 0.0)
    full = counts.withColumn("c", F.lit(7)).unionByName(spark.createDataFrame([(1, 1, 2.5, 8)], "k int, g int, n double, c int"))
    done = regress.reassemble(full, out.withColumn("c", F.lit(7)), ["k", "g"], "c", "n", [7], {7: 70}, 2)
    assert done.agg(F.sum("n")).first()[0] == pytest.approx(full.agg(F.sum("n")).first()[0])
    assert {r["c"] for r in done.collect()} == {8, 70, 2}


def test_mvn_draws_follow_covariance(spark):
    f = spark.createDataFrame([(1, [1.0, 2.0], [0.5, 0.2, 0.2, 0.3])], "k int, m array<double>, c array<double>")
    d = draws.mvn_draws(f, ["k"], "m", "c", 1, 4000, 8).select(F.col("coefficients")[0].alias("a"), F.col("coefficients")[1].alias("b"))
    s = d.agg(F.avg("a"), F.avg("b"), F.covar_samp("a", "b"), F.var_samp("a")).first()
    assert s[0] == pytest.approx(1.0, abs=0.05) and s[1] == pytest.approx(2.0, abs=0.05) and s[2] == pytest.approx(0.2, abs=0.03)


def test_calibration_root_equals_exact_root(spark):
    rng = np.random.default_rng(12)
    rows_, want = [], {}
    # odds over ten orders of magnitude; targets near the ends of the envelope and in its middle
    for yr, scale in ((1, 0.3), (2, 4.0), (3, 9.0)):
        for share in (1e-6, 0.02, 0.5, 0.97, 1 - 1e-6):
            n = 400
            e = rng.lognormal(2, 2, n)
            w = 1 / (1 + np.exp(-rng.normal(0, scale, n)))
            a, b = e * w, e * (1 - w)
            keep = (a > 1e-10) & (b > 1e-10)
            a, b = a[keep], b[keep]
            lp = rng.normal(0, 1, len(a))
            target = share * (a + b).sum()
            level = math.log(target / a.sum())
            eta, lo, hi = np.log(a) - np.log(b) + lp, -200.0, 200.0
            for _ in range(300):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if ((a + b) / (1 + np.exp(-(eta + mid)))).sum() < target else (lo, mid)
            group = f"{yr}-{share}"
            want[group] = (lo, target)
            rows_ += [(group, i, float(a[i]), float(b[i]), float(lp[i]), level, True) for i in range(len(a))]
    df = spark.createDataFrame(rows_, "yr string, cell int, a double, b double, lp double, ll double, act boolean")
    out = calibrate.calibrate_to_level(df, ["yr"], ["cell"], "a", "b", "lp", "ll", "act")
    got = {r["yr"]: r for r in out.groupBy("yr").agg(F.max("intercept").alias("d"), F.min("intercept").alias("d2"), F.sum("first_after").alias("t")).collect()}
    assert len(got) == 15
    for g, (d, target) in want.items():
        assert got[g]["d"] == got[g]["d2"] == pytest.approx(d, abs=1e-8), g
        # cells below the tolerance of 1e-10 become zero
        assert got[g]["t"] == pytest.approx(target, rel=1e-9, abs=4e-8), g


def test_covariance_root_truncates_negative_eigenvalues(spark):
    rng = np.random.default_rng(3)
    ms = [np.zeros((2, 2)), np.eye(3), np.array([[4.0]]), np.array([[1.0, 1.0], [1.0, 1.0]])]
    for k in (2, 3, 5, 6):
        a = rng.normal(size=(k, k))
        ms += [a @ a.T, a + a.T]
    df = spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(ms)], "i int, c array<double>")
    for r in df.select("i", draws.covariance_root(F.col("c")).alias("r")).collect():
        m = ms[r["i"]]
        root = np.array(r["r"]).reshape(m.shape)
        vals, vecs = np.linalg.eigh(m)
        assert np.allclose(root @ root.T, (vecs * np.maximum(vals, 0)) @ vecs.T, atol=1e-9), r["i"]


def test_weight_correction_tolerance(spark):
    df = spark.createDataFrame([("a", 1.00000001), ("a", 2.0), ("b", 1.0)], "p string, w double")
    fix = spark.createDataFrame([("a", 1.0, 9.0)], "p string, old double, new double")
    assert rows(survey.correct_weights(df, fix, ["p"], "w", "old", "new"), "p", "w") == [("a", 2.0), ("a", 9.0), ("b", 1.0)]


def test_borrowed_fractions_and_effective_size(spark):
    data = [("p", 1, c, v, 20.0) for c, v in ((1, 3.0), (2, 1.0))] + [("p", 2, c, 0.0, 5.0) for c in (1, 2)] + [("q", 1, c, 0.0, 7.0) for c in (1, 2)]
    counts = spark.createDataFrame(data, "place string, age int, code int, v double, n double")
    out = compose.counts_to_fractions(counts, ["place", "age"], "code", [1, 2], "v", {"place": ["place"], "all": []}, "n")
    got = {(r["place"], r["age"], r["code"]): r for r in out.collect()}
    assert got["p", 1, 1]["fraction"] == 0.75 and got["p", 1, 1]["effective_n"] == 20.0
    assert got["p", 2, 1]["fraction"] == 0.75 and got["p", 2, 1]["fraction_source"] == "borrowed:place" and got["p", 2, 1]["effective_n"] == 25.0
    assert got["q", 1, 2]["fraction"] == 0.25 and got["q", 1, 2]["fraction_source"] == "borrowed:all" and got["q", 1, 2]["effective_n"] == 32.0


def test_fallback_slopes_share_one_draw_per_cause(spark):
    rows_ = [("a", 1, 0.5, 0.04, "main_effect_fallback"), ("a", 2, 0.5, 0.04, "main_effect_fallback"), ("a", 3, 0.5, 0.04, "full_interaction"), ("b", 1, 0.5, 0.04, "full_interaction")]
    fits = spark.createDataFrame(rows_, "cause string, place int, g double, var_g double, model_status string")
    got = {(r["draw_id"], r["cause"], r["place"]): r["g"] for r in draws.draw_slopes(fits, ["cause", "place"], 1, 5, 3, shared=["cause"]).collect()}
    for d in range(1, 6):
        assert got[d, "a", 1] == got[d, "a", 2]
        assert len({got[d, "a", 1], got[d, "a", 3], got[d, "b", 1]}) == 3
