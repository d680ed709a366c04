"""Draw summaries without gathering, and the way from a draw store to the interval store."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import summarise
from tallyloom.plans import intervals
from tallyloom.session import small_table
from tallyloom.sources import stores


def plain_type8(values, p):
    a, n = sorted(values), len(values)
    h = n * p + (p + 1) / 3
    j = int(h)
    lo, hi = a[min(max(j, 1), n) - 1], a[min(max(j + 1, 1), n) - 1]
    return lo + (h - j) * (hi - lo)


@pytest.mark.parametrize("n", [1, 2, 7, 40, 333])
def test_limits_equal_sorted_lists(spark, n):
    r = random.Random(n)
    cells = {(c, None if c == 2 else "x"): [r.choice([0.0, r.random(), r.random() * 100]) for _ in range(n)] for c in range(4)}
    rows = [(c, k, d + 1, v) for (c, k), vs in cells.items() for d, v in enumerate(vs)] + [(0, "x", n + 1, float("nan")), (0, "x", n + 2, None)]
    df = spark.createDataFrame(rows, "c int, k string, draw_id int, v double")
    packed = summarise.unpack_draws(summarise.pack_draws(df.filter("v IS NOT NULL AND NOT isnan(v)"), ["c", "k"], "v", 16), ["c", "k"], "v")
    for x in (df, packed):
        out = summarise.summarise_draws(x, ["c", "k"], "v", n).collect()
        assert len(out) == 4
        for row in out:
            own = cells[row["c"], row["k"]]
            assert row["n_draws"] == n and (row["min"], row["max"]) == (min(own), max(own))
            for name, p in summarise.LIMITS.items():
                assert row[name] == pytest.approx(plain_type8(own, p), rel=1e-12, abs=1e-12)


def test_summary_needs_no_array_of_draws(spark):
    df = spark.createDataFrame([(1, 1, 2.0)], "k int, draw_id int, v double")
    plan = summarise.summarise_draws(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") == 1


def inputs(spark, point_draw, asr):
    keys = ["storage_scope", "sex_code", "place"]
    row = "storage_scope string, sex_code int, place int"
    mapping = small_table(spark, [("a", "s", 1.0), ("b", "s", 1.0), ("a", "t", 1.0)], "cause_id string, series_id string, weight double")
    pop = small_table(spark, [("p", 1, 7, s, 10.0, 20.0, 30.0, 40.0) for s in "st"], f"{row}, series_id string, p0 double, p1 double, p2 double, p3 double")
    points = [("p", 1, 7, "s", 25, "count", 26.0), ("p", 1, 7, "t", 25, "count", 10.0), ("p", 1, 7, "s", 9, "asr", asr["s"]), ("p", 1, 7, "t", 9, "asr", asr["t"])]
    points.append(("p", 1, 7, "a_of_all", 25, "fraction", 10 / 26))
    point = small_table(spark, points, f"{row}, series_id string, age_id int, measure string, point double")
    return intervals.IntervalInputs(
        keys, ["d0", "d1", "d2", "d3"], mapping, pop, ["p0", "p1", "p2", "p3"], [0.25, 0.75], {25: ([0, 1, 2, 3], [1, 2, 3])}, 9, point, point_draw, {"a_of_all": (["a"], ["a", "b"])}
    )


def test_store_to_store(spark, tmp_path):
    row = "draw_id int, storage_scope string, sex_code int, place int, cause_id string, d0 double, d1 double, d2 double, d3 double"
    draws = [(d, "p", 1, 7, c, *(k * f for k in v)) for d, f in ((1, 0.5), (2, 1.0), (3, 2.0)) for c, v in (("a", (1.0, 2.0, 3.0, 4.0)), ("b", (1.0, 0.0, 5.0, 10.0)))]
    df = spark.createDataFrame(draws, row)
    for block, ids in enumerate(((1, 2), (3,))):
        stores.write_draw_block(df.filter(F.col("draw_id").isin(*ids)), f"{tmp_path}/draws", block)
    point = df.filter("draw_id = 2").drop("draw_id")
    rate = lambda young, old: 1e5 * (0.25 * young / 50 + 0.75 * old / 40)
    asr = {"s": rate(12, 14), "t": rate(6, 4)}
    i = inputs(spark, point, asr)
    out = {(r["series_id"], r["measure"]): r for r in intervals.publish_intervals(spark, f"{tmp_path}/draws", f"{tmp_path}/out", i, 3).collect()}
    assert len(out) == 5 and {r["alignment"] for r in out.values()} == {"aligned"}
    s = out["s", "count"]
    assert (s["point"], s["median"], s["min"], s["max"], s["n_draws"], s["population"]) == (26.0, 26.0, 13.0, 52.0, 3, 90.0)
    assert s["rate_point"] == pytest.approx(1e5 * 26 / 90)
    assert out["t", "asr"]["max"] == pytest.approx(2 * asr["t"]) and out["a_of_all", "fraction"]["lower"] == pytest.approx(10 / 26)
    # a published rate that the draws do not reproduce, a missing draw, a point without draws
    with pytest.raises(AssertionError, match="standardised rates"):
        intervals.publish_intervals(spark, f"{tmp_path}/draws", f"{tmp_path}/x", inputs(spark, point, asr | {"t": asr["t"] * (1 + 1e-7)}), 3)
    with pytest.raises(AssertionError, match="draw ids"):
        intervals.publish_intervals(spark, f"{tmp_path}/draws", f"{tmp_path}/x", i, 4)
    extra = i.points.unionByName(i.points.limit(1).withColumn("series_id", F.lit("other")))
    i.points = extra
    with pytest.raises(AssertionError, match="points and draws align"):
        intervals.publish_intervals(spark, f"{tmp_path}/draws", f"{tmp_path}/x", i, 3)
