import math

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from tallyloom.functions import ages, columns
from tallyloom.operators import aggregate, grid, hierarchy, rates, schema, validate
from tallyloom.operators.quantile import weighted_quantiles
from tallyloom.plans import views
from tallyloom.session import small_table
from tallyloom.sources import stores

FAILED = (PySparkException, Py4JError)


def test_alias_resolution_and_casts(spark):
    df = spark.createDataFrame([(" wc ", "7.0", "x")], "`Prov-ince` string, AGE5 string, junk string")
    out = schema.standardise(df, [schema.Field("province", (), "string"), schema.Field("age", ("age_5",), "int"), schema.Field("sex", (), "int", False)])
    assert rows(out, "province", "age", "sex") == [("WC", 7, None)]
    with pytest.raises(ValueError):
        schema.standardise(df, [schema.Field("missing")])


def test_finaliser_rejects_bad_rows(spark):
    spec = schema.CellSchema(("k",), "v", ("count",))
    good = spec.canonical(spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, count double"))
    assert rows(schema.finalise_cells(good, spec), "k", "v") == [(1, 5.0)]
    with pytest.raises(FAILED):
        schema.finalise_cells(spark.createDataFrame([(None, 2.0)], "k int, v double"), spec).collect()


def test_small_table_literals(spark):
    data = [(1, "it's", 0.5, True), (2, None, 2.0, False)]
    assert rows(small_table(spark, data, "a int, b string, c double, d boolean"), "a", "b", "c", "d") == data


def test_complete_cells(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 3.0), ("b", 2, 1.0)], "x string, y int, v double")
    out = grid.complete_cells(df, ["x", "y"], ["v"])
    assert rows(out, "x", "y", "v") == [("a", 1, 2.0), ("a", 2, 0.0), ("b", 1, 0.0), ("b", 2, 4.0)]
    supplied = grid.complete_cells(df, ["x", "y"], ["v"], {"x": ["a"], "y": [1, 9]}, fill=-1.0)
    assert rows(supplied, "x", "y", "v") == [("a", 1, 2.0), ("a", 9, -1.0)]


def test_complete_codes_short_and_long_lists_agree(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (2, 70, 3.0)], "g int, c int, v double")
    short = grid.complete_codes(df, ["g"], "c", [5, 70], "v")
    long = grid.complete_codes(df, ["g"], "c", list(range(1, 100)), "v").filter("c in (5, 70)")
    assert rows(short, "g", "c", "v") == rows(long, "g", "c", "v")


@pytest.mark.parametrize("codes", [64, 65])
def test_complete_codes_keeps_a_missing_key(spark, codes):
    df = spark.createDataFrame([(None, 5, 5.0), (1, 7, 2.0), (1, None, 4.0), (2, 99, 3.0)], "g int, c int, v double")
    out = grid.complete_codes(df, ["g"], "c", list(range(1, codes + 1)), "v")
    assert out.count() == 3 * codes
    assert {r["g"]: r["t"] for r in out.groupBy("g").agg(F.sum("v").alias("t")).collect()} == {None: 5.0, 1: 2.0, 2: 0.0}


def test_complete_cells_keeps_cells_with_a_missing_level(spark):
    df = spark.createDataFrame([("a", 1, 3.0), (None, 1, 5.0), ("b", None, 2.0)], "x string, y int, v double")
    out = grid.complete_cells(df, ["x", "y"], ["v"])
    assert out.agg(F.sum("v")).first()[0] == 10.0
    assert rows(out, "x", "y", "v") == [("a", 1, 3.0), ("b", 1, 0.0), ("b", None, 2.0), (None, 1, 5.0)]


def test_spread_join_deals_a_dominant_group(spark):
    many = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    few = spark.createDataFrame([(1, 2.0), (2, 3.0)], "g int, w double")
    out = grid.spread_join(many, few, ["g"])
    assert out.columns == ["g", "v", "w"] and out.count() == 1000
    assert grid.spread_join(many.withColumn("g", F.lit(3)), few, ["g"], "left").filter("w is null").count() == 1000


def test_small_table_holds_every_double(spark):
    got = [r[0] for r in small_table(spark, [(float("inf"),), (float("-inf"),), (float("nan"),), (1.5,)], "x double").collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2] and got[3] == 1.5


def test_pending_blocks_follow_the_exact_ids(spark, tmp_path):
    path = str(tmp_path / "draws")
    assert not stores.store_exists(spark, path)
    ids = [(1, 0), (2, 0), (3, 1), (9, 1), (5, 2)]  # block 1 has a foreign id and misses 4; block 2 is short and complete
    spark.createDataFrame(ids, "draw_id int, draw_block int").write.partitionBy("draw_block").parquet(path)
    assert stores.store_exists(spark, path)
    assert [r[0] for r in stores.pending_blocks(spark, path, 5, 2).collect()] == [1]


def test_percent_detection_at_the_border(spark):
    for values in ([1.0] * 99 + [3.0], [1.0] * 98 + [1.4, 2.0], [0.5] * 200 + [90.0], [2.0] * 5, [None, 0.2], [1.0] * 100 + [60.0, 70.0]):
        df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
        exact = df.agg(F.percentile(F.abs("v"), F.lit(0.99))).first()[0]
        got = views.percent_to_proportion(df, ["g"], "v").agg(F.max("v")).first()[0]
        assert got == max(v for v in values if v is not None) / (100.0 if exact > 1.5 else 1.0)


def test_bounded_attachment(spark):
    left, right = spark.range(3).withColumnRenamed("id", "a"), spark.range(4).withColumnRenamed("id", "b")
    assert grid.attach_all(left, right).count() == 12
    with pytest.raises(ValueError):
        grid.attach_all(left, left)
    expect = sorted((a, b) for a in range(3) for b in range(4))
    for array_rows in (1, 2, 3, 4):
        assert rows(grid.attach_all(left, right, array_rows), "a", "b") == expect
    assert grid.attach_all(left, right.filter("false")).count() == 0
    twice = grid.numbered(right.unionByName(right).withColumn("x", F.lit(None).cast("string")))
    assert sorted(r["_i"] for r in twice.collect()) == list(range(8))


def test_attachment_never_broadcasts_dealt_rows(spark):
    few, many = (spark.range(n).selectExpr(f"id AS {c}").repartition(2) for n, c in ((3, "a"), (5000, "b")))
    for array_rows, joins in ((3, False), (2, True)):
        out = grid.attach_all(few.distinct(), many, array_rows)
        assert rows(out, "a", "b") == sorted(((a, b) for a in range(3) for b in range(5000)), key=str)
        out.collect()  # only then is the plan final
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and ("SortMergeJoin" in plan) == joins


def test_labels_of_large_groups_come_in_chunks(spark, monkeypatch):
    df = spark.createDataFrame([(g, y, c, f"l{c:03d}") for g in ("a", "b", None) for y in (1, 2) for c in range(3 if g == "b" else 25)], "g string, y int, c int, l string")
    chunks = aggregate.label_chunks(df, ["g"], "l", 10).orderBy("g", "chunk").collect()
    got = {}
    for r in chunks:
        names = r["labels"].split(",")
        assert len(names) <= 10 and r["first"] == names[0]
        got[r["g"]] = got.get(r["g"], []) + names
    assert got == {g: [f"l{c:03d}" for c in range(n)] for g, n in (("a", 25), ("b", 3), (None, 25))}
    monkeypatch.setattr(aggregate, "LISTED", 10)
    out = {r["g"]: (r["labels"], r["cells"]) for r in aggregate.coverage(df, ["g"], "y", ["c"], "l").collect()}
    assert out == {"a": (None, 25), "b": ("l000,l001,l002", 3), None: (None, 25)}


def test_pivot_and_back(spark):
    df = spark.createDataFrame([(1, 3, 2.0), (1, 4, 0.0), (2, 4, 5.0)], "k int, c int, v double")
    wide = grid.pivot_codes(df, ["k"], "c", [3, 4, 5], "v")
    assert rows(wide, "k", "c3", "c4", "c5") == [(1, 2.0, 0.0, 0.0), (2, 0.0, 5.0, 0.0)]
    assert rows(grid.unpivot_codes(wide, ["k"], ["c3", "c4", "c5"], "c", "v"), "k", "c", "v") == [(1, 3, 2.0), (2, 4, 5.0)]
    assert grid.outside_domain(df, "c", [3]).count() == 2


def test_margins(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 1, 4.0)], "p int, s int, v double")
    out = aggregate.margins(df, ["p", "s"], {"p": 10, "s": 3}, ["v"])
    got = {(r["p"], r["s"]): r["v"] for r in out.collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 4, (1, 3): 5, (2, 3): 4, (10, 1): 6, (10, 2): 3, (10, 3): 9}


def test_weighted_mean_fallback(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 4.0, 3.0), (2, 5.0, 0.0), (2, 7.0, None), (3, None, 1.0)], "g int, v double, w double")
    assert rows(aggregate.weighted_mean(df, ["g"], "v", "w"), "g", "v", "w") == [(1, 3.5, 4.0), (2, 6.0, 0.0), (3, None, 1.0)]


def test_disagreeing_duplicates_fail(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 3.0)], "k int, v double")
    assert rows(aggregate.merge_consistent(df, ["k"], ["v"]), "k", "v") == [(1, 2.0), (2, 3.0)]
    with pytest.raises(FAILED):
        aggregate.merge_consistent(df.withColumn("v", F.col("v") + F.monotonically_increasing_id()), ["k"], ["v"]).collect()


def test_interpolated_year(spark):
    df = spark.createDataFrame([("a", 2003, 30.0), ("a", 2004, 99.0), ("b", 2006, 9.0), ("c", 2004, 5.0)], "k string, yr int, n double")
    out = aggregate.annual_with_correction(df, ["k"], "yr", "n", F.col("k") != "c", 2004, {2003: 2 / 3, 2006: 1 / 3})
    got = {(r["k"], r["yr"]): round(r["n"], 9) for r in out.collect()}
    assert got == {("a", 2003): 30, ("a", 2004): 20, ("b", 2004): 3, ("b", 2006): 9, ("c", 2004): 5}


def test_roll_up_strictness(spark):
    cells = spark.createDataFrame([(1, 10, 4.0), (1, 11, 6.0), (1, 99, 0.0)], "g int, c int, v double")
    m = spark.createDataFrame([(10, 1, 1.0), (11, 1, 0.5), (11, 2, 0.5)], "c int, t int, weight double")
    assert rows(hierarchy.roll_up(cells, m, ["g"], "c", "t", "v", complete=[1, 2, 3]), "t", "v") == [(1, 7.0), (2, 3.0), (3, 0.0)]
    with pytest.raises(FAILED):
        hierarchy.roll_up(cells.withColumn("v", F.lit(1.0)), m, ["g"], "c", "t", "v").collect()
    assert hierarchy.unmapped_mass(cells.withColumn("v", F.lit(1.0)), m, "c", "v").first()["c"] == 99


def test_checks_and_policy(spark):
    df = spark.createDataFrame([(1, 2.0), (1, -1.0), (2, None)], "k int, v double")
    report = validate.report(validate.unique_key(df, ["k"]), validate.non_negative(df, ["v"]), validate.no_missing(df, ["v"]))
    assert {r["check"]: r["failures"] for r in report.collect()} == {"unique_key": 1, "non_negative": 1, "no_missing": 1}
    with pytest.raises(AssertionError):
        validate.enforce(report)
    validate.enforce(report, validate.Policy.WARN)
    assert validate.exact_equality(df, df).first()["ok"] and not validate.exact_equality(df, df.limit(2)).first()["ok"]


def test_checkpoint_diff_null_equals_null(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 2.0 + 1e-9), (2, None), (4, 1.0)], "k int, v double")
    s = validate.diff_summary(validate.checkpoint_diff(a, b, ["k"], ["v"]), ["v"]).first()
    assert (s["rows"], s["both"], s["left_only"], s["right_only"], s["matching"]) == (4, 2, 1, 1, 2)


def test_age_codes(spark):
    df = spark.createDataFrame([(0,), (1,), (4,), (5,), (84,), (85,), (150,), (151,), (None,), (999,)], "y int")
    got = [r[0] for r in df.select(ages.band_of_years("y")).collect()]
    assert got == [2, 3, 3, 4, 19, 20, 20, 999, 999, 999]
    unit = spark.createDataFrame([(3, 0), (3, 2), (3, 1), (3, None)], "a int, u int")
    assert [r[0] for r in unit.select(ages.band_of_unit_age("a", "u")).collect()] == [1, 3, 2, 21]
    with pytest.raises(ValueError):
        ages.age_spec([0])
    assert ages.age_spec([20]) == ([0, 1, 2], [1, 2])


def test_column_functions(spark):
    df = spark.createDataFrame([("A00.1", 1.0, 0.0, -800.0), ("", 6.0, 3.0, 800.0)], "c string, n double, d double, z double")
    out = df.select(
        columns.icd_category("c").alias("k"), columns.safe_ratio("n", "d").alias("r0"), columns.safe_ratio("n", "d", None).alias("rn"),
        columns.logistic("z").alias("l"), columns.safe_exp(F.col("z") * 2).alias("e"), columns.date_of(F.lit(2001), F.lit(2), F.lit(30)).alias("bad"),
    ).collect()
    assert [(r["k"], r["r0"], r["rn"]) for r in out] == [("A00", 0.0, None), (None, 2.0, 2.0)]
    assert out[0]["l"] >= 0.0 and out[1]["l"] == 1.0 and all(0 < r["e"] < float("inf") for r in out) and out[0]["bad"] is None
    label = spark.createDataFrame([("  Côte d'Ivoire ",)], "x string").select(columns.slug("x")).first()[0]
    assert label == "cote_d_ivoire"


def cube_rows(spark, values):
    return spark.createDataFrame([(1, a, float(d), float(p)) for a, d, p in values], "g int, age int, d double, p double")


def test_asr_collapses_youngest_and_renormalises(spark):
    w = rates.standard_weights(spark.createDataFrame([(i, 100 / 18) for i in range(1, 19)], "age int, f double"), "age", "f")
    cells = cube_rows(spark, [(0, 5, 77), (1, 5, 50), (2, 5, 50), (3, 30, 200), (7, 1, 0)])
    out = rates.age_standardise(cells, ["g"], "age", "d", "p", w).first()["ASR"]
    assert math.isclose(out, 15000.0)
    over = rates.age_standardise_over(cells, ["g"], "age", "d", "p", w).first()["ASR"]
    assert math.isclose(over, 15000.0)
    names = [f"d{a}" for a in range(20)], [f"p{a}" for a in range(20)]
    data = {a: (0.0, 0.0) for a in range(20)} | {0: (5.0, 0.0), 1: (5.0, 50.0), 2: (5.0, 50.0), 3: (30.0, 200.0)}
    row = spark.createDataFrame([tuple(data[a][0] for a in range(20)) + tuple(data[a][1] for a in range(20))], names[0] + names[1])
    assert math.isclose(row.select(rates.asr_wide(*names, [1 / 18] * 18)).first()[0], 15000.0)


def test_aggregate_ages_split_members(spark):
    cells = cube_rows(spark, [(0, 5, 100), (1, 4, 10), (2, 3, 20), (5, 1, 7)])
    out = {r["age"]: (r["d"], r["p"]) for r in rates.age_groups(cells, ["g"], "age", ["d"], ["p"]).collect()}
    assert out[20] == (12.0, 30.0) and out[25] == (13.0, 37.0) and out[0] == (5.0, 100.0) and out[26] == (1.0, 7.0)


def test_yll_and_missing_schedule(spark):
    cells = spark.createDataFrame([(1, 5, 2.0)], "sex int, age int, v double")
    sch = spark.createDataFrame([(1, 5, 40.0)], "sex int, age int, l double").withColumns(rates.discounted_years("l"))
    r = rates.yll(cells, sch, ["sex", "age"], "v").first()
    assert r["YLL00"] == 80.0 and math.isclose(r["YLL03"], 2 * (1 - math.exp(-1.2)) / 0.03)
    with pytest.raises(FAILED):
        rates.yll(cells.withColumn("age", F.lit(6)), sch, ["sex", "age"], "v").collect()


def test_final_cube_invariants(spark):
    data = [(p, g, 42, 2000, s, a, float(p + g + s + a), 1.0, 1.0, 1.0) for p in (1, 2) for g in (1, 2) for s in (1, 2) for a in range(20)]
    deaths = spark.createDataFrame(data, "Death_Prov int, Popgroup int, nbdcode int, DeathYear int, Sex int, age int, Deaths double, YLL00 double, YLL03 double, YLL015 double")
    pop = spark.createDataFrame([(p, g, 2000, s, a, 100.0) for p in (1, 2) for g in (1, 2) for s in (1, 2) for a in range(2, 21)], "Death_Prov int, Popgroup int, DeathYear int, Sex int, age5 int, Pop double")
    den = rates.denominators(pop, "Death_Prov", "Popgroup", "Sex", "DeathYear", "age5", "Pop", list(range(2, 21)))
    w = rates.standard_weights(spark.createDataFrame([(i, 100 / 18) for i in range(1, 19)], "age int, f double"), "age", "f")
    x = rates.final_cube(deaths, den, w, places=[1, 2]).cache()
    got = {(r["Grouping"], r["Sex"], r["nbdcode"], r["Age"]): r for r in x.collect()}
    assert got[10, 3, 42, 25]["Deaths"] == sum(r[6] for r in data)
    # a female cause uses female denominators for both sexes, 19 ages x 2 places x 2 groups
    assert got[10, 3, 42, 25]["Pop"] == 19 * 4 * 100.0 and got[10, 1, 42, 25]["Pop"] == 19 * 4 * 100.0
    assert got[1, 1, 140, 3]["Deaths"] == 0.0 and got[10, 3, 140, 25]["Pop"] == 2 * 19 * 4 * 100.0
    assert got[11, 1, 42, 0]["Pop"] == 0.0 and len(got) == x.count()


def test_series_denominator_carried_once(spark):
    cells = spark.createDataFrame([(1, 3, 5.0, 100.0), (2, 3, 7.0, 100.0)], "c int, age int, d double, p double")
    series = spark.createDataFrame([(1, "s"), (2, "s")], "c int, series_id string")
    am = spark.createDataFrame([(3, 9, True, True)], "age int, age_id int, in_numerator boolean, in_denominator boolean")
    r = rates.series_rates(cells, [], "c", "age", "d", "p", series, am).first()
    assert (r["deaths"], r["population"]) == (12.0, 100.0) and math.isclose(r["crude_rate"], 12000.0)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("a", float(x), float(w)) for x, w in [(1, 1), (2, 1), (3, 2), (10, 6)]] + [("b", 4.0, 2.0)], "g string, x double, w double")
    assert rows(weighted_quantiles(df, ["g"], "x", "w", {"q": 0.4, "h": 0.41}), "g", "q", "h") == [("a", 3.0, 10.0), ("b", 4.0, 4.0)]


def test_collapse_accepts_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, c string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, c string").parquet(str(tmp_path / "in"))
    q = aggregate.tally(stream, ["k", "c"]).writeStream.outputMode("complete").format("memory").queryName("tallied").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("tallied"), "k", "c", "num") == [(1, "x", 2.0), (2, "y", 1.0)]
