import math
import random

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from tallyloom.operators import redistribute as R
from tallyloom.operators import validate

FAILED = (PySparkException, Py4JError)


def wide(spark, data, names=("id", "s", "a", "b")):
    return spark.createDataFrame(data, list(names))


def test_proportional_and_equal_split(spark):
    df = wide(spark, [(1, 20.0, 30.0, 10.0), (2, 10.0, 0.0, 0.0)])
    assert rows(R.redist(df, ["s"], ["a", "b"]), "id", "a", "b") == [(1, 45.0, 15.0), (2, 5.0, 5.0)]


def test_condition_zeroes_matching_rows_only(spark):
    df = wide(spark, [(1, 20.0, 30.0, 10.0), (2, 20.0, 30.0, 10.0)])
    out = R.redist(df, ["s"], ["a", "b"], condition="id = 1")
    assert rows(out, "id", "s", "a", "b") == [(1, 0.0, 45.0, 15.0), (2, 20.0, 30.0, 10.0)]


def test_null_counts_are_zero_or_an_error(spark):
    df = wide(spark, [(1, None, 30.0, 10.0), (2, 4.0, None, 1.0)])
    assert rows(R.redist(df, ["s"], ["a", "b"]), "id", "a", "b") == [(1, 30.0, 10.0), (2, 0.0, 5.0)]
    with pytest.raises(FAILED):
        R.redist(df, ["s"], ["a", "b"], missing="error").collect()


def test_null_condition_policy(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0, 1.0, None)], "id int, s double, a double, b double, c boolean")
    with pytest.raises(FAILED):
        R.redist(df, ["s"], ["a", "b"], condition="c").collect()
    keep = R.redistribute_columns(df, ["s"], ["a", "b"], "c", condition_null="exclude")
    move = R.redistribute_columns(df, ["s"], ["a", "b"], "c", condition_null="include")
    assert rows(keep, "s", "a") == [(2.0, 1.0)] and rows(move, "s", "a") == [(0.0, 2.0)]


def test_contract_errors(spark):
    df = wide(spark, [(1, 20.0, 30.0, 10.0)])
    with pytest.raises(ValueError):
        R.redist(df, ["s"], ["s", "a"])
    with pytest.raises(ValueError):
        R.redist(df, ["s"], ["nope"])
    with pytest.raises(ValueError):
        R.redist(df, ["s"], ["a", "b"], multipliers=[0.0, 0.0])
    with pytest.raises(FAILED):
        R.redist(wide(spark, [(1, -5.0, 1.0, 1.0)]), ["s"], ["a", "b"]).collect()
    assert R.redist(df, ["a"], ["a"]).columns == df.columns


def test_empty_table_still_drops_sources(spark):
    df = spark.createDataFrame([], "id int, s double, a double, b double")
    assert R.redist(df, ["s"], ["a", "b"]).columns == ["id", "a", "b"]


def test_random_rows_against_formula(spark):
    rng = random.Random(7)
    data = []
    for i in range(200):
        t = [0.0, 0.0] if i < 20 else [rng.random() * 50, rng.random() * 50]
        data.append((i, rng.random() * 30, *t))
    m = [1.5, 0.5]
    got = {r["id"]: (r["a"], r["b"]) for r in R.redist(wide(spark, data), ["s"], ["a", "b"], multipliers=m).collect()}
    for i, s, a, b in data:
        w = a * m[0] + b * m[1]
        share = a * m[0] / w if w > 0 else m[0] / sum(m)
        assert math.isclose(got[i][0], a + s * share, rel_tol=1e-12, abs_tol=1e-12)
        assert math.isclose(sum(got[i]), s + a + b, rel_tol=1e-12)


def test_unit_multipliers_equal_deterministic(spark):
    df = wide(spark, [(1, 20.0, 30.0, 10.0)])
    plain, unit = R.redist(df, ["s"], ["a", "b"]), R.redist(df, ["s"], ["a", "b"], multipliers=[3.0, 3.0])
    assert rows(plain, "a", "b") == rows(unit, "a", "b")


def test_unknown_category(spark):
    df = spark.createDataFrame([(1, 1, 30.0), (1, 2, 10.0), (1, 8, 20.0), (2, 8, 20.0)], "g int, c int, v double")
    out = R.redistribute_unknown(df, "c", "v", ["g"], 8, [1, 2])
    assert rows(out, "g", "c", "v") == [(1, 1, 45.0), (1, 2, 15.0), (2, 1, 10.0), (2, 2, 10.0)]
    bad = df.withColumn("c", F.when(F.col("c") == 2, 5).otherwise(F.col("c")))
    with pytest.raises(FAILED):
        R.redistribute_unknown(bad, "c", "v", ["g"], 8, [1, 2]).collect()


def test_reference_periods(spark):
    df = spark.createDataFrame(
        [(1, 1997, 8, 40.0), (1, 1999, 1, 80.0), (1, 2000, 2, 20.0), (1, 2001, 1, 1.0), (1, 2001, 2, 3.0), (1, 2001, 8, 4.0)],
        "g int, yr int, c int, v double",
    )
    out = R.redistribute_with_reference(df, "c", "v", ["g"], "yr", 8, [1, 2, 3], [1999, 2000], 1998)
    got = {(r["yr"], r["c"]): r["v"] for r in out.collect()}
    assert (got[1997, 1], got[1997, 2], got[1997, 3]) == (32.0, 8.0, 0.0)
    assert (got[2001, 1], got[2001, 2]) == (2.0, 6.0)


def test_rules_see_earlier_results(spark):
    rules = R.parse_rules("first | 1 | 2 |\nsecond | 2 | 3 4 | yr > 0")
    df = spark.createDataFrame([(1, 10.0, 2.0, 1.0, 3.0), (0, 10.0, 2.0, 1.0, 3.0)], "yr int, c1 double, c2 double, c3 double, c4 double")
    out = R.apply_move_rules(df, rules)
    assert rows(out, "yr", "c1", "c2", "c3", "c4") == [(0, 0.0, 12.0, 1.0, 3.0), (1, 0.0, 0.0, 4.0, 12.0)]
    assert R.codes_of("1 4:6") == (1, 4, 5, 6)


EXCL = [R.ExclusionRule((1, 2), "sex = 1", "not for sex 1"), R.ExclusionRule((1,), "age < 5", "too young")]


def test_envelope_scaling_and_donor_levels(spark):
    data = [
        ("p", 1, 9, 1, 10.0), ("p", 1, 9, 3, 5.0),  # survivor 3 takes everything
        ("p", 1, 2, 1, 4.0),  # nothing survives: borrows from the same place
        ("q", 1, 2, 2, 6.0),  # nothing survives: borrows from the whole country
    ]
    cells = spark.createDataFrame(data, "place string, sex int, age int, code int, v double")
    res = R.renormalise_envelopes(
        cells, ["place", "sex", "age"], "code", "v", {"all": [1, 2, 3]}, EXCL, {"place_sex": ["place", "sex"], "sex": ["sex"]}
    )
    got = {(r["place"], r["age"], r["code"]): r["v"] for r in res.cells.collect() if r["v"] > 0}
    assert got == {("p", 9, 3): 15.0, ("p", 2, 3): 4.0, ("q", 2, 3): 6.0}
    assert rows(res.fallback, "place", "age", "donor_level", "restored") == [("p", 2, "place_sex", 4.0), ("q", 2, "sex", 6.0)]
    reasons = {(r["place"], r["code"]): r["exclusion_reason"] for r in res.sources.collect()}
    assert reasons == {("p", 1): "not for sex 1; too young", ("q", 2): "not for sex 1"}


def test_last_resort_is_equal_over_valid_codes(spark):
    cells = spark.createDataFrame([("p", 1, 9, 1, 6.0)], "place string, sex int, age int, code int, v double")
    res = R.renormalise_envelopes(cells, ["place", "sex", "age"], "code", "v", {"all": [1, 2, 3, 4]}, EXCL, {"sex": ["sex"]})
    got = {r["code"]: r["v"] for r in res.cells.collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 3.0, 4: 3.0}
    assert res.fallback.first()["donor_level"] == "equal_valid_causes"


def test_conservation_and_row_order_invariance(spark):
    rng = random.Random(3)
    data = [(p, s, a, c, float(rng.randint(0, 5))) for p in "pqr" for s in (1, 2) for a in (2, 9) for c in (1, 2, 3)]
    cells = spark.createDataFrame(data, "place string, sex int, age int, code int, v double")
    shuffled = spark.createDataFrame(rng.sample(data, len(data)), cells.schema).repartition(3)
    args = (["place", "sex", "age"], "code", "v", {"all": [1, 2, 3]}, EXCL, {"sex": ["sex"]})
    a, b = R.renormalise_envelopes(cells, *args).cells, R.renormalise_envelopes(shuffled, *args).cells
    assert validate.group_totals_preserved(cells, a, ["place", "sex", "age"], "v").first()["ok"]
    assert validate.table_error(a, b, ["place", "sex", "age", "code"], "v").first()["max_absolute"] < 1e-9


def test_named_source_with_donor(spark):
    df = spark.createDataFrame([("x", 1, 9, 8.0), ("x", 2, 1, 6.0), ("x", 2, 2, 2.0), ("x", 2, 9, 4.0)], "g string, k int, c int, v double")
    out = R.redistribute_named_source(df, ["g", "k"], "c", "v", 9, [1, 2], {"g": ["g"]})
    assert rows(out, "k", "c", "v", "share_level") == [(1, 1, 6.0, "g"), (1, 2, 2.0, "g"), (2, 1, 9.0, "own"), (2, 2, 3.0, "own")]


def test_spatial_expansion_equal_without_donor(spark):
    totals = spark.createDataFrame([(1, 12.0), (2, 8.0)], "y int, n double")
    donors = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0)], "y int, p string, w double")
    out = R.expand_by_shares(totals, donors, ["y"], ["p"], "n", "w", {"p": ["a", "b"]})
    assert rows(out, "y", "p", "n", "share_source") == [(1, "a", 3.0, "donor"), (1, "b", 9.0, "donor"), (2, "a", 4.0, "equal"), (2, "b", 4.0, "equal")]


def test_fractions_must_cover_mass(spark):
    cells = spark.createDataFrame([(1, 5.0), (2, 1.0)], "g int, v double")
    frac = spark.createDataFrame([(1, "a", 0.25), (1, "b", 0.75)], "g int, c string, f double")
    with pytest.raises(FAILED):
        R.apply_fractions(cells, frac, ["g"], "c", "v", "f").collect()
    ok = R.apply_fractions(cells.filter("g = 1"), frac, ["g"], "c", "v", "f")
    assert rows(ok, "c", "v") == [("a", 1.25), ("b", 3.75)]


def test_compiled_rules_equal_the_projections(spark):
    """The same rules as stacked projections, with and without weights; the plan does not grow with the rules."""
    rules = R.parse_rules("a | 1 2 | 3 |\nb | 3 | 4 5 | k > 1\nc | 6 | 1 2 4 | k = 1\nd | 4 | 6 |\ne | 5 | 1 2 3 | k > 0")
    rows = [(k, d, *(float((k * 7 + d * 3 + c * 5) % 11 if (k + c) % 3 else 0) for c in range(1, 7))) for k in range(4) for d in range(5)] + [(None, 0, *[1.0] * 6), (2, 9, *[0.0] * 5, None)]
    df = spark.createDataFrame(rows, "k int, d int, " + ", ".join(f"c{c} double" for c in range(1, 7)))
    weights = F.create_map(F.lit("b"), F.array(F.lit(0.5), F.lit(1.5)), F.lit("e"), F.array(F.lit(2.0), F.lit(0.5), F.lit(0.5)))
    for name in (None, "w"):
        x = df if name is None else df.withColumn("w", weights)
        plain = {(r["k"], r["d"]): [r[f"c{c}"] for c in range(1, 7)] for r in R.apply_move_rules(x, rules, multipliers=name).collect()}
        got = R.compiled_moves(x, ["k", "d"], rules, range(1, 7), multipliers=name)
        for r in got.collect():
            assert r["masses"] == pytest.approx(plain[r["k"], r["d"]], abs=1e-12) and len(r["moved"]) == 5
        depth = lambda n: R.compiled_moves(x, ["k", "d"], rules * n, range(1, 7), multipliers=name)._jdf.queryExecution().optimizedPlan().treeString().count("\n")
        assert depth(1) == depth(20)
    long = R.masses_long(got, ["k", "d"], range(1, 7), "code", "n")
    assert long.filter("k = 2 AND d = 9").count() == 0 and long.filter("k IS NULL").agg(F.sum("n")).first()[0] == pytest.approx(6.0)
    with pytest.raises(ValueError, match="key columns"):
        R.CompiledRules.of(R.parse_rules("x | 1 | 2 | c3 > 0"), range(1, 7))
    with pytest.raises(Exception, match="invalid count"):
        R.compiled_moves(df.withColumn("c1", F.lit(-1.0)), ["k", "d"], rules, range(1, 7)).collect()
