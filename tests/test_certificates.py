"""The decision table: elementary intervals, distinct inputs, dates."""

import datetime
import itertools

from pyspark.sql import functions as F

from tallyloom.functions.columns import date_of
from tallyloom.operators import rules
from tallyloom.plans import certificates
from tallyloom.session import generated_apart, small_table


def test_an_elementary_value_stands_for_its_interval(spark):
    borders = rules.borders_of(["x >= 5 AND x < 10", rules.Rule.of("y = 3 AND x BETWEEN 20 AND 30 AND other < 99", z="1"), "x = 7"], "x")
    assert borders == [5.0, 7.0, 10.0, 20.0, 30.0]
    df = spark.createDataFrame([(v,) for v in (None, -3.0, 4.9, 5.0, 6.0, 7.0, 7.5, 10.0, 19.0, 20.0, 25.0, 30.0, 31.0)], "x double")
    for r in df.withColumn("e", rules.elementary("x", borders)).collect():
        x, e = r["x"], r["e"]
        assert (e is None) == (x is None)
        if x is not None:
            assert [(x < b, x == b) for b in borders] == [(e < b, e == b) for b in borders]
    assert df.withColumn("e", rules.elementary("x", borders)).select("e").distinct().count() == 12


def test_age_borders_hold_every_number_of_the_rules():
    assert {0.0, 1.0, 4.0, 5.0, 6.0, 10.0, 20.0, 21.0, 25.0, 55.0, 60.0, 999.0} <= set(certificates.AGE_BORDERS)
    assert certificates.DAY_BORDERS == [0.0, 6.0, 7.0, 28.0, 29.0, 364.0]


def test_impossible_dates_are_missing(spark):
    parts = [(y, m, d) for y, m, d in itertools.product((1900, 2000, 2001), (0, 1, 2, 12, 13, None), (0, 1, 28, 29, 30, 31, 32, None))]
    parts = [tuple(None if v is None else float(v) for v in p) for p in parts]
    for r in spark.createDataFrame(parts, "y double, m double, d double").withColumn("x", date_of("y", "m", "d")).collect():
        try:
            expect = datetime.date(int(r["y"]), int(r["m"]), int(r["d"]))
        except (TypeError, ValueError):
            expect = None
        assert r["x"] == expect


def test_generated_apart_keeps_rows_and_partitions(spark):
    df = spark.range(0, 100, 1, 7)
    out = generated_apart(df)
    assert out.rdd.getNumPartitions() == 7 and out.count() == 100


def test_groups_equal_rules_on_every_record(spark):
    """Collapsing before the rules changes nothing: the records' own decisions give the same counts."""
    schema = "DeathType double, DeathYear double, DeathMonth double, DeathDay double, BirthYear double, BirthMonth double, BirthDay double, AgeYear double, Sex double, Pregnancy double, Popgroup double, Death_Prov double, UnderlyingCause string, CauseA string, CauseB string, CauseC string, CauseD string"
    codes = ["A15", "C53", "C15", "O15", "P23", "P36", "E11", "I10", "R99", "N40", None, "P95", "G30"]
    ages = [0.0, 0.5, 3.0, 9.0, 24.0, 60.0, 999.0, 188.0, None]
    records = []
    for k, (code, age) in enumerate(itertools.product(codes, ages)):
        record = (1.0 + (k % 7 == 0), 2000.0 + k % 10, 5.0, 10.0, 2000.0 + k % 10, 5.0 - k % 5, 1.0 + k % 9, age, 1.0 + k % 3 * 4, 1.0, 1.0, 3.0, code, ["I21", "A15", None][k % 3], ["I64", None][k % 2], None, None)
        records += [record] * (1 + k % 3)
    df = spark.createDataFrame(records, schema)
    lookup = small_table(spark, [("A15", 1), ("C53", 41), ("C15", 30), ("O15", 14), ("P23", 20), ("P36", 21), ("E11", 79), ("I10", 82), ("I21", 83), ("R99", 143), ("N40", 105), ("G30", 69), ("A41", 161)], "category string, code int")
    key = [c for c in certificates.GROUP_KEY if c != "nbdcode"]
    one = rules.map_codes(certificates.verify(df, lookup), "uc_recode", lookup, "nbdcode", certificates.OVERRIDES, certificates.BLANK_CAUSE, "age_", "age_u5")
    expect = sorted((tuple(r) for r in one.groupBy(*key, "nbdcode").agg(F.count("*").cast("double").alias("num")).collect()), key=str)
    got = sorted((tuple(r) for r in certificates.verified_groups(df, lookup).select(*key, "nbdcode", "num").collect()), key=str)
    assert got == expect and sum(r[-1] for r in got) == len(records)
