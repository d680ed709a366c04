"""Stores with checksums, and stores that join in place."""

import uuid

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import views
from tallyloom.session import ensure_checkpoint_dir
from tallyloom.sources import checked


def folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"


def stored(spark, df, buckets=8):
    path = folder(spark)
    checked.write_checked(df, path, ["k"], buckets)
    return path


def numbers(spark, n=200):
    return spark.range(n).select(F.col("id").cast("int").alias("k"), (F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("b"))


def test_equal_stores_are_compared_without_their_rows(spark):
    x = numbers(spark)
    left, right = stored(spark, x), stored(spark, x.repartition(5).orderBy(F.desc("k")))
    assert checked.differing_buckets(spark, left, right).count() == 0
    plan = checked.differing_buckets(spark, left, right)._jdf.queryExecution().executedPlan().toString()
    assert "/rows" not in plan
    assert checked.stored_differences(spark, left, right).count() == 0
    assert checked.stored_differences(spark, left, right).inputFiles() == []


def test_one_changed_cell_reads_one_bucket(spark):
    x = numbers(spark)
    left, right = stored(spark, x), stored(spark, x.withColumn("b", F.when(F.col("k") == 17, -1.0).otherwise(F.col("b"))))
    assert checked.differing_buckets(spark, left, right).count() == 1
    out = checked.stored_differences(spark, left, right)
    assert sorted((r["k"], r["b"], r["surplus"]) for r in out.collect()) == [(17, -1.0, -1), (17, 8.5, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_missing_values_repeated_rows_and_absent_buckets_count(spark):
    schema = "k int, a int, b int"
    base = [(1, None, 2), (2, 5, 5), (None, 1, 1)]
    a = stored(spark, spark.createDataFrame(base, schema))
    swapped = stored(spark, spark.createDataFrame([(1, 2, None), (2, 5, 5), (None, 1, 1)], schema))
    twice = stored(spark, spark.createDataFrame([*base, (2, 5, 5)], schema))
    less = stored(spark, spark.createDataFrame(base[:2], schema))
    empty = stored(spark, spark.createDataFrame([], schema))
    assert checked.stored_differences(spark, a, swapped).count() == 2
    assert [tuple(r) for r in checked.stored_differences(spark, a, twice).collect()] == [(2, 5, 5, -1)]
    assert [tuple(r) for r in checked.stored_differences(spark, a, less).collect()] == [(None, 1, 1, 1)]
    assert checked.stored_differences(spark, empty, a).count() == 3
    with pytest.raises(ValueError):
        checked.stored_differences(spark, a, stored(spark, spark.createDataFrame(base, schema), buckets=4))


def test_intervals_attach_without_an_exchange(spark):
    x = numbers(spark)
    limits = x.filter("k % 2 = 0").select("k", "a", F.lit(1.0).alias("lower"), F.lit(2.0).alias("upper"), F.lit(9).alias("n_draws"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paths = folder(spark), folder(spark)
        checked.write_joinable(x, paths[0], ["k", "a"], 4)
        checked.write_joinable(limits, paths[1], ["k", "a"], 4)
        # as another session does, whose catalogue knows nothing
        for p in paths:
            spark.sql(f"DROP TABLE {checked._table_name(p)}")
        points, ivs = (checked.read_joinable(spark, p, ["k", "a"], 4) for p in paths)
        out = views.attach_intervals(points, ivs, ["k", "a"], F.col("a") == 0, "b")
        got = {r["k"]: (r["lower"], r["upper"], r["n_draws"]) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert len(got) == 200 and got[4] == (1.0, 2.0, 9) and got[5] == (None, None, None)
