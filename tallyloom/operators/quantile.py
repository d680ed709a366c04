"""Weighted quantiles without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.functions.columns import or_zero
from tallyloom.session import materialise


def weighted_quantiles(df: DataFrame, by, value: str, weight: str, probs: dict[str, float], buckets: int = 256) -> DataFrame:
    """Smallest value whose cumulative weight reaches each share of the group's weight.

    Equal values are merged first.  Cumulative weights run inside value buckets and add
    the weight of lower buckets.  The bucket borders are approximate quantiles of all
    values, so they follow a long tail, and they need no shuffle on the group: a dominant
    group is cumulated by as many tasks as there are buckets.  The answer is exact.
    """
    by = list(by)
    v = F.col(value).cast("double")
    x = df.filter(v.isNotNull() & (or_zero(weight) > 0)).groupBy(*by, v.alias("_x")).agg(F.sum(or_zero(weight)).alias("_w"))
    x = materialise(x, "quantile-values")
    borders = x.agg(F.percentile_approx("_x", [k / buckets for k in range(1, buckets)], 10_000).alias("e")).scalar()
    x = x.withColumn("_e", borders).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col("_x")))).drop("_e")
    sizes = x.groupBy(*by, "_b").agg(F.sum("_w").alias("_bw"))
    w = W.partitionBy(*by).orderBy("_b")  # at most `buckets` rows
    offsets = sizes.select(*by, "_b", (F.sum("_bw").over(w) - F.col("_bw")).alias("_off"), F.sum("_bw").over(W.partitionBy(*by)).alias("_t"))
    run = F.sum("_w").over(W.partitionBy(*by, "_b").orderBy("_x").rowsBetween(W.unboundedPreceding, 0))
    c = x.withColumn("_c", run).join(offsets, [*by, "_b"]).withColumn("_c", F.col("_c") + F.col("_off"))
    return c.groupBy(*by).agg(
        *[F.min(F.when(F.col("_c") >= F.col("_t") * p * (1 - 1e-12), F.col("_x"))).alias(n) for n, p in probs.items()]
    )
