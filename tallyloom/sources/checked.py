"""Stores that carry checksums, and stores that join in place."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.operators.validate import exact_differences

# ---------------------------------------------------------------- checksums


def _row_hash(columns, seed: int) -> Column:
    """A hash of a row in which a missing value differs from no value at all."""
    return F.xxhash64(F.lit(seed), *[h for c in columns for h in (F.col(c).isNull(), F.col(c))])


def write_checked(df: DataFrame, path: str, keys, buckets: int = 256) -> None:
    """Write ``df`` by hash buckets of its keys, with the row count and checksums of every bucket beside it.

    A checksum is a sum of row hashes, so it depends neither on the order nor on the files, repeated rows count, and the
    checksum of any union of buckets is the sum of theirs.  Two hashes of 64 bits are kept.
    """
    if "bucket" in df.columns:
        raise ValueError("a column is named bucket")
    out = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    # a bucket of a frequent key is written by several tasks
    spread = out.withColumn("_salt", F.pmod(_row_hash(df.columns, 0), F.lit(4)))
    spread.repartition("bucket", "_salt").drop("_salt").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(out.schema).parquet(f"{path}/rows")
    sums = [F.sum(_row_hash(df.columns, n).cast("decimal(20,0)")).alias(f"checksum_{n}") for n in (1, 2)]
    check = stored.groupBy("bucket").agg(F.count("*").alias("rows"), *sums)
    # a row of its own holds the facts of the store, which may have no rows
    zero = F.lit(0).cast("decimal(30,0)")
    store = df.sparkSession.range(1).select(F.lit(-1).alias("bucket"), F.lit(0).cast("bigint").alias("rows"), zero.alias("checksum_1"), zero.alias("checksum_2"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    check = check.unionByName(store).withColumns({"buckets": F.lit(buckets), "shape": F.lit(shape)})
    check.write.mode("overwrite").parquet(f"{path}/checks")


def differing_buckets(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Buckets whose count or checksum differs, from the checksums alone; empty for equal stores.

    Both stores must have the same columns, keys and number of buckets.
    """
    l, r = (spark.read.parquet(f"{p}/checks") for p in (left, right))
    shapes = l.select("buckets", "shape").unionByName(r.select("buckets", "shape")).distinct()
    if shapes.count() > 1:
        raise ValueError("the stores differ in columns or in the number of buckets")
    facts = ["bucket", "rows", "checksum_1", "checksum_2"]
    signed = l.select(*facts).unionByName(r.select(*facts))
    # a bucket that both stores hold alike occurs twice
    alike = signed.groupBy(*facts).count().filter("count = 2").select("bucket")
    return signed.select("bucket").distinct().join(alike, "bucket", "left_anti")


def stored_differences(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Rows whose multiplicity differs between two stores, with a signed count; only buckets that differ are read.

    The bucket numbers, at most as many as there are buckets, become a filter on the partitions.
    """
    wanted = [row["bucket"] for row in differing_buckets(spark, left, right).collect()]
    shape = spark.read.parquet(f"{left}/checks").select("shape").first()["shape"]
    schema = StructType.fromDDL(f"{shape}, bucket int")
    l, r = (spark.read.schema(schema).parquet(f"{p}/rows").filter(F.col("bucket").isin(wanted)).drop("bucket") for p in (left, right))
    return exact_differences(l, r)


# ---------------------------------------------------------------- joins in place


def _table_name(path: str) -> str:
    return f"store_{hashlib.md5(path.encode()).hexdigest()}"


def write_joinable(df: DataFrame, path: str, keys, buckets: int) -> DataFrame:
    """Store bucketed and sorted by its keys, one file a bucket; two such stores join without a shuffle.

    The number of buckets fixes the size of a file and must be the same for stores that are to be joined.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).format("parquet").saveAsTable(_table_name(path))
    return df.sparkSession.table(_table_name(path))


def read_joinable(spark: SparkSession, path: str, keys, buckets: int) -> DataFrame:
    """The store that ``write_joinable`` left at ``path``, also for a session whose catalogue does not know it."""
    if not spark.catalog.tableExists(_table_name(path)):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        by, where = ", ".join(f"`{k}`" for k in keys), path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {_table_name(path)} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{where}'"
        )
    return spark.table(_table_name(path))
