"""Partitioned stores for intervals, comparisons and draws, with manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERVAL_PARTITIONS = ["storage_scope", "sex_code", "age_id"]


def write_intervals(df: DataFrame, path: str, partitions=INTERVAL_PARTITIONS) -> None:
    """Interval store with the partition keys in the path.

    Rows are shuffled by partition key plus a salt, so that one large partition is
    written by several tasks and each task opens few files.
    """
    salted = df.withColumn("_salt", F.pmod(F.hash(*[c for c in df.columns if c not in partitions]), F.lit(4)))
    (
        salted.repartition(*partitions, "_salt").drop("_salt")
        .write.mode("overwrite").partitionBy(*partitions).option("compression", "zstd").parquet(path)
    )


def write_domains(df: DataFrame, path: str, domain: str = "domain") -> DataFrame:
    """Domain-partitioned comparison store and its manifest of rows, files and bytes."""
    df.write.mode("overwrite").partitionBy(domain).option("compression", "zstd").parquet(path)
    return manifest(df.sparkSession, path, [domain])


def manifest(spark: SparkSession, path: str, by) -> DataFrame:
    """Rows, files and bytes per key, from the hidden file metadata of the scan."""
    x = spark.read.parquet(path).select(*by, F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
    per_file = x.groupBy(*by, "f").agg(F.count("*").alias("r"), F.max("s").alias("s"))
    return per_file.groupBy(*by).agg(F.sum("r").alias("rows"), F.count("*").alias("files"), F.sum("s").alias("bytes"))


def write_draw_block(df: DataFrame, path: str, block: int) -> None:
    """Append one block of draws; a block that is rerun replaces only itself."""
    out = df.withColumn("draw_block", F.lit(block))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("draw_block").parquet(path)


def pending_blocks(spark: SparkSession, path: str, total: int, per_block: int, first: int = 1) -> DataFrame:
    """Blocks that do not hold exactly their draws: where a restart continues.

    Block b has the ids from ``first + b * per_block`` on; the last block may be short. A block
    with a missing or a foreign id is pending.
    """
    block = F.floor((F.col("draw_id") - first) / per_block).cast("int")
    wanted = spark.range(first, first + total).select(F.col("id").alias("draw_id")).select("draw_id", block.alias("draw_block"))
    have = spark.read.parquet(path).select(F.col("draw_id").cast("bigint").alias("draw_id"), F.col("draw_block").cast("int").alias("draw_block")).distinct()
    keys = ["draw_id", "draw_block"]
    missing = wanted.join(have, keys, "left_anti")
    foreign = have.join(wanted, keys, "left_anti").join(wanted.select("draw_block").distinct(), "draw_block", "left_semi")
    return missing.select("draw_block").unionByName(foreign.select("draw_block")).distinct()


def store_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything was written at ``path``; other file system errors are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def draw_id_differences(draws: DataFrame, expected: int) -> DataFrame:
    """Draw ids that are missing or unexpected against exactly 1..expected."""
    have = draws.select(F.col("draw_id").cast("bigint").alias("draw_id")).distinct()
    want = draws.sparkSession.range(1, expected + 1).withColumnRenamed("id", "draw_id")
    return (
        want.join(have, "draw_id", "left_anti").withColumn("status", F.lit("missing"))
        .unionByName(have.join(want, "draw_id", "left_anti").withColumn("status", F.lit("unexpected")))
    )


def read_csv_stack(spark: SparkSession, path: str, schema: str, file_key: str = "file_name") -> DataFrame:
    """All CSV parts of a directory with the file they came from."""
    return spark.read.schema(schema).option("header", True).csv(path).withColumn(file_key, F.col("_metadata.file_name"))
