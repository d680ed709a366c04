"""Tables by path: format from the extension, explicit schemas for text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TEXT = {"csv": ",", "txt": "\t", "tsv": "\t"}


def _extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else "parquet"


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Parquet, ORC, JSON or delimited text; a directory without extension is parquet.

    Text without a schema is read as strings: no inference pass over the data.
    """
    ext = _extension(path)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if ext in TEXT:
        return reader.option("header", True).option("sep", options.get("sep", TEXT[ext])).csv(path)
    if ext in ("parquet", "orc", "json"):
        return reader.format(ext).load(path)
    raise ValueError(f"unsupported table format: {path}")


def write_table(df: DataFrame, path: str, compression: str = "zstd", partition_by=(), mode: str = "overwrite") -> None:
    """Write by extension with a compression option; Spark's committer makes it atomic."""
    ext = _extension(path)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if ext in TEXT:
        writer.option("header", True).option("sep", TEXT[ext]).csv(path)
    else:
        writer.option("compression", compression).format("parquet" if ext == "parquet" else ext).save(path)
