"""Stage tables: one parquet directory per stem."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException


@dataclass
class StageStore:
    """Checkpoints of pipeline stages under one root; reading back cuts lineage."""

    spark: SparkSession
    root: str
    compression: str = "zstd"

    def path(self, stem: str) -> str:
        return f"{self.root}/{stem}"

    def write(self, df: DataFrame, stem: str, partition_by=(), sort_by=()) -> DataFrame:
        out = df.sortWithinPartitions(*sort_by) if sort_by else df
        writer = out.write.mode("overwrite").option("compression", self.compression)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(stem))
        return self.read(stem)

    def read(self, stem: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stem))

    def exists(self, stem: str) -> bool:
        try:
            self.read(stem)
            return True
        except AnalysisException:
            return False
