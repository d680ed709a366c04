"""The input contract: what must be present, and whether it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators.schema import Field, resolve
from tallyloom.sources.tabular import read_table
from tallyloom.session import small_table


@dataclass(frozen=True)
class Input:
    key: str
    path: str
    fields: tuple[Field, ...] = ()
    required: bool = True


def manifest(spark: SparkSession, inputs: list[Input]) -> DataFrame:
    rows = [(i.key, i.path, i.required, ",".join(f.name for f in i.fields)) for i in inputs]
    return small_table(spark, rows, "key string, path string, required boolean, columns string")


def readiness(spark: SparkSession, inputs: list[Input]) -> DataFrame:
    """One row per input: ready or the first problem.  Reads schemas, not data."""
    rows = []
    for i in inputs:
        issue = ""
        try:
            columns = read_table(spark, i.path).columns
            for f in i.fields:
                resolve(columns, f)
        except AnalysisException:
            issue = "not readable" if i.required else "absent (optional)"
        except ValueError as e:
            issue = str(e).split(" among ")[0]
        rows.append((i.key, issue == "" or issue.endswith("(optional)"), issue))
    return small_table(spark, rows, "key string, ready boolean, issue string")
