"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: a run without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], ddl: str) -> DataFrame:
    """``mapInArrow`` over column dictionaries: ``fn`` gets and yields {column: values}."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(b.to_pydict() for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def blocks(ids: list, texts: list, most_chars: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """Cut a batch into runs of rows of about ``most_chars`` characters; a null text is empty."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size > most_chars:
            yield ids[start:i], [x or "" for x in texts[start:i]]
            start, size = i, 0
        size += len(t) if t else 0
    if start < len(ids):
        yield ids[start:], [x or "" for x in texts[start:]]


def settled(df: DataFrame, condition) -> DataFrame:
    """Rows that meet ``condition``, which is computed once, above the columns it reads.

    A filter is otherwise moved below the projections and repeats their expressions wherever it
    reads them, which is quadratic for arrays that are indexed.
    """
    return df.withColumns({"_meets": condition, "_drawn": F.rand()}).where(F.col("_meets") & (F.col("_drawn") >= 0)).drop("_meets", "_drawn")


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: The same for Python strings.
LOWER = {i: i + 32 for i in range(65, 91)}
