"""A training-corpus pipeline: toxic and poor documents go, recurring lines and near-duplicates go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage's rows are written as Parquet in the shared folder and read again by the next.
Empty tables pass through every stage; null ids and texts are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import table
from tallyloom.llm.line_templates import dedup_lines
from tallyloom.llm.near_copies import keep_distinct
from tallyloom.llm.packing import pack
from tallyloom.llm.quality_rules import keep_good
from tallyloom.llm.toxicity import drop_toxic, train
from tallyloom.session import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not call toxic."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template stands in an earlier document."""
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash of five-word shingles, exact Jaccard similarity of 0.8 or more."""
    return keep_distinct(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 1024 tokens."""
    import public_tokenizers as vocabularies

    return pack(docs, vocabularies.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash", near_copies),
    ("packing", packing),
]

#: A trained classifier and a tokenizer are not expressible in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
