"""Queries of this subpackage: name, Spark callable, SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class LlmQuery:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


LLM_QUERIES: dict[str, LlmQuery] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        LLM_QUERIES[name] = LlmQuery(fn, sql)
        return fn

    return wrap
