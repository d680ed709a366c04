"""Bringing differently spelled inputs onto one schema."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import code_text, or_zero


def normalise_token(name: str) -> str:
    """Column-name key without case or punctuation."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


@dataclass(frozen=True)
class Field:
    """One canonical column: accepted spellings, type and whether it must exist."""

    name: str
    aliases: tuple[str, ...] = ()
    dtype: str = "double"
    required: bool = True


def resolve(columns: list[str], spec: Field) -> str | None:
    """First accepted spelling that is present."""
    present: dict[str, str] = {}
    for c in columns:
        present.setdefault(normalise_token(c), c)
    for candidate in (spec.name, *spec.aliases):
        hit = present.get(normalise_token(candidate))
        if hit is not None:
            return hit
    if spec.required:
        raise ValueError(f"no column for '{spec.name}' among {columns}")
    return None


def rename_first(df: DataFrame, name: str, aliases=(), required: bool = True) -> DataFrame:
    hit = resolve(df.columns, Field(name, tuple(aliases), required=required))
    return df if hit is None or hit == name else df.withColumnRenamed(hit, name)


def standardise(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Select the recognised columns only, cast them, and fill absent optional ones.

    The projection is a plain ``select`` over the scan, so columns that are not
    listed are never read.  Text codes are trimmed, upper-cased and blanked.
    """
    out: list[Column] = []
    for f in fields:
        hit = resolve(df.columns, f)
        if hit is None:
            out.append(F.lit(None).cast(f.dtype).alias(f.name))
        elif f.dtype == "string":
            out.append(code_text(F.col(f"`{hit}`")).alias(f.name))
        else:
            c = F.col(f"`{hit}`")
            # through double, so that "7.0" and "7" are both a code
            if f.dtype in ("int", "bigint"):
                c = c.try_cast("double")
            out.append(c.try_cast(f.dtype).alias(f.name))
    return df.select(*out)


@dataclass(frozen=True)
class CellSchema:
    """Keys and measure of a table of count cells."""

    keys: tuple[str, ...]
    value: str = "value"
    aliases: tuple[str, ...] = field(default=())

    def canonical(self, df: DataFrame, residue: float = 1e-12) -> DataFrame:
        """Sum any accepted measure name onto the key; residue becomes zero."""
        df = rename_first(df, self.value, self.aliases)
        total = F.sum(or_zero(self.value))
        return df.groupBy(*self.keys).agg(
            F.when(F.abs(total) < residue, F.lit(0.0)).otherwise(total).alias(self.value)
        )


def finalise_cells(df: DataFrame, schema: CellSchema, key_type: str = "int") -> DataFrame:
    """Stage-boundary form: cast keys, and fail the job on a missing or negative entry."""
    bad = F.lit(False)
    for k in schema.keys:
        bad = bad | F.col(k).isNull()
    value = F.col(schema.value).cast("double")
    bad = bad | value.isNull() | F.isnan(value) | (value < 0)
    checked = F.when(
        bad, F.raise_error(F.lit("stage output has a missing key or an invalid measure")).cast("double")
    ).otherwise(value)
    return df.select(*[F.col(k).cast(key_type).alias(k) for k in schema.keys], checked.alias(schema.value))
