"""Ordered predicate-to-assignment rules over records."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import date_of, icd_category, text_between, top_missing


@dataclass(frozen=True)
class Rule:
    """Where the SQL condition holds, assign SQL values to columns."""

    condition: str
    assign: tuple[tuple[str, str], ...]

    @staticmethod
    def of(condition: str, **assign: str) -> "Rule":
        return Rule(condition, tuple(assign.items()))


def _reads(text: str, columns: set[str]) -> set[str]:
    return set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)) & columns


def batches(rules: list[Rule], columns) -> list[list[Rule]]:
    """Split rules where one would read what an earlier rule of its batch wrote."""
    names, out, written = set(columns), [], set()
    for r in rules:
        text = r.condition + " " + " ".join(v for _, v in r.assign)
        if not out or _reads(text, names) & written:
            out.append([])
            written = set()
        out[-1].append(r)
        written |= {c for c, _ in r.assign}
        names |= written
    return out


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Apply rules in order; each sees the result of earlier ones, the last match wins.

    Independent neighbours share one projection, so the plan has one step per real
    dependency rather than one per rule.
    """
    for batch in batches(rules, df.columns):
        new: dict[str, Column] = {}
        for r in batch:
            for name, value in r.assign:
                current = new.get(name, F.col(name) if name in df.columns else F.lit(None))
                new[name] = F.when(F.expr(r.condition), F.expr(value)).otherwise(current)
        df = df.withColumns(new)
    return df


def in_ranges(column: str, text: str) -> str:
    """SQL test of a code column against ``"C15 C18-C21"``; NULL counts as outside."""
    parts = []
    for p in text.split():
        lo, _, hi = p.partition("-")
        parts.append(f"{column} BETWEEN '{lo}' AND '{hi}'" if hi else f"{column} = '{lo}'")
    return "coalesce(" + " OR ".join(parts) + ", false)"


def in_numbers(column: str, text: str) -> str:
    """SQL test of a numeric column against ``"14-19 30"``; NULL counts as outside."""
    parts = []
    for p in text.split():
        lo, _, hi = p.partition("-")
        parts.append(f"{column} BETWEEN {lo} AND {hi}" if hi else f"{column} = {lo}")
    return "coalesce(" + " OR ".join(parts) + ", false)"


@dataclass(frozen=True)
class CodeOverride:
    """A category whose class depends on age: SQL over ``_age`` and ``_u5`` (missing is +infinity)."""

    categories: tuple[str, ...]
    condition: str
    value: int


def map_codes(
    df: DataFrame, cause: str, lookup: DataFrame, output: str, overrides: list[CodeOverride], blank: int,
    age: str | None = None, under_five: str | None = None, key: str = "category", target: str = "code",
) -> DataFrame:
    """Static category lookup, a default for blanks, then age-dependent overrides in order."""
    if overrides and (age is None or under_five is None):
        raise ValueError("age-dependent overrides need the age columns")
    x = df.withColumn("_k", icd_category(cause))
    x = x.join(lookup.select(F.col(key).alias("_k"), F.col(target).cast("int").alias("_m")), "_k", "left")
    mapped = F.when(F.col("_k").isNull(), F.lit(blank)).otherwise(F.col("_m"))
    if overrides:
        x = x.withColumns({"_age": top_missing(age), "_u5": top_missing(under_five)})
        for o in overrides:
            mapped = F.when(F.col("_k").isin(list(o.categories)) & F.expr(o.condition), F.lit(o.value)).otherwise(mapped)
    return x.withColumn(output, mapped.cast("int")).drop("_k", "_m", "_age", "_u5")


def days_between(death: tuple, birth: tuple, void: Column | None = None) -> Column:
    """Absolute day difference of two dates given in parts; an invalid date or ``void`` gives NULL."""
    d = F.abs(F.datediff(date_of(*death), date_of(*birth)))
    return d if void is None else F.when(~F.coalesce(void, F.lit(False)), d)


def last_field_by_priority(fields: list[str], groups: list[str]) -> Column:
    """First priority group that any field matches; within a group the last field wins."""
    picks = []
    for ranges in groups:
        for f in reversed(fields):
            hit = F.lit(False)
            for p in ranges.split():
                lo, _, hi = p.partition("-")
                hit = hit | text_between(f, lo, hi or lo)
            picks.append(F.when(hit, F.col(f)))
    return F.coalesce(*picks)


def borders_of(rules, *columns: str) -> list[float]:
    """Every number that a condition compares one of the columns with: between two neighbours no condition changes."""
    text = " ".join(r if isinstance(r, str) else r.condition for r in rules)
    compared = re.finditer(rf"\b(?:{'|'.join(columns)})\s*(?:[<>]=?|=|BETWEEN)\s*(\d+)(?:\s+AND\s+(\d+))?", text)
    # the second number belongs to a BETWEEN, or else to a comparison with a number first, which no condition has
    return sorted({float(n) for m in compared for n in m.groups() if n is not None})


def elementary(column: str | Column, borders: list[float]) -> Column:
    """One value for each elementary interval of a number: the border itself, or a value between two neighbours.

    Comparisons with borders come out the same for the value and for what it stands for; the search is a
    balanced tree of comparisons inside generated code. NULL stays NULL.
    """
    c = F.col(column) if isinstance(column, str) else column
    between = [borders[0] - 1.0, *[(a + b) / 2 for a, b in zip(borders, borders[1:])], borders[-1] + 1.0]

    def search(low: int, high: int) -> Column:
        """``c`` lies above border ``low - 1`` and below border ``high``."""
        if low == high:
            return F.lit(between[low])
        middle = (low + high) // 2
        at = F.lit(borders[middle])
        return F.when(c == at, at).when(c < at, search(low, middle)).otherwise(search(middle + 1, high))

    return F.when(c.isNotNull(), search(0, len(borders)))


def count_valid(fields: list[str], lo: str, hi: str) -> Column:
    out = F.lit(0)
    for f in fields:
        out = out + text_between(f, lo, hi).cast("int")
    return out


def remap(column: str, pairs: dict[str, str], residual: str, residual_code: str, where: str) -> list[Rule]:
    """Remap listed codes and send a residual code range to one code, both under a condition.

    The original column is compared, so the two rules cannot feed each other.
    """
    whens = " ".join(f"WHEN {in_ranges(column, src)} THEN '{dst}'" for dst, src in pairs.items())
    listed = " ".join(pairs.values())
    return [
        Rule.of(f"({where}) AND {in_ranges(column, listed)}", uc_recode=f"CASE {whens} END"),
        Rule.of(f"({where}) AND {in_ranges(column, residual)}", uc_recode=f"'{residual_code}'"),
    ]
