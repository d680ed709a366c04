"""Proportional redistribution that never gains or loses mass."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from tallyloom.functions.columns import add_all, col, or_zero
from tallyloom.operators.donors import borrow, donor_table
from tallyloom.session import materialise, small_table


def _mass(name: str, missing: str, tolerance: float) -> Column:
    """Checked count: NULL by policy, non-finite or materially negative fails the job."""
    c = F.col(name).cast("double")
    fail = F.raise_error(F.concat(F.lit(f"invalid count in {name}: "), c.cast("string"))).cast("double")
    null_value = F.lit(0.0) if missing == "zero" else F.raise_error(F.lit(f"missing count in {name}")).cast("double")
    bad = F.isnan(c) | (F.abs(c) == float("inf")) | (c < -tolerance)
    return F.when(c.isNull(), null_value).when(bad, fail).otherwise(F.greatest(c, F.lit(0.0)))


def _contract(df: DataFrame, sources: list[str], targets: list[str]) -> None:
    for label, names in (("source", sources), ("target", targets)):
        if not names or len(set(names)) != len(names):
            raise ValueError(f"{label} columns must be present and distinct: {names}")
        absent = [n for n in names if n not in df.columns]
        if absent:
            raise ValueError(f"{label} columns not found: {absent}")
    if set(sources) & set(targets):
        raise ValueError(f"source and target overlap: {sorted(set(sources) & set(targets))}")


def _multipliers(multipliers, n: int) -> list[Column]:
    if multipliers is None:
        return [F.lit(1.0)] * n
    if isinstance(multipliers, Column):
        return [F.element_at(multipliers, i + 1) for i in range(n)]
    values = [float(m) for m in multipliers]
    if len(values) != n or any(not (0 <= m < float("inf")) for m in values) or sum(values) <= 0:
        raise ValueError("multipliers: one finite non-negative value per target, at least one positive")
    mean = sum(values) / n
    return [F.lit(m / mean) for m in values]


def redistribute_columns(
    df: DataFrame, sources, targets, condition: str | Column | None = None, multipliers=None,
    source_action: str = "zero", missing: str = "zero", condition_null: str = "error", tolerance: float = 1e-8,
) -> DataFrame:
    """Move the source columns onto the target columns in proportion to target x multiplier.

    Where every weighted target is zero the multipliers themselves are the shares.
    Works row by row, so it is a projection: no shuffle.  ``multipliers`` is a list
    of numbers or an array column (one set per draw).
    """
    sources, targets = list(sources), list(targets)
    if sources == targets:
        return df
    _contract(df, sources, targets)
    if source_action not in ("zero", "drop"):
        raise ValueError("source_action is 'zero' or 'drop'")
    if source_action == "drop" and condition is not None:
        raise ValueError("sources of a conditional redistribution cannot be dropped")
    if condition_null not in ("error", "exclude", "include"):
        raise ValueError("condition_null is 'error', 'exclude' or 'include'")
    m = _multipliers(multipliers, len(targets))
    if condition is None:
        on = F.lit(True)
    else:
        on = F.expr(condition) if isinstance(condition, str) else condition
        if condition_null == "error":
            on = F.coalesce(on, F.raise_error(F.lit("redistribution condition is NULL")).cast("boolean"))
        else:
            on = F.coalesce(on, F.lit(condition_null == "include"))
    mass = {c: _mass(c, missing, tolerance) for c in sources + targets}
    staged = df.withColumn("_on", on).withColumns(
        {
            "_s": F.when(F.col("_on"), add_all([mass[c] for c in sources])),
            "_w": F.when(F.col("_on"), add_all([mass[c] * k for c, k in zip(targets, m)])),
        }
    )
    total_m = add_all(m)
    new: dict[str, Column] = {}
    for c, k in zip(targets, m):
        share = F.when(F.col("_w") > 0, F.try_divide(mass[c] * k, F.col("_w"))).otherwise(k / total_m)
        new[c] = F.when(F.col("_on"), mass[c] + F.col("_s") * share).otherwise(F.col(c).cast("double"))
    if source_action == "zero":
        for c in sources:
            new[c] = F.when(F.col("_on"), F.lit(0.0)).otherwise(F.col(c).cast("double"))
    out = staged.withColumns(new).drop("_on", "_s", "_w")
    return out.drop(*sources) if source_action == "drop" else out


def redist(df: DataFrame, sources, targets, condition: str | Column | None = None, **options) -> DataFrame:
    """Short form: without a condition the sources disappear, with one they are zeroed in place."""
    return redistribute_columns(
        df, sources, targets, condition, source_action="drop" if condition is None else "zero", **options
    )


def _spread(df: DataFrame, by: list[str], category: str, value: str, targets: list, shares: dict) -> DataFrame:
    """Emit the target grid from per-group target masses ``_t*``, unknown mass ``_u`` and shares."""
    rows = F.array(
        *[F.struct(F.lit(t).alias(category), (F.col(f"_t{i}") + F.col("_u") * shares[t]).alias(value)) for i, t in enumerate(targets)]
    )
    return df.select(*by, F.explode(rows).alias("_r")).select(*by, f"_r.{category}", f"_r.{value}")


def _group_masses(df: DataFrame, by: list[str], category: str, value: str, unknown, targets: list) -> DataFrame:
    """Per group: one mass per target and the unknown mass; partial sums before the shuffle."""
    v, c = or_zero(value), F.col(category)
    sums = [F.coalesce(F.sum(F.when(c == F.lit(t), v)), F.lit(0.0)).alias(f"_t{i}") for i, t in enumerate(targets)]
    unk = F.coalesce(F.sum(F.when(c == F.lit(unknown), v)), F.lit(0.0)).alias("_u")
    stray = F.coalesce(F.count_if(c.isNull() | ~c.isin([unknown, *targets])), F.lit(0)).alias("_x")
    grouped = df.groupBy(*by).agg(*sums, unk, stray)
    check = F.when(
        F.col("_x") > 0, F.raise_error(F.lit(f"unexpected codes in {category}")).cast("double")
    ).otherwise(F.col("_u"))
    return grouped.withColumn("_u", check).drop("_x")


def redistribute_unknown(
    df: DataFrame, category: str, value: str, by, unknown, targets, drop_zero: bool = False
) -> DataFrame:
    """Spread the unknown category over the targets by each group's known shares.

    A group with nothing known is split equally.  Every group comes out with the
    complete target list.  A single shuffle: the masses are conditional sums.
    """
    by, targets = list(by), list(targets)
    g = _group_masses(df, by, category, value, unknown, targets)
    known = add_all([f"_t{i}" for i in range(len(targets))])
    g = g.withColumn("_k", known)
    shares = {
        t: F.when(F.col("_k") > 0, F.try_divide(F.col(f"_t{i}"), F.col("_k"))).otherwise(1.0 / len(targets))
        for i, t in enumerate(targets)
    }
    out = _spread(g, by, category, value, targets, shares)
    return out.filter(F.abs(value) > 1e-12) if drop_zero else out


def redistribute_with_reference(
    df: DataFrame, category: str, value: str, by, period: str, unknown, targets, reference_periods,
    early_max, drop_zero: bool = False,
) -> DataFrame:
    """Unknown category by reference-period shares early on and by own shares later.

    ``by`` excludes the period.  A reference target that never occurs gets nothing;
    a stratum without any reference mass is split equally.  The reference masses
    come from the same pass, rolled up from the already aggregated groups.
    """
    by, targets = list(by), list(targets)
    g = _group_masses(df, [*by, period], category, value, unknown, targets)
    n = len(targets)
    ref = (
        g.filter(F.col(period).isin(list(reference_periods)))
        .groupBy(*by)
        .agg(*[F.sum(f"_t{i}").alias(f"_r{i}") for i in range(n)])
    )
    g = g.join(ref, by, "left")
    g = g.withColumns(
        {
            "_k": add_all([f"_t{i}" for i in range(n)]),
            "_rk": add_all([F.coalesce(F.col(f"_r{i}"), F.lit(0.0)) for i in range(n)]),
        }
    )
    shares = {}
    for i, t in enumerate(targets):
        own = F.when(F.col("_k") > 0, F.try_divide(F.col(f"_t{i}"), F.col("_k"))).otherwise(1.0 / n)
        pooled = F.when(F.col("_rk") > 0, F.try_divide(F.coalesce(F.col(f"_r{i}"), F.lit(0.0)), F.col("_rk"))).otherwise(1.0 / n)
        shares[t] = F.when(F.col(period) <= early_max, pooled).otherwise(own)
    out = _spread(g, [*by, period], category, value, targets, shares)
    return out.filter(F.abs(value) > 1e-12) if drop_zero else out


# ---------------------------------------------------------------- ordered rules


@dataclass(frozen=True)
class MoveRule:
    """Sources move onto targets where the SQL condition holds."""

    rule_id: str
    sources: tuple
    targets: tuple
    condition: str | None = None


def parse_rules(text: str) -> list[MoveRule]:
    """Rules from ``id | sources | targets | condition`` lines; ``a:b`` is a code range."""
    rules = []
    for line in text.strip().splitlines():
        rule_id, src, tgt, cond = (p.strip() for p in line.split("|"))
        rules.append(MoveRule(rule_id, codes_of(src), codes_of(tgt), cond or None))
    return rules


def codes_of(text: str) -> tuple[int, ...]:
    out: list[int] = []
    for part in text.split():
        lo, _, hi = part.partition(":")
        out += range(int(lo), int(hi or lo) + 1)
    return tuple(out)


def move_batches(rules, prefix: str = "c") -> list[list[MoveRule]]:
    """Neighbouring rules that touch disjoint codes, which can share one projection."""
    out, touched = [], set()
    for r in rules:
        codes = set(r.sources) | set(r.targets)
        named = {int(c) for c in re.findall(rf"\b{prefix}(\d+)\b", r.condition or "")}
        if not out or (codes | named) & touched:
            out.append([])
            touched = set()
        out[-1].append(r)
        touched |= codes
    return out


def apply_move_rules(df: DataFrame, rules, prefix: str = "c", multipliers: str | None = None) -> DataFrame:
    """Apply rules in order on wide cells; a rule sees what earlier rules moved.

    A fold of projections over one row per cell: nothing is shuffled.  Counts are
    checked once at the start, and rules over disjoint codes share a projection.
    ``multipliers`` names an optional ``map<rule_id, array<double>>`` column with one
    positive weight per target (stochastic allocation).
    """
    rules = list(rules)
    for r in rules:
        _contract(df, [f"{prefix}{c}" for c in r.sources], [f"{prefix}{c}" for c in r.targets])
    involved = dict.fromkeys(f"{prefix}{c}" for r in rules for c in (*r.sources, *r.targets))
    df = df.withColumns({c: _mass(c, "zero", 1e-8) for c in involved})
    names = df.columns
    for batch in move_batches(rules, prefix):
        staged, new = [], {}
        for k, r in enumerate(batch):
            src, tgt = [f"{prefix}{c}" for c in r.sources], [f"{prefix}{c}" for c in r.targets]
            on = f"coalesce({r.condition}, false)" if r.condition else "true"
            staged.append(f"CASE WHEN {on} THEN {' + '.join(src)} ELSE 0D END AS _s{k}")
            for c in src:
                new[c] = f"CASE WHEN {on} THEN 0D ELSE {c} END"
            if len(tgt) == 1:
                new[tgt[0]] = f"{tgt[0]} + _s{k}"
                continue
            n = len(tgt)
            weight = ["1D"] * n
            total = f"{n}D"
            if multipliers is not None:
                ones = ", ".join(["1D"] * n)
                staged.append(f"coalesce(try_element_at({multipliers}, '{r.rule_id}'), array({ones})) AS _m{k}")
                weight = [f"_m{k}[{i}]" for i in range(n)]
                total = "(" + " + ".join(weight) + ")"
            mass = " + ".join(t if w == "1D" else f"{t} * {w}" for t, w in zip(tgt, weight))
            # the weights are a staged column, so they are read from it in the next step
            new[f"_w{k}"] = mass
            for t, w in zip(tgt, weight):
                new[t] = f"{t} + _s{k} * CASE WHEN _w{k} > 0 THEN try_divide({t} * {w}, _w{k}) ELSE {w} / {total} END"
        sums = [f"{e} AS {c}" for c, e in new.items() if c.startswith("_w")]
        df = df.selectExpr(*names, *staged)
        if sums:
            df = df.selectExpr("*", *sums)
        df = df.selectExpr(*[f"{new[c]} AS {c}" if c in new else c for c in names])
    return df


@dataclass(frozen=True)
class CompiledRules:
    """Ordered rules as index arrays over a fixed list of codes; conditions read key columns and are evaluated beforehand."""

    codes: tuple[int, ...]
    conditions: tuple[str, ...]
    steps: tuple[tuple[list[int], list[int], int | None], ...]  # places of sources and targets, condition
    rule_ids: tuple[str, ...]

    @staticmethod
    def of(rules, codes, prefix: str = "c") -> "CompiledRules":
        place = {c: k for k, c in enumerate(codes)}
        conditions = tuple(dict.fromkeys(r.condition for r in rules if r.condition))
        steps = []
        for r in rules:
            if r.condition and re.search(rf"\b{prefix}\d+\b", r.condition):
                raise ValueError(f"rule {r.rule_id}: a compiled condition reads key columns only")
            if set(r.sources) & set(r.targets):
                raise ValueError(f"rule {r.rule_id}: a source is a target")
            steps.append(([place[c] for c in r.sources], [place[c] for c in r.targets], conditions.index(r.condition) if r.condition else None))
        return CompiledRules(tuple(codes), conditions, tuple(steps), tuple(r.rule_id for r in rules))

    def move(self, mass: np.ndarray, on: np.ndarray, weights: list[np.ndarray | None]) -> np.ndarray:
        """Act on ``mass`` (cells x codes) in place, rule by rule; returns what each rule moved (cells x rules)."""
        moved = np.zeros((len(mass), len(self.steps)))
        for k, (sources, targets, condition) in enumerate(self.steps):
            act = slice(None) if condition is None else np.flatnonzero(on[:, condition])
            own = mass[act]
            taken = own[:, sources].sum(axis=1)
            own[:, sources] = 0.0
            if len(targets) == 1:
                own[:, targets[0]] += taken
            else:
                w = np.ones((len(own), len(targets))) if weights[k] is None else weights[k][act]
                at = own[:, targets]
                scaled = at * w
                total = scaled.sum(axis=1, keepdims=True)
                share = np.where(total > 0, scaled / np.where(total > 0, total, 1.0), w / w.sum(axis=1, keepdims=True))
                own[:, targets] = at + taken[:, None] * share
            mass[act] = own
            moved[act, k] = taken
        return moved


def compiled_moves(wide: DataFrame, keys, rules, codes, prefix: str = "c", multipliers: str | None = None, tolerance: float = 1e-8) -> DataFrame:
    """The ordered rules on wide cells as one narrow step: (keys, masses, moved).

    ``masses`` holds a value for each of ``codes``, ``moved`` what each rule took from its sources. The plan is
    the same for any number of rules: conditions become one array of flags, and a batch of cells is a matrix on which each
    rule is a few vector operations.
    """
    keys, codes = list(keys), list(codes)
    plan = CompiledRules.of(list(rules), codes, prefix)
    flags = F.array(*[F.coalesce(F.expr(c), F.lit(False)) for c in plan.conditions]).cast("array<boolean>")
    own = F.array().cast("array<array<double>>")
    if multipliers is not None:
        own = F.array(*[F.coalesce(F.try_element_at(multipliers, F.lit(i)), F.array().cast("array<double>")) for i in plan.rule_ids])
    x = wide.select(*keys, F.array(*[or_zero(f"{prefix}{c}") for c in codes]).alias("masses"), flags.alias("_on"), own.alias("_w"))
    schema = StructType([*x.select(*keys).schema.fields, *StructType.fromDDL("masses array<double>, moved array<double>").fields])

    def matrix(column: pa.Array, width: int) -> np.ndarray:
        return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), width)

    def lists(a: np.ndarray) -> pa.Array:
        offsets = np.arange(0, a.size + 1, a.shape[1], dtype=np.int32) if a.shape[1] else np.zeros(len(a) + 1, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(a).reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = dict(zip(b.schema.names, b.columns))
            mass = matrix(column["masses"], len(plan.codes)).copy()
            if not (mass >= -tolerance).all() or np.isinf(mass).any():  # a NaN fails the comparison
                raise ValueError("invalid count in a cell")
            np.maximum(mass, 0.0, out=mass)
            weights: list[np.ndarray | None] = [None] * len(plan.steps)
            if multipliers is not None:
                rows = column["_w"].to_pylist()
                for k, (_, targets, _) in enumerate(plan.steps):
                    if len(targets) > 1:
                        weights[k] = np.array([r[k] or [1.0] * len(targets) for r in rows]).reshape(len(rows), len(targets))
            moved = plan.move(mass, matrix(column["_on"], len(plan.conditions)), weights)
            yield pa.RecordBatch.from_arrays([*[column[k] for k in keys], lists(mass), lists(moved)], names=[*keys, "masses", "moved"])

    return x.mapInArrow(run, schema)


def masses_long(moved: DataFrame, keys, codes, code: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """One row per cell and code with a mass, of ``compiled_moves``."""
    names = F.array(*[F.lit(c) for c in codes])
    long = moved.select(*keys, F.posexplode("masses").alias("_at", value)).filter(F.abs(value) > tolerance)
    return long.select(*keys, F.element_at(names, F.col("_at") + 1).alias(code), value)


def moved_by_rule(df: DataFrame, rules, by=(), prefix: str = "c", multipliers: str | None = None) -> DataFrame:
    """Mass that each rule moves when the rules act in order: (by, step, rule_id, targets, cells, moved).

    The fold notes what every rule takes from its sources before it acts; the notes are summed once.
    """
    rules, by = list(rules), list(by)
    notes = []
    for k, r in enumerate(rules):
        on = f"coalesce({r.condition}, false)" if r.condition else "true"
        taken = " + ".join(f"coalesce({prefix}{c}, 0D)" for c in r.sources)
        df = apply_move_rules(df.withColumn(f"_moved_{k}", F.expr(f"CASE WHEN {on} THEN {taken} ELSE 0D END")), [r], prefix, multipliers)
        notes.append(F.struct(F.lit(k + 1).alias("step"), F.lit(r.rule_id).alias("rule_id"), F.lit(len(r.targets)).alias("targets"),
            F.count_if(F.col(f"_moved_{k}") > 0).alias("cells"), F.sum(f"_moved_{k}").alias("moved")))
    return df.groupBy(*by).agg(F.array(*notes).alias("_n")).select(*by, F.inline("_n"))


# ---------------------------------------------------------------- plausibility and envelopes


@dataclass(frozen=True)
class ExclusionRule:
    """Codes that cannot occur where the SQL condition holds."""

    codes: tuple
    condition: str
    reason: str = "excluded"


def excluded(code: str, rules) -> Column:
    """True where a (code, cell) pair is implausible."""
    out = F.lit(False)
    for r in rules:
        out = out | (F.col(code).isin(list(r.codes)) & F.coalesce(F.expr(r.condition), F.lit(False)))
    return out


def exclusion_reasons(code: str, rules, none: str = "not identified") -> Column:
    """All reasons that apply, joined in rule order."""
    reasons = F.array_compact(
        F.array(
            *[
                F.when(F.col(code).isin(list(r.codes)) & F.coalesce(F.expr(r.condition), F.lit(False)), F.lit(r.reason))
                for r in rules
            ]
        )
    )
    return F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(none)


def valid_code_array(codes, rules) -> Column:
    """Codes of a list that no exclusion rule rejects in the current row."""
    picks = []
    for c in codes:
        bad = F.lit(False)
        for r in rules:
            if c in r.codes:
                bad = bad | F.coalesce(F.expr(r.condition), F.lit(False))
        picks.append(F.when(~bad, F.lit(c)))
    return F.array_compact(F.array(*picks))


@dataclass
class EnvelopeResult:
    """Cells after plausibility and renormalisation, and the fallback audit."""

    cells: DataFrame
    fallback: DataFrame
    sources: DataFrame


def renormalise_envelopes(
    cells: DataFrame, keys, code: str, value: str, envelopes: dict[str, list], rules, levels: dict[str, list[str]],
    tolerance: float = 1e-12, equal_codes: dict[str, list] | None = None,
) -> EnvelopeResult:
    """Zero implausible causes, then restore each cell's envelope totals.

    Surviving causes are scaled to the total before zeroing.  A cell whose envelope
    lost everything borrows the composition of the first donor level with mass;
    donors are read from the scaled table, before any borrowing, so row order is
    irrelevant.  The last resort is an equal split over causes that are valid there.
    """
    keys = list(keys)
    label = F.lit(None).cast("string")
    for name, codes in envelopes.items():
        label = F.when(F.col(code).isin(list(codes)), F.lit(name)).otherwise(label)
    flagged = cells.select(*keys, code, or_zero(value).alias("_before")).withColumns(
        {"_env": label, "_after": F.when(excluded(code, rules), F.lit(0.0)).otherwise(F.col("_before"))}
    )
    w = W.partitionBy(*keys, "_env")  # at most one row per cause
    totals = flagged.withColumns({"_tb": F.sum("_before").over(w), "_ta": F.sum("_after").over(w)})
    lost = F.col("_env").isNotNull() & (F.col("_tb") > tolerance) & (F.col("_ta") <= tolerance)
    scaled = F.when(
        F.col("_env").isNotNull() & (F.col("_tb") > tolerance) & (F.col("_ta") > tolerance),
        F.col("_after") * F.try_divide(F.col("_tb"), F.col("_ta")),
    ).otherwise(F.col("_after"))
    state = totals.select(*keys, code, "_env", "_before", "_tb", lost.alias("_lost"), scaled.alias(value))
    # kept cells, needy cells and donors all read this table: write it once
    state = materialise(state, "envelope-state")
    kept = state.filter("not _lost").select(*keys, code, value)
    filled, audit = None, None
    for name, codes in envelopes.items():
        part = state.filter(F.col("_env") == name)
        need = part.filter("_lost").select(*keys, F.col("_tb").alias("restored")).distinct()
        table = donor_table(part, levels, code, codes, value)
        allowed = valid_code_array((equal_codes or {}).get(name, codes), rules)
        got = borrow(need, table, levels, code, codes, tolerance, "equal_valid_causes", allowed)
        rows = got.select(*keys, code, (F.col("restored") * F.col("donor_share")).alias(value))
        note = got.select(
            *keys, F.lit(name).alias("envelope"), "donor_level", "donor_total", "valid_targets", "restored"
        ).distinct()
        filled = rows if filled is None else filled.unionByName(rows)
        audit = note if audit is None else audit.unionByName(note)
    sources = (
        state.filter(F.col("_lost") & (F.col("_before") > tolerance))
        .withColumn("exclusion_reason", exclusion_reasons(code, rules))
        .select(*keys, code, F.col("_before").alias("precheck"), "exclusion_reason")
    )
    return EnvelopeResult(kept.unionByName(filled), audit, sources)


def redistribute_named_source(
    df: DataFrame, strata, code: str, value: str, source, targets, levels: dict[str, list[str]] | None = None,
    tolerance: float = 1e-12,
) -> DataFrame:
    """Move one code onto targets by the stratum's own shares, else by the first donor level."""
    strata, targets = list(strata), list(targets)
    g = _group_masses(df, strata, code, value, source, targets)
    g = g.withColumn("_k", add_all([f"_t{i}" for i in range(len(targets))]))
    own = _spread(
        g.filter((F.col("_k") > tolerance) | F.lit(levels is None)), strata, code, value, targets,
        {
            t: F.when(F.col("_k") > tolerance, F.try_divide(F.col(f"_t{i}"), F.col("_k"))).otherwise(1.0 / len(targets))
            for i, t in enumerate(targets)
        },
    )
    if levels is None:
        return own.withColumn("share_level", F.lit("own"))
    table = donor_table(df, levels, code, targets, value)
    need = g.filter(F.col("_k") <= tolerance).select(*strata, F.col("_u").alias("_mass_in"))
    got = borrow(need, table, levels, code, targets, tolerance)
    lent = got.select(*strata, code, (F.col("_mass_in") * F.col("donor_share")).alias(value), F.col("donor_level").alias("share_level"))
    return own.withColumn("share_level", F.lit("own")).unionByName(lent)


def expand_by_shares(
    totals: DataFrame, shares: DataFrame, by, spread, value: str, weight: str, levels: dict[str, list],
    effective: str | None = None,
) -> DataFrame:
    """Split totals over finer dimensions by donor weights, equally where there are none.

    The result holds every combination of the supplied finer levels, and the parts
    add up to the total (and the effective size, if named, is split the same way).
    """
    by, spread = list(by), list(spread)
    n = 1
    for d in spread:
        n *= len(levels[d])
    grid = totals
    for d in spread:
        grid = grid.withColumn(d, F.explode(F.array(*[F.lit(v) for v in levels[d]])))
    donors = shares.groupBy(*by, *spread).agg(F.sum(or_zero(weight)).alias("_w"))
    totals_w = donors.groupBy(*by).agg(F.sum("_w").alias("_tw"))
    joined = grid.join(donors, [*by, *spread], "left").join(totals_w, by, "left")
    share = F.when(F.col("_tw") > 0, F.coalesce(F.col("_w"), F.lit(0.0)) / F.col("_tw")).otherwise(1.0 / n)
    cols = {value: col(value) * share, "share": share}
    cols["share_source"] = F.when(F.col("_tw") > 0, "donor").otherwise("equal")
    if effective:
        cols[effective] = F.col(effective) * share
    return joined.withColumns(cols).drop("_w", "_tw")


def allocate_effective_n(df: DataFrame, strata, within, value: str, effective: str) -> DataFrame:
    """Split a group's effective sample size over its strata in proportion to their mass."""
    mass = df.groupBy(*within, *strata).agg(F.sum(or_zero(value)).alias("_m"), F.max(effective).alias("_n"))
    tot = mass.groupBy(*within).agg(F.sum("_m").alias("_tm"), F.count("*").alias("_c"), F.max("_n").alias("_n"))
    out = mass.drop("_n").join(tot, list(within), "left")
    share = F.when(F.col("_tm") > 0, F.col("_m") / F.col("_tm")).otherwise(1.0 / F.col("_c"))
    return out.select(*within, *strata, F.col("_m").alias(value), (F.col("_n") * share).alias(effective))


def apply_fractions(cells: DataFrame, fractions: DataFrame, keys, code: str, value: str, fraction: str) -> DataFrame:
    """Replace a composition: cell total times fraction, failing where no fraction covers a cell."""
    total = cells.groupBy(*keys).agg(F.sum(or_zero(value)).alias("_t"))
    f = fractions.select(*keys, code, F.col(fraction).alias("_f"))
    out = total.join(f, list(keys), "left")
    v = F.when(
        F.col("_f").isNull() & (F.col("_t") > 0),
        F.raise_error(F.lit("a cell with mass has no fractions")).cast("double"),
    ).otherwise(F.col("_t") * F.col("_f"))
    return out.filter(F.col("_f").isNotNull() | (F.col("_t") > 0)).select(*keys, code, v.alias(value))
