"""Unknown categories, reference periods, ordered rules, envelopes and donors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import aggregate, compose, grid, redistribute, validate
from tallyloom.plans import study
from tallyloom.queries.inputs import (
    LINES_PART, PRIORITIES, P_TYPES, UNKNOWN_PRIORITY, cells_sql, in_list, lines_part, order_cells, table, values,
)
from tallyloom.queries.registry import query, rounded

KNOWN = in_list(PRIORITIES)

_R4 = f"""grp AS (SELECT region, yr, coalesce(sum(n) FILTER (priority IN {KNOWN}), 0) AS k,
    coalesce(sum(n) FILTER (priority = '{UNKNOWN_PRIORITY}'), 0) AS u FROM cells GROUP BY region, yr),
  red AS (SELECT g.region, g.yr, t.priority,
    coalesce(c.n, 0) + g.u * CASE WHEN g.k > 0 THEN coalesce(c.n, 0) / g.k ELSE 0.25 END AS n
    FROM grp g CROSS JOIN {values([(p,) for p in PRIORITIES], 'priority').replace('AS v', 'AS t')}
    LEFT JOIN cells c ON c.region = g.region AND c.yr = g.yr AND c.priority = t.priority)"""


def redistributed_orders(spark, sf):
    cells = order_cells(spark, sf, "region", "yr", "priority")
    return redistribute.redistribute_unknown(cells, "priority", "n", ["region", "yr"], UNKNOWN_PRIORITY, PRIORITIES)


@query(
    "redistribute_unknown_priority", "R4 J7 A1 S1 J1",
    f"WITH {cells_sql('region', 'yr', 'priority')}, {_R4} SELECT region, yr, priority, round(n, 6) AS n FROM red",
)
def redistribute_unknown_priority(spark, sf):
    return rounded(redistributed_orders(spark, sf))


@query(
    "priority_share_after_redistribution", "W1 R4",
    f"""WITH {cells_sql('region', 'yr', 'priority')}, {_R4}
    SELECT region, yr, priority, round(n, 6) AS n, round(n / sum(n) OVER (PARTITION BY region, yr), 6) AS share FROM red""",
)
def priority_share(spark, sf):
    return rounded(compose.share(redistributed_orders(spark, sf), ["region", "yr"], "n"))


@query(
    "redistribution_group_totals", "V7 V5",
    f"""WITH {cells_sql('region', 'yr', 'priority')}, {_R4},
    b AS (SELECT region, yr, sum(n) AS before FROM cells GROUP BY ALL), a AS (SELECT region, yr, sum(n) AS after FROM red GROUP BY ALL)
    SELECT region, yr, round(before, 6) AS before, round(after, 6) AS after,
      round(abs(before - after) / greatest(1.0, abs(before), abs(after)), 6) AS error
    FROM b JOIN a USING (region, yr)""",
)
def redistribution_group_totals(spark, sf):
    cells = order_cells(spark, sf, "region", "yr", "priority")
    return rounded(validate.group_errors(cells, redistributed_orders(spark, sf), ["region", "yr"], "n"))


_WIDE = f"""wide AS (SELECT region, yr, {', '.join(f"coalesce(sum(n) FILTER (priority = '{p}'), 0) AS p{p[0]}" for p in PRIORITIES + [UNKNOWN_PRIORITY])}
    FROM cells GROUP BY region, yr)"""


def wide_priorities(spark, sf):
    cells = order_cells(spark, sf, "region", "yr", "priority").withColumn("p", F.substring("priority", 1, 1))
    return grid.pivot_codes(cells, ["region", "yr"], "p", ["1", "2", "3", "4", "5"], "n", prefix="p")


@query(
    "redistribute_wide_with_multipliers", "R1 R3",
    f"""WITH {cells_sql('region', 'yr', 'priority')}, {_WIDE}, w AS (SELECT *, p1 * 1 + p2 * 2 + p3 * 3 AS t FROM wide)
    SELECT region, yr, round(p1 + p4 * CASE WHEN t > 0 THEN p1 * 1 / t ELSE 1.0 / 6 END, 6) AS p1,
      round(p2 + p4 * CASE WHEN t > 0 THEN p2 * 2 / t ELSE 2.0 / 6 END, 6) AS p2,
      round(p3 + p4 * CASE WHEN t > 0 THEN p3 * 3 / t ELSE 3.0 / 6 END, 6) AS p3, round(p5, 6) AS p5 FROM w""",
)
def redistribute_wide_with_multipliers(spark, sf):
    return rounded(redistribute.redist(wide_priorities(spark, sf), ["p4"], ["p1", "p2", "p3"], multipliers=[1.0, 2.0, 3.0]))


@query(
    "redistribute_wide_conditional", "R2 R1",
    f"""WITH {cells_sql('region', 'yr', 'priority')}, {_WIDE}
    SELECT region, yr, round(CASE WHEN yr >= 1998 THEN p1 + (p4 + p5) * CASE WHEN p1 + p2 > 0 THEN p1 / (p1 + p2) ELSE 0.5 END ELSE p1 END, 6) AS p1,
      round(CASE WHEN yr >= 1998 THEN p2 + (p4 + p5) * CASE WHEN p1 + p2 > 0 THEN p2 / (p1 + p2) ELSE 0.5 END ELSE p2 END, 6) AS p2,
      round(p3, 6) AS p3, round(CASE WHEN yr >= 1998 THEN 0 ELSE p4 END, 6) AS p4, round(CASE WHEN yr >= 1998 THEN 0 ELSE p5 END, 6) AS p5
    FROM wide""",
)
def redistribute_wide_conditional(spark, sf):
    return rounded(redistribute.redist(wide_priorities(spark, sf), ["p4", "p5"], ["p1", "p2"], condition="yr >= 1998"))


@query(
    "redistribute_return_flag", "R5",
    f"""WITH {LINES_PART}, c AS (SELECT linestatus, yr, sum(CASE WHEN flag = 'A' THEN 1.0 ELSE 0 END) AS a,
      sum(CASE WHEN flag = 'R' THEN 1.0 ELSE 0 END) AS r, sum(CASE WHEN flag = 'N' THEN 1.0 ELSE 0 END) AS u FROM lp GROUP BY ALL)
    SELECT linestatus, yr, 'A' AS flag, round(CAST(a + u * CASE WHEN a + r > 0 THEN a / (a + r) ELSE 0.5 END AS DOUBLE), 6) AS n FROM c
    UNION ALL
    SELECT linestatus, yr, 'R' AS flag, round(CAST(r + u * CASE WHEN a + r > 0 THEN r / (a + r) ELSE 0.5 END AS DOUBLE), 6) AS n FROM c""",
)
def redistribute_return_flag(spark, sf):
    cells = aggregate.tally(lines_part(spark, sf), ["linestatus", "yr", "flag"], "n")
    return rounded(redistribute.redistribute_unknown(cells, "flag", "n", ["linestatus", "yr"], "N", ["A", "R"]))


@query(
    "redistribute_by_reference_period", "R6",
    f"""WITH {cells_sql('nation', 'yr', 'priority')},
    g AS (SELECT nation, yr, coalesce(sum(n) FILTER (priority IN {KNOWN}), 0) AS k,
      coalesce(sum(n) FILTER (priority = '{UNKNOWN_PRIORITY}'), 0) AS u FROM cells GROUP BY ALL),
    ref AS (SELECT nation, priority, sum(n) AS rn FROM cells WHERE yr IN (1997, 1998) AND priority IN {KNOWN} GROUP BY ALL),
    rk AS (SELECT nation, sum(rn) AS rk FROM ref GROUP BY ALL)
    SELECT g.nation, g.yr, t.priority, round(coalesce(c.n, 0) + g.u * CASE
      WHEN g.yr <= 1996 THEN CASE WHEN coalesce(rk.rk, 0) > 0 THEN coalesce(ref.rn, 0) / rk.rk ELSE 0.25 END
      ELSE CASE WHEN g.k > 0 THEN coalesce(c.n, 0) / g.k ELSE 0.25 END END, 6) AS n
    FROM g CROSS JOIN {values([(p,) for p in PRIORITIES], 'priority').replace('AS v', 'AS t')}
    LEFT JOIN cells c ON c.nation = g.nation AND c.yr = g.yr AND c.priority = t.priority
    LEFT JOIN ref ON ref.nation = g.nation AND ref.priority = t.priority LEFT JOIN rk ON rk.nation = g.nation""",
)
def redistribute_by_reference_period(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "priority")
    out = redistribute.redistribute_with_reference(
        cells, "priority", "n", ["nation"], "yr", UNKNOWN_PRIORITY, PRIORITIES, [1997, 1998], 1996
    )
    return rounded(out)


# Part types 1..6 in alphabetical order stand in for causes; the size band for age.
TYPE_RULES = redistribute.parse_rules(
    """
    promo_small_band    | 4   | 1 3 | band <= 2
    promo_large_band    | 4   | 2 6 | band > 2
    small_to_standard   | 5   | 6   |
    economy_late        | 1   | 2 3 6 | yr >= 1999
    """
)


def type_cells(spark, sf, *keys):
    code = F.array_position(F.array(*[F.lit(t) for t in P_TYPES]), F.col("ptype")).cast("int")
    x = lines_part(spark, sf).withColumns({"code": code, "band": F.ceil(F.col("psize") / 10).cast("int")})
    return aggregate.tally(x, [*keys, "band", "yr", "code"], "n")


TYPES_SQL = f"""{LINES_PART}, typed AS (SELECT *, CAST(list_position({P_TYPES}, ptype) AS INTEGER) AS code,
    CAST(ceil(psize / 10.0) AS INTEGER) AS band FROM lp)"""


def _step(name, prev, on, src, tgts):
    """One proportional move as an SQL projection."""
    t = "(" + " + ".join(f"c{x}" for x in tgts) + ")"
    cols = []
    for i in range(1, 7):
        if i == src:
            cols.append(f"CASE WHEN {on} THEN 0 ELSE c{i} END AS c{i}")
        elif i in tgts:
            cols.append(f"CASE WHEN {on} THEN c{i} + c{src} * CASE WHEN {t} > 0 THEN c{i} / {t} ELSE 1.0 / {len(tgts)} END ELSE c{i} END AS c{i}")
        else:
            cols.append(f"c{i}")
    return f"{name} AS (SELECT brand, band, yr, {', '.join(cols)} FROM {prev})"


@query(
    "ordered_rules_part_types", "R7 A5",
    f"""WITH {TYPES_SQL}, s0 AS (SELECT brand, band, yr,
      {', '.join(f'CAST(count(*) FILTER (code = {i}) AS DOUBLE) AS c{i}' for i in range(1, 7))} FROM typed GROUP BY ALL),
    {_step('s1', 's0', 'band <= 2', 4, [1, 3])}, {_step('s2', 's1', 'band > 2', 4, [2, 6])},
    {_step('s3', 's2', 'TRUE', 5, [6])}, {_step('s4', 's3', 'yr >= 1999', 1, [2, 3, 6])}
    SELECT brand, band, yr, {', '.join(f'round(c{i}, 6) AS c{i}' for i in range(1, 7))} FROM s4""",
)
def ordered_rules_part_types(spark, sf):
    wide = grid.pivot_codes(type_cells(spark, sf, "brand"), ["brand", "band", "yr"], "code", list(range(1, 7)), "n")
    return rounded(redistribute.apply_move_rules(wide, TYPE_RULES))


# band 5 loses everything in the first envelope, so it has to borrow
TYPE_EXCLUSIONS = [
    redistribute.ExclusionRule((1, 2), "band = 1", "not in the smallest band"),
    redistribute.ExclusionRule((3,), "band = 1 AND yr >= 1998", "withdrawn from the smallest band"),
    redistribute.ExclusionRule((4,), "yr < 1997", "introduced later"),
    redistribute.ExclusionRule((5, 6), "band = 3", "not in the middle band"),
]
TYPE_ENVELOPES = {"first": [1, 2, 3], "second": [4, 5, 6]}
TYPE_LEVELS = {"brand_band": ["brand", "band"], "band_year": ["band", "yr"], "brand_only": ["brand"]}


def _excl(i):
    conds = {1: "band = 1", 2: "band = 1", 3: "band = 1 AND yr >= 1998", 4: "yr < 1997", 5: "band = 3", 6: "band = 3"}
    return f"({conds[i]})"


_ENV_SQL = f"""{TYPES_SQL}, base AS (SELECT brand, band, yr, code, CAST(count(*) AS DOUBLE) AS n FROM typed GROUP BY ALL),
  fl AS (SELECT *, CASE WHEN code <= 3 THEN 'first' ELSE 'second' END AS env,
    CASE WHEN CASE code {' '.join(f'WHEN {i} THEN {_excl(i)}' for i in range(1, 7))} END THEN 0 ELSE n END AS a FROM base),
  tt AS (SELECT *, sum(n) OVER w AS tb, sum(a) OVER w AS ta FROM fl WINDOW w AS (PARTITION BY brand, band, yr, env)),
  sc AS (SELECT *, ta <= 1e-12 AS lost, CASE WHEN ta > 1e-12 THEN a * tb / ta ELSE a END AS v FROM tt),
  need AS (SELECT DISTINCT brand, band, yr, env, tb FROM sc WHERE lost),
  l1 AS (SELECT env, brand, band, code, sum(v) AS v FROM sc GROUP BY ALL), l2 AS (SELECT env, band, yr, code, sum(v) AS v FROM sc GROUP BY ALL),
  l3 AS (SELECT env, brand, code, sum(v) AS v FROM sc GROUP BY ALL),
  t1 AS (SELECT env, brand, band, sum(v) AS t FROM l1 GROUP BY ALL HAVING sum(v) > 1e-12),
  t2 AS (SELECT env, band, yr, sum(v) AS t FROM l2 GROUP BY ALL HAVING sum(v) > 1e-12),
  t3 AS (SELECT env, brand, sum(v) AS t FROM l3 GROUP BY ALL HAVING sum(v) > 1e-12),
  pick AS (SELECT need.*, t1.t AS u1, t2.t AS u2, t3.t AS u3 FROM need LEFT JOIN t1 USING (env, brand, band)
    LEFT JOIN t2 USING (env, band, yr) LEFT JOIN t3 USING (env, brand)),
  fill AS (SELECT p.brand, p.band, p.yr, p.env, p.tb, k.code, p.u1, p.u2, p.u3, p.tb * CASE
      WHEN u1 IS NOT NULL THEN coalesce(l1.v, 0) / u1 WHEN u2 IS NOT NULL THEN coalesce(l2.v, 0) / u2
      WHEN u3 IS NOT NULL THEN coalesce(l3.v, 0) / u3 END AS v
    FROM pick p JOIN {values([('first', 1), ('first', 2), ('first', 3), ('second', 4), ('second', 5), ('second', 6)], 'env', 'code').replace('AS v', 'AS k')} ON k.env = p.env
    LEFT JOIN l1 ON l1.env = p.env AND l1.brand = p.brand AND l1.band = p.band AND l1.code = k.code
    LEFT JOIN l2 ON l2.env = p.env AND l2.band = p.band AND l2.yr = p.yr AND l2.code = k.code
    LEFT JOIN l3 ON l3.env = p.env AND l3.brand = p.brand AND l3.code = k.code)"""


def envelope_result(spark, sf):
    cells = grid.complete_codes(type_cells(spark, sf, "brand"), ["brand", "band", "yr"], "code", list(range(1, 7)), "n")
    return cells, redistribute.renormalise_envelopes(
        cells, ["brand", "band", "yr"], "code", "n", TYPE_ENVELOPES, TYPE_EXCLUSIONS, TYPE_LEVELS
    )


@query(
    "plausibility_with_envelope_donors", "R8 R9 J8",
    f"""WITH {_ENV_SQL}, allc AS (SELECT brand, band, yr, code, v FROM sc WHERE NOT lost UNION ALL SELECT brand, band, yr, code, v FROM fill)
    SELECT brand, band, yr, code, round(v, 6) AS n FROM allc WHERE v > 1e-9""",
)
def plausibility_with_envelope_donors(spark, sf):
    _, res = envelope_result(spark, sf)
    return rounded(res.cells.filter("n > 1e-9"))


@query(
    "envelope_donor_audit", "R9 A22",
    f"""WITH {_ENV_SQL} SELECT brand, band, yr, env AS envelope,
      CASE WHEN u1 IS NOT NULL THEN 'brand_band' WHEN u2 IS NOT NULL THEN 'band_year' WHEN u3 IS NOT NULL THEN 'brand_only' ELSE 'equal_valid_causes' END AS donor_level,
      round(coalesce(u1, u2, u3, 0), 6) AS donor_total, round(tb, 6) AS restored FROM pick""",
)
def envelope_donor_audit(spark, sf):
    _, res = envelope_result(spark, sf)
    return rounded(res.fallback.drop("valid_targets"))


@query(
    "envelope_exclusion_reasons", "R10",
    f"""WITH {_ENV_SQL} SELECT brand, band, yr, code, round(n, 6) AS precheck,
      coalesce(nullif(concat_ws('; ', CASE WHEN code IN (1, 2) AND band = 1 THEN 'not in the smallest band' END,
        CASE WHEN code = 3 AND band = 1 AND yr >= 1998 THEN 'withdrawn from the smallest band' END,
        CASE WHEN code = 4 AND yr < 1997 THEN 'introduced later' END,
        CASE WHEN code IN (5, 6) AND band = 3 THEN 'not in the middle band' END), ''), 'not identified') AS exclusion_reason
    FROM sc WHERE lost AND n > 1e-12""",
)
def envelope_exclusion_reasons(spark, sf):
    _, res = envelope_result(spark, sf)
    return rounded(res.sources)


@query(
    "rule_sequence_audit", "R7 D16",
    f"""WITH {TYPES_SQL}, s0 AS (SELECT brand, band, yr, {', '.join(f'CAST(count(*) FILTER (code = {i}) AS DOUBLE) AS c{i}' for i in range(1, 7))} FROM typed GROUP BY ALL),
    {_step('s1', 's0', 'band <= 2', 4, [1, 3])}, {_step('s2', 's1', 'band > 2', 4, [2, 6])}, {_step('s3', 's2', 'TRUE', 5, [6])}
    SELECT 1 AS step, 'promo_small_band' AS rule_id, 2 AS targets, count(*) FILTER (c4 > 0) AS cells, round(sum(c4), 6) AS moved FROM s0 WHERE band <= 2
    UNION ALL SELECT 2, 'promo_large_band', 2, count(*) FILTER (c4 > 0), round(sum(c4), 6) FROM s1 WHERE band > 2
    UNION ALL SELECT 3, 'small_to_standard', 1, count(*) FILTER (c5 > 0), round(sum(c5), 6) FROM s2
    UNION ALL SELECT 4, 'economy_late', 3, count(*) FILTER (c1 > 0), round(sum(c1), 6) FROM s3 WHERE yr >= 1999""",
)
def rule_sequence_audit(spark, sf):
    wide = grid.pivot_codes(type_cells(spark, sf, "brand"), ["brand", "band", "yr"], "code", list(range(1, 7)), "n")
    return rounded(redistribute.moved_by_rule(wide, TYPE_RULES))


_STUDY_CELLS = "place age5 yr".split()


def _study_rules_sql() -> str:
    """The study's rules one statement after another over wide cells."""
    code = "CAST(l_partkey % 214 + 1 AS INTEGER)"
    wide = ", ".join(f"CAST(count(*) FILTER (code = {c}) AS DOUBLE) AS c{c}" for c in study.ALL_CODES)
    steps = [f"src AS (SELECT CAST(l_suppkey % 3 AS INTEGER) AS place, CAST(l_quantity % 20 + 1 AS INTEGER) AS age5, CAST(year(l_shipdate) AS INTEGER) AS yr, {code} AS code FROM lineitem)"]
    steps.append(f"r0 AS MATERIALIZED (SELECT place, age5, yr, {wide} FROM src GROUP BY ALL)")
    for k, r in enumerate(study.MOVE_RULES):
        on, taken = r.condition or "TRUE", " + ".join(f"c{c}" for c in r.sources)
        total = " + ".join(f"c{c}" for c in r.targets)
        new = [f"CASE WHEN {on} THEN 0 ELSE c{c} END AS c{c}" for c in r.sources]
        new += [f"CASE WHEN {on} THEN c{c} + ({taken}) * CASE WHEN {total} > 0 THEN c{c} / ({total}) ELSE 1.0::DOUBLE / {len(r.targets)} END ELSE c{c} END AS c{c}" for c in r.targets]
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(new)}) FROM r{k})")
    return f"WITH {', '.join(steps)} SELECT place, age5, yr, CAST(substr(name, 2) AS INTEGER) AS code, round(n, 6) AS n FROM (UNPIVOT r{len(study.MOVE_RULES)} ON COLUMNS('^c[0-9]+$') INTO NAME name VALUE n) WHERE abs(n) > 1e-12"


@query("study_rules_on_cells", "R7 R1 R3 A5 A6", _study_rules_sql())
def study_rules_on_cells(spark, sf):
    """All rules of the study in order on cells of line items, with 214 codes."""
    x = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 3).cast("int").alias("place"), (F.col("l_quantity") % 20 + 1).cast("int").alias("age5"), F.year("l_shipdate").cast("int").alias("yr"),
        (F.col("l_partkey") % 214 + 1).cast("int").alias("code"), F.lit(1.0).alias("n"),
    )
    wide = grid.pivot_codes(x, _STUDY_CELLS, "code", study.ALL_CODES, "n")
    moved = redistribute.compiled_moves(wide, _STUDY_CELLS, study.MOVE_RULES, study.ALL_CODES)
    return rounded(redistribute.masses_long(moved, _STUDY_CELLS, study.ALL_CODES, "code", "n"))


_NS_KEYS = ["nation", "yr", "mon", "segment"]


@query(
    "named_source_with_donors", "R11 J8",
    f"""WITH {cells_sql(*_NS_KEYS, 'priority')},
    g AS (SELECT nation, yr, mon, segment, coalesce(sum(n) FILTER (priority IN {KNOWN}), 0) AS k, coalesce(sum(n) FILTER (priority = '{UNKNOWN_PRIORITY}'), 0) AS u FROM cells GROUP BY ALL),
    l1 AS (SELECT nation, yr, segment, priority, sum(n) AS v FROM cells WHERE priority IN {KNOWN} GROUP BY ALL),
    t1 AS (SELECT nation, yr, segment, sum(v) AS t FROM l1 GROUP BY ALL),
    l2 AS (SELECT nation, priority, sum(n) AS v FROM cells WHERE priority IN {KNOWN} GROUP BY ALL),
    t2 AS (SELECT nation, sum(v) AS t FROM l2 GROUP BY ALL)
    SELECT g.nation, g.yr, g.mon, g.segment, t.priority,
      round(CASE WHEN k > 0 THEN coalesce(x.n, 0) + u * coalesce(x.n, 0) / k WHEN t1.t > 0 THEN u * coalesce(l1.v, 0) / t1.t
        ELSE u * coalesce(l2.v, 0) / t2.t END, 6) AS n,
      CASE WHEN k > 0 THEN 'own' WHEN t1.t > 0 THEN 'nation_year_segment' ELSE 'nation_only' END AS share_level
    FROM g CROSS JOIN {values([(p,) for p in PRIORITIES], 'priority').replace('AS v', 'AS t')}
    LEFT JOIN cells x ON x.nation = g.nation AND x.yr = g.yr AND x.mon = g.mon AND x.segment = g.segment AND x.priority = t.priority
    LEFT JOIN l1 ON l1.nation = g.nation AND l1.yr = g.yr AND l1.segment = g.segment AND l1.priority = t.priority
    LEFT JOIN t1 ON t1.nation = g.nation AND t1.yr = g.yr AND t1.segment = g.segment
    LEFT JOIN l2 ON l2.nation = g.nation AND l2.priority = t.priority LEFT JOIN t2 ON t2.nation = g.nation""",
)
def named_source_with_donors(spark, sf):
    cells = order_cells(spark, sf, *_NS_KEYS, "priority")
    levels = {"nation_year_segment": ["nation", "yr", "segment"], "nation_only": ["nation"], "all": []}
    return rounded(redistribute.redistribute_named_source(cells, _NS_KEYS, "priority", "n", UNKNOWN_PRIORITY, PRIORITIES, levels))


@query(
    "expand_totals_by_donor_shares", "R12 R13",
    f"""WITH {cells_sql('nation', 'regionkey', 'yr', 'status', 'segment')},
    tot AS (SELECT yr, status, sum(n) AS n, count(*) AS eff FROM cells GROUP BY ALL),
    d AS (SELECT yr + 1 AS yr, nation, sum(n) AS w FROM cells GROUP BY ALL),
    tw AS (SELECT yr, sum(w) AS tw FROM d GROUP BY ALL), nat AS (SELECT n_nationkey AS nation FROM nation)
    SELECT tot.yr, tot.status, nat.nation, round(tot.n * s, 6) AS n, round(CAST(tot.eff AS DOUBLE) * s, 6) AS eff, round(s, 6) AS share,
      CASE WHEN tw > 0 THEN 'donor' ELSE 'equal' END AS share_source
    FROM (SELECT tot.*, nat.nation, tw.tw, CASE WHEN tw.tw > 0 THEN coalesce(d.w, 0) / tw.tw ELSE 1.0 / 25 END AS s
      FROM tot CROSS JOIN nat LEFT JOIN d ON d.yr = tot.yr AND d.nation = nat.nation LEFT JOIN tw ON tw.yr = tot.yr) tot JOIN nat USING (nation)""",
)
def expand_totals_by_donor_shares(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "status", "segment")
    totals = cells.groupBy("yr", "status").agg(F.sum("n").alias("n"), F.count("*").cast("double").alias("eff"))
    donors_ = cells.withColumn("yr", F.col("yr") + 1)  # last year's shares; the first year has none
    out = redistribute.expand_by_shares(
        totals, donors_.withColumnRenamed("n", "w"), ["yr"], ["nation"], "n", "w", {"nation": list(range(25))}, "eff"
    )
    return rounded(out.select("yr", "status", "nation", "n", "eff", "share", "share_source"))


@query(
    "effective_size_by_stratum_mass", "R13 A25",
    f"""WITH {LINES_PART}, m AS (SELECT brand, ptype, sum(qty) AS qty FROM lp GROUP BY ALL),
    k AS (SELECT brand, power(sum(qty), 2) / sum(qty * qty) AS ess FROM lp WHERE qty > 0 GROUP BY ALL)
    SELECT brand, ptype, round(qty, 6) AS qty, round(ess * qty / sum(qty) OVER (PARTITION BY brand), 6) AS ess FROM m JOIN k USING (brand)""",
)
def effective_size_by_stratum_mass(spark, sf):
    x = lines_part(spark, sf)
    # one pass over the records gives the cells; the group's size follows from their moments
    cells = x.groupBy("brand", "ptype").agg(
        F.sum("qty").alias("qty"), F.sum(F.when(F.col("qty") > 0, F.col("qty"))).alias("w1"), F.sum(F.when(F.col("qty") > 0, F.col("qty") * F.col("qty"))).alias("w2")
    )
    ess = cells.groupBy("brand").agg((F.pow(F.sum("w1"), 2) / F.sum("w2")).alias("ess"))
    return rounded(redistribute.allocate_effective_n(cells.join(ess, "brand"), ["ptype"], ["brand"], "qty", "ess"))


@query(
    "fractions_applied_to_totals", "R14 V11",
    f"""WITH {cells_sql('nation', 'yr', 'priority')}, f AS (SELECT yr, priority, sum(n) / sum(sum(n)) OVER (PARTITION BY yr) AS f FROM cells GROUP BY yr, priority),
    t AS (SELECT nation, yr, sum(n) AS t FROM cells GROUP BY ALL)
    SELECT nation, yr, priority, round(t * f, 6) AS n FROM t JOIN f USING (yr)""",
)
def fractions_applied_to_totals(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "priority")
    frac = compose.share(aggregate.grouped_sum(cells, ["yr", "priority"], ["n"]), ["yr"], "n", "f")
    panel = frac.join(cells.select("nation", "yr").distinct(), "yr").select("nation", "yr", "priority", "f")
    return rounded(redistribute.apply_fractions(cells, panel, ["nation", "yr"], "priority", "n", "f"))
