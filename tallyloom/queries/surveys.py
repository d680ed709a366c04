"""Survey designs, bootstrap, draws and their summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.functions.hashing import component_seed
from tallyloom.operators import aggregate, compose, draws, grid, rates, redistribute, summarise, survey, validate
from tallyloom.plans import intervals, views
from tallyloom.queries.inputs import (
    LINES_SUPPLIER, PRIORITIES, STATUSES, UNKNOWN_PRIORITY, YEARS, cells_sql, lines_supplier, order_cells, table, values,
)
from tallyloom.queries.redistribution import TYPE_RULES, TYPES_SQL, type_cells
from tallyloom.queries.registry import query, rounded
from tallyloom.session import materialise, run_folder, small_table
from tallyloom.sources import stores

SEED = 20200101
DRAWS = 40


def u_sql(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({joined}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def z_sql(*parts: str) -> str:
    a, b = u_sql(*parts, "'a'"), u_sql(*parts, "'b'")
    return f"(sqrt(-2.0 * ln({a} + 0.5 / 4294967296.0::DOUBLE)) * cos(6.283185307179586 * {b}))"


# suppliers are sampling units, nations strata, quantity the weight
_PSU = """psu AS (SELECT s_nationkey AS stratum, s_suppkey AS unit, CAST(('0x' || substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 4)) AS BIGINT) % 64 AS b FROM supplier),
  idx AS (SELECT stratum, unit, row_number() OVER (PARTITION BY stratum ORDER BY b, unit) AS i, count(*) OVER (PARTITION BY stratum) AS n FROM psu)"""
_BOOT = f"""{_PSU}, slots AS (SELECT d AS draw_id, stratum, CASE WHEN n = 1 THEN 1 ELSE CAST(floor({u_sql(str(SEED), 'd', 'stratum', 'i')} * n) AS BIGINT) + 1 END AS pick FROM idx, range(1, {DRAWS + 1}) t(d)),
  mult AS (SELECT draw_id, s.stratum, idx.unit, CAST(count(*) AS DOUBLE) AS multiplier FROM slots s JOIN idx ON idx.stratum = s.stratum AND idx.i = s.pick GROUP BY ALL)"""


def units(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("stratum"), F.col("s_suppkey").alias("unit"))


def multipliers(spark, sf):
    return survey.bootstrap_multipliers(units(spark, sf), "stratum", "unit", DRAWS, SEED)


def domain(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("weight"))
    x = l.join(units(spark, sf), "unit")
    return survey.domain_totals(x, ["stratum", "unit", "flag"], "weight", "w")


_DOM = "dom AS (SELECT s_nationkey AS stratum, l_suppkey AS unit, l_returnflag AS flag, sum(l_quantity) AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"


@query("bootstrap_unit_multipliers", "D4", f"WITH {_BOOT} SELECT CAST(draw_id AS INTEGER) AS draw_id, stratum, unit, multiplier FROM mult")
def bootstrap_unit_multipliers(spark, sf):
    return multipliers(spark, sf)


@query("survey_domain_totals", "M1 P26", f"WITH {_DOM} SELECT stratum, unit, flag, w FROM dom")
def survey_domain_totals(spark, sf):
    return domain(spark, sf)


_REP = f"{_BOOT}, {_DOM}, rep AS (SELECT draw_id, flag, sum(multiplier * w) AS w FROM mult JOIN dom USING (stratum, unit) GROUP BY ALL)"
_T8 = "list_extract({a}, CAST(least(greatest(floor({h}), 1), len({a})) AS INTEGER)) * (1 - ({h} - floor({h}))) + list_extract({a}, CAST(least(greatest(floor({h}) + 1, 1), len({a})) AS INTEGER)) * ({h} - floor({h}))"


def t8(a: str, p: float) -> str:
    h = f"(len({a}) * {p} + ({p} + 1) / 3.0)"
    return _T8.format(a=a, h=h)


@query("bootstrap_replicate_totals", "D5 D4", f"WITH {_REP} SELECT CAST(draw_id AS INTEGER) AS draw_id, flag, round(w, 6) AS w FROM rep")
def bootstrap_replicate_totals(spark, sf):
    return rounded(survey.replicate_totals(domain(spark, sf), multipliers(spark, sf), "stratum", "unit", ["flag"], "w"))


@query(
    "bootstrap_level_summary", "D5 D10",
    f"""WITH {_REP}, g AS (SELECT flag, list_sort(list(w)) AS a, stddev_samp(w) AS se, stddev_samp(ln(w)) AS ls, count(*) AS c FROM rep GROUP BY flag), p AS (SELECT flag, sum(w) AS point FROM dom GROUP BY flag)
    SELECT flag, round(point, 4) AS point, round(se, 4) AS standard_error, round({t8('a', 0.025)}, 4) AS lower, round({t8('a', 0.975)}, 4) AS upper, round(ls, 4) AS log_sd, c AS replicates FROM g JOIN p USING (flag)""",
)
def bootstrap_level_summary(spark, sf):
    d = domain(spark, sf)
    rep = survey.replicate_totals(d, multipliers(spark, sf), "stratum", "unit", ["flag"], "w")
    return rounded(survey.bootstrap_summary(rep, aggregate.grouped_sum(d, ["flag"], ["w"]), ["flag"], "w"), 4)


@query(
    "bootstrap_composition", "D5 W1",
    f"WITH {_REP} SELECT CAST(draw_id AS INTEGER) AS draw_id, flag, round(w, 6) AS w, round(w / sum(w) OVER (PARTITION BY draw_id), 6) AS share FROM rep",
)
def bootstrap_composition(spark, sf):
    rep = survey.replicate_totals(domain(spark, sf), multipliers(spark, sf), "stratum", "unit", ["flag"], "w")
    return rounded(survey.replicate_composition(rep, [], "w"))


@query(
    "dirichlet_size_from_bootstrap", "D6",
    f"""WITH {_REP}, s AS (SELECT draw_id, flag, w / sum(w) OVER (PARTITION BY draw_id) AS s FROM rep), v AS (SELECT flag, var_samp(s) AS v FROM s GROUP BY flag),
    p AS (SELECT flag, sum(w) / sum(sum(w)) OVER () AS p FROM dom GROUP BY flag) SELECT round((1 - sum(p * p)) / sum(v) - 1, 3) AS effective_n, count(*) AS categories FROM p JOIN v USING (flag)""",
)
def dirichlet_size_from_bootstrap(spark, sf):
    d = domain(spark, sf)
    rep = survey.replicate_composition(survey.replicate_totals(d, multipliers(spark, sf), "stratum", "unit", ["flag"], "w"), [], "w")
    totals = aggregate.grouped_sum(d, ["flag"], ["w"])
    point = totals.withColumn("share", F.col("w") / totals.agg(F.sum("w")).scalar())
    n = survey.dirichlet_effective_n(rep, point, [], "flag", "share", minimum=10)
    return rounded(n.withColumn("categories", totals.agg(F.count("*")).scalar()), 3)


@query(
    "survey_envelope_table", "M2 R4 J6",
    f"""WITH {cells_sql('regionkey', 'status', 'priority')}, g AS (SELECT regionkey, status, sum(n) FILTER (priority <> '{UNKNOWN_PRIORITY}') AS k, coalesce(sum(n) FILTER (priority = '{UNKNOWN_PRIORITY}'), 0) AS u FROM cells GROUP BY ALL),
    a AS (SELECT regionkey, status, priority, n + u * n / k AS n FROM cells JOIN g USING (regionkey, status) WHERE priority <> '{UNKNOWN_PRIORITY}'),
    h AS (SELECT regionkey, priority, sum(n) FILTER (status <> 'P') AS k, coalesce(sum(n) FILTER (status = 'P'), 0) AS u FROM a GROUP BY ALL),
    b AS (SELECT regionkey, status, priority, n + u * n / k AS n FROM a JOIN h USING (regionkey, priority) WHERE status <> 'P')
    SELECT regionkey, status, priority, round(n, 6) AS n, round(n / sum(n) OVER (), 6) AS share, round(500 * n / sum(n) OVER (), 6) AS effective_n FROM b""",
)
def survey_envelope_table(spark, sf):
    cells = order_cells(spark, sf, "regionkey", "status", "priority")
    dims = [("priority", UNKNOWN_PRIORITY, PRIORITIES), ("status", "P", ["F", "O"])]
    levels = {"regionkey": list(range(5)), "status": ["F", "O"], "priority": PRIORITIES}
    return rounded(survey.envelope_table(cells, dims, ["regionkey", "status", "priority"], "n", levels, 500.0))


@query(
    "survey_cause_table_with_copied_level", "M3 R13 C1",
    f"""WITH {cells_sql('regionkey', 'yr', 'priority')}, g AS (SELECT regionkey, yr, sum(n) FILTER (priority <> '{UNKNOWN_PRIORITY}') AS k, coalesce(sum(n) FILTER (priority = '{UNKNOWN_PRIORITY}'), 0) AS u FROM cells GROUP BY ALL),
    a AS (SELECT regionkey, yr, priority, n + u * n / k AS n FROM cells JOIN g USING (regionkey, yr) WHERE priority <> '{UNKNOWN_PRIORITY}'),
    b AS (SELECT * FROM a WHERE yr <> 1995 UNION ALL SELECT regionkey, 1995, priority, n FROM a WHERE yr = 1996),
    m AS (SELECT regionkey, yr, sum(n) AS m FROM b GROUP BY ALL) SELECT regionkey, CAST(yr AS INTEGER) AS yr, round(m, 6) AS n, round(300 * m / sum(m) OVER (PARTITION BY regionkey), 6) AS effective_n FROM m""",
)
def survey_cause_table(spark, sf):
    cells = order_cells(spark, sf, "regionkey", "yr", "priority")
    x = survey.redistribute_dimensions(cells, [("priority", UNKNOWN_PRIORITY, PRIORITIES)], ["regionkey", "yr", "priority"], "n")
    x = survey.copy_level(x, "yr", 1996, 1995).withColumn("effective_n", F.lit(300.0))
    return rounded(redistribute.allocate_effective_n(x, ["yr"], ["regionkey"], "n", "effective_n"))


@query(
    "survey_bundle_and_audit", "M4 J3",
    f"""WITH a AS (SELECT c_nationkey AS nation, CAST(count(*) AS DOUBLE) AS a FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS nation, CAST(count(*) AS DOUBLE) AS b FROM supplier GROUP BY 1),
    w AS (SELECT nation, coalesce(a, 0) AS customers, coalesce(b, 0) AS suppliers FROM a FULL JOIN b USING (nation)), r AS (SELECT n_nationkey AS nation, CAST(n_regionkey * 20 + 10 AS DOUBLE) AS reference FROM nation)
    SELECT nation, customers, suppliers, reference, customers - reference AS difference, round((customers - reference) / reference, 6) AS relative FROM w FULL JOIN r USING (nation)""",
)
def survey_bundle_and_audit(spark, sf):
    a = aggregate.tally(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), ["nation"], "n")
    b = aggregate.tally(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")), ["nation"], "n")
    both = survey.bundle({"customers": a, "suppliers": b}, ["nation"], "n")
    ref = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_regionkey") * 20 + 10).cast("double").alias("r"))
    return rounded(survey.reference_audit(both, ref, ["nation"], "customers", "r"))


@query(
    "survey_design_from_records", "P26 M1 A25",
    """WITH x AS (SELECT concat_ws('|', CAST(s_nationkey AS VARCHAR), l_linestatus) AS stratum_id, CASE WHEN l_returnflag = 'N' THEN 'record|' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) ELSE 'psu|' || CAST(l_suppkey AS VARCHAR) END AS psu_id,
      CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 9 END AS cause, l_quantity AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
    SELECT stratum_id, cause, count(DISTINCT psu_id) AS units, sum(w) AS weighted FROM x WHERE cause < 9 OR w > 10 GROUP BY ALL""",
)
def survey_design_from_records(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("w"))
    x = l.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    x = x.withColumns({"p": F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")), "rid": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    x = x.withColumns(
        {"stratum": survey.stratum_id("s_nationkey", "l_linestatus"), "psu": survey.psu_id("p", "rid"), "cause": survey.recode("l_returnflag", {"A": 1, "R": 2}, 9)}
    )
    design = survey.build_design(x, "w", "stratum", "psu", ["cause"], ["cause", "l_linestatus"], (F.col("cause") < 9) | (F.col("w") > 10))
    return design.level_domain.groupBy("stratum_id", "cause").agg(F.count_distinct("psu_id").alias("units"), F.sum("weighted").alias("weighted"))


@query(
    "weight_corrections_by_value", "P27 J10",
    """SELECT l_returnflag, l_linestatus, sum(CASE WHEN l_quantity IN (5, 7, 11) THEN 2 * l_quantity ELSE l_quantity END) AS w FROM lineitem GROUP BY ALL""",
)
def weight_corrections_by_value(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    fix = l.filter(F.col("l_quantity").isin(5, 7, 11)).select("l_returnflag", F.col("l_quantity").alias("old"), (F.col("l_quantity") * 2).alias("new")).distinct()
    out = survey.correct_weights(l, fix, ["l_returnflag"], "l_quantity", "old", "new")
    return out.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("w"))


# ---------------------------------------------------------------- seeds and completeness factors


@query(
    "component_seed_map", "D1",
    f"""SELECT s_suppkey AS draw_id, greatest(({SEED} + 10007 * s_suppkey + 101) % 2147483647, 1) AS completeness, greatest(({SEED} + 10007 * s_suppkey + 211) % 2147483647, 1) AS survey FROM supplier""",
)
def component_seed_map(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("draw_id"))
    return s.select("draw_id", component_seed(SEED, "draw_id", 101).alias("completeness"), component_seed(SEED, "draw_id", 211).alias("survey"))


_DISP = f"""{cells_sql('nation', 'yr', 'status')}, {LINES_SUPPLIER}, lx AS (SELECT nation, yr, linestatus AS status, CAST(count(*) AS DOUBLE) AS m FROM ls GROUP BY ALL),
  sc AS (SELECT c.nation, c.yr, c.status, m / n AS s2 FROM cells c LEFT JOIN lx USING (nation, yr, status)),
  e AS (SELECT sc.nation, sc.yr, n AS adj, n / s2 AS pre FROM sc JOIN cells USING (nation, yr, status) WHERE yr <= 2000 AND s2 > 0),
  t AS (SELECT nation, yr, sum(adj) AS a, sum(pre) AS p, count(*) AS c, ln(sum(adj) / sum(pre)) AS l FROM e GROUP BY ALL),
  m AS (SELECT nation, sum(p * l) / sum(p) AS ml FROM t GROUP BY nation),
  disp AS (SELECT nation, count(*) AS years, CAST(sum(c) AS BIGINT) AS contributing_cells, sum(p) AS pre_adjustment, sum(a) AS adjusted, any_value(ml) AS mean_log, sqrt(sum(p * power(l - ml, 2)) / sum(p)) AS log_sd,
    min(a / p) AS minimum, median(a / p) AS median, max(a / p) AS maximum FROM t JOIN m USING (nation) GROUP BY nation)"""


def _scalar_rows(spark, sf, cells=None):
    if cells is None:
        cells = materialise(order_cells(spark, sf, "nation", "yr", "status"), "cells")
    m = lines_supplier(spark, sf).groupBy("nation", "yr", F.col("linestatus").alias("status")).agg(F.count("*").cast("double").alias("m"))
    return cells, cells.join(m, ["nation", "yr", "status"], "left").select("nation", "yr", "status", (F.col("m") / F.col("n")).alias("s2"))


def dispersion(spark, sf, cells=None):
    cells, sc = _scalar_rows(spark, sf, cells)
    return draws.log_dispersion(sc, cells, ["nation", "status"], "nation", "yr", "s2", "n", 2000)


@query(
    "completeness_log_dispersion", "D2",
    f"""WITH {_DISP} SELECT nation, years, contributing_cells, round(pre_adjustment, 6) AS pre_adjustment, round(adjusted, 6) AS adjusted, round(mean_log, 6) AS mean_log, round(log_sd, 6) AS log_sd,
      round(minimum, 6) AS minimum, round(median, 6) AS median, round(maximum, 6) AS maximum, round(adjusted / pre_adjustment, 6) AS aggregate_ratio, round(exp(-0.5 * log_sd * log_sd - 1.959963984540054 * log_sd), 6) AS factor_lower,
      round(exp(-0.5 * log_sd * log_sd), 6) AS factor_median, round(exp(-0.5 * log_sd * log_sd + 1.959963984540054 * log_sd), 6) AS factor_upper FROM disp""",
)
def completeness_log_dispersion(spark, sf):
    return rounded(dispersion(spark, sf))


@query(
    "dispersion_exclusions", "D2 V4",
    f"""WITH {_DISP} SELECT 'after_freeze' AS reason, count(*) FILTER (yr > 2000) AS "rows" FROM sc UNION ALL SELECT 'copied_row', 0 UNION ALL
      SELECT 'invalid_scalar', count(*) FILTER (yr <= 2000 AND coalesce(s2, 0) <= 0) FROM sc UNION ALL SELECT 'no_weight', 0""",
)
def dispersion_exclusions(spark, sf):
    cells, sc = _scalar_rows(spark, sf)
    return draws.dispersion_exclusions(sc, cells, ["nation", "status"], "yr", "s2", "n", 2000)


_FACT = f"{_DISP}, fac AS (SELECT d AS draw_id, nation, {z_sql(str(SEED), 'd', chr(39) + 'completeness' + chr(39), 'nation')} AS z, log_sd FROM disp, range(1, {DRAWS + 1}) t(d))"


@query(
    "completeness_lognormal_factors", "D3 D2",
    f"WITH {_FACT} SELECT CAST(draw_id AS INTEGER) AS draw_id, nation, round(z, 6) AS standard_normal, round(exp(-0.5 * log_sd * log_sd + log_sd * z), 6) AS factor FROM fac",
)
def completeness_lognormal_factors(spark, sf):
    return rounded(draws.lognormal_factors(dispersion(spark, sf), "nation", "log_sd", 1, DRAWS, SEED))


_DRAW = f"""{_FACT}, dr AS (SELECT draw_id, c.nation, c.yr, c.status, n * CASE WHEN status <> 'F' THEN exp(-0.5 * log_sd * log_sd + log_sd * z) ELSE 1 END AS n FROM cells c JOIN fac USING (nation))"""


def nation_draws(spark, sf):
    cells = materialise(order_cells(spark, sf, "nation", "yr", "status"), "cells")
    f = draws.lognormal_factors(dispersion(spark, sf, cells), "nation", "log_sd", 1, DRAWS, SEED)
    return draws.apply_factors(draws.with_draws(cells, 1, DRAWS), f, ["draw_id", "nation"], F.col("status") != "F", "n")


@query(
    "completeness_draws_of_cells", "D3 D15",
    f"WITH {_DRAW} SELECT CAST(draw_id AS INTEGER) AS draw_id, nation, yr, status, round(n, 6) AS n FROM dr",
)
def completeness_draws_of_cells(spark, sf):
    return rounded(nation_draws(spark, sf).select("draw_id", "nation", "yr", "status", "n"))


_TOT = f"{_DRAW}, tt AS (SELECT draw_id, nation, yr, sum(n) AS n FROM dr GROUP BY ALL), gg AS (SELECT nation, yr, list_sort(list(n)) AS a, avg(n) AS mean, stddev_samp(n) AS sd, min(n) AS mn, max(n) AS mx, count(*) AS c FROM tt GROUP BY ALL)"


def totals(spark, sf):
    return aggregate.grouped_sum(nation_draws(spark, sf), ["draw_id", "nation", "yr"], ["n"])


@query(
    "draw_summary_type8", "D10 Q4",
    f"""WITH {_TOT} SELECT nation, yr, round(mean, 6) AS mean, round({t8('a', 0.5)}, 6) AS median, round(sd, 6) AS sd, round(mn, 6) AS min, round(mx, 6) AS max, round({t8('a', 0.025)}, 6) AS lower, round({t8('a', 0.975)}, 6) AS upper, c AS n_draws FROM gg""",
)
def draw_summary_type8(spark, sf):
    return rounded(summarise.summarise_draws(totals(spark, sf), ["nation", "yr"], "n", expected=DRAWS))


@query(
    "draw_summary_enriched", "D11 J1",
    f"""WITH {_TOT}, pt AS (SELECT nation, yr, sum(n) AS point FROM cells GROUP BY ALL), s AS (SELECT nation, yr, mean, sd, c, {t8('a', 0.025)} AS lo, {t8('a', 0.975)} AS hi FROM gg)
    SELECT nation, yr, point, round(sd / mean, 6) AS cv, round(hi - lo, 6) AS interval_width, round((hi - lo) / point, 6) AS relative_interval_width, round(sd / sqrt(c), 6) AS monte_carlo_se_mean FROM s JOIN pt USING (nation, yr)""",
)
def draw_summary_enriched(spark, sf):
    s = summarise.summarise_draws(totals(spark, sf), ["nation", "yr"], "n")
    point = aggregate.grouped_sum(order_cells(spark, sf, "nation", "yr", "status"), ["nation", "yr"], ["n"])
    out = summarise.enrich(s, point, ["nation", "yr"], "n")
    return rounded(out.select("nation", "yr", "point", "cv", "interval_width", "relative_interval_width", "monte_carlo_se_mean"))


@query(
    "draw_convergence", "D12",
    f"""WITH {_TOT}, cp AS (SELECT nation, yr, k, list_sort(list(n)) AS a FROM tt, (VALUES (10), (20), ({DRAWS})) v(k) WHERE draw_id <= k GROUP BY ALL)
    SELECT c.nation, c.yr, CAST(c.k AS INTEGER) AS n_draws, round({t8('c.a', 0.025)}, 6) AS lower, round({t8('c.a', 0.5)}, 6) AS median, round({t8('c.a', 0.975)}, 6) AS upper,
      round(({t8('c.a', 0.025)}) - ({t8('g.a', 0.025)}), 6) AS lower_change_from_final, round(({t8('c.a', 0.5)}) - ({t8('g.a', 0.5)}), 6) AS median_change_from_final, round(({t8('c.a', 0.975)}) - ({t8('g.a', 0.975)}), 6) AS upper_change_from_final
    FROM cp c JOIN gg g USING (nation, yr)""",
)
def draw_convergence(spark, sf):
    return rounded(summarise.convergence(totals(spark, sf), ["nation", "yr"], "n", [10, 20], DRAWS))


@query(
    "draw_co_movement", "D13",
    f"""WITH {_DRAW}, x AS (SELECT draw_id, nation, status, sum(n) AS n FROM dr GROUP BY ALL), j AS (SELECT a.draw_id, a.nation, a.status, a.n, b.n AS d FROM x a JOIN x b ON b.draw_id = a.draw_id AND b.nation = a.nation AND b.status = 'O' WHERE a.status <> 'O'),
    s AS (SELECT nation, status, count(DISTINCT draw_id) AS n_draws, avg(n) AS mc, stddev_samp(n) AS sc, avg(d) AS md, stddev_samp(d) AS sd, covar_samp(n, d) AS cv, var_samp(d) AS vd FROM j GROUP BY ALL)
    SELECT nation, status, n_draws, round(mc, 4) AS mean_cause, round(sc, 4) AS sd_cause, round(md, 4) AS mean_driver, round(sd, 4) AS sd_driver, round(cv, 4) AS covariance,
      CASE WHEN sc > 0 AND sd > 0 THEN round(cv / (sc * sd), 4) END AS correlation, CASE WHEN sd > 0 THEN round(cv / vd, 4) END AS slope FROM s""",
)
def draw_co_movement(spark, sf):
    x = aggregate.grouped_sum(nation_draws(spark, sf), ["draw_id", "nation", "status"], ["n"])
    return rounded(summarise.co_movement(x, ["nation"], "status", "O", "n"), 4)


@query(
    "draw_key_completeness", "D14 S11",
    f"""WITH {_DRAW}, od AS (SELECT draw_id, nation, yr, status, n > 25.5 AS large FROM dr)
    SELECT nation, yr, status, large, count(*) AS "rows", count(DISTINCT draw_id) AS draws FROM od GROUP BY ALL HAVING count(*) <> {DRAWS}""",
)
def draw_key_completeness(spark, sf):
    # some cells are large in some draws only, so their keys are incomplete
    return summarise.incomplete_keys(nation_draws(spark, sf).withColumn("large", F.col("n") > 25.5), ["nation", "yr", "status", "large"], DRAWS)


@query(
    "draw_slice_with_count_check", "Q2",
    f"WITH {_DRAW} SELECT CAST(draw_id AS INTEGER) AS draw_id, nation, yr, round(n, 6) AS estimate, CAST({DRAWS} AS BIGINT) AS n_draws FROM dr WHERE status = 'O' AND yr IN (1997, 1998)",
)
def draw_slice_with_count_check(spark, sf):
    out = views.draw_slice(nation_draws(spark, sf), {"status": "O", "yr": [1997, 1998]}, ["nation", "yr"], "n", DRAWS)
    return rounded(out.select("draw_id", "nation", "yr", "estimate", "n_draws"))


@query(
    "intervals_attached_to_points", "Q5 Q4 J1",
    f"""WITH {_TOT}, pts AS (SELECT n.nation, y.yr, coalesce(c.n, 0) AS n FROM (SELECT n_nationkey AS nation FROM nation) n, range(1994, 2002) y(yr) LEFT JOIN (SELECT nation, yr, sum(n) AS n FROM cells GROUP BY ALL) c ON c.nation = n.nation AND c.yr = y.yr)
    SELECT p.nation, CAST(p.yr AS INTEGER) AS yr, p.n, c AS n_draws, round(CASE WHEN a IS NULL AND p.n = 0 AND p.yr = 1994 THEN 0 ELSE {t8('a', 0.025)} END, 6) AS lower, round(CASE WHEN a IS NULL AND p.n = 0 AND p.yr = 1994 THEN 0 ELSE {t8('a', 0.975)} END, 6) AS upper
    FROM pts p LEFT JOIN gg ON gg.nation = p.nation AND gg.yr = p.yr""",
)
def intervals_attached_to_points(spark, sf):
    point = grid.complete_cells(order_cells(spark, sf, "nation", "yr", "status"), ["nation", "yr"], ["n"], {"nation": list(range(25)), "yr": list(range(1994, 2002))})
    s = summarise.summarise_draws(totals(spark, sf), ["nation", "yr"], "n")
    return rounded(views.attach_intervals(point, s, ["nation", "yr"], F.col("yr") == 1994, "n"))


@query(
    "interval_rates_with_alignment", "D17 V8 Y4",
    f"""WITH {_TOT}, pop AS (SELECT c_nationkey AS nation, CAST(count(*) AS DOUBLE) AS population FROM customer GROUP BY 1)
    SELECT nation, yr, round(1e5 * mean / population, 4) AS mean_rate, round(1e5 * ({t8('a', 0.025)}) / population, 4) AS lower_rate, round(1e5 * ({t8('a', 0.975)}) / population, 4) AS upper_rate FROM gg JOIN pop USING (nation)""",
)
def interval_rates(spark, sf):
    s = summarise.summarise_draws(totals(spark, sf), ["nation", "yr"], "n")
    pop = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").cast("double").alias("population"))
    out = summarise.intervals_with_rates(s, pop, ["nation"])
    return rounded(out.select("nation", "yr", "mean_rate", "lower_rate", "upper_rate"), 4)


@query(
    "point_draw_alignment", "V14 D17 Q5",
    f"""WITH {_TOT}, pt AS (SELECT nation, yr, sum(n) AS p FROM cells GROUP BY ALL), j AS (SELECT abs(p - mean) AS d, abs(p - mean) / greatest(1.0, p, mean) AS r FROM pt JOIN gg USING (nation, yr))
    SELECT count(*) AS cells, round(max(d), 4) AS max_absolute, round(max(r), 4) AS max_relative, count(*) FILTER (d > 1e-6 AND r > 2e-7) AS over_tolerance FROM j""",
)
def point_draw_alignment(spark, sf):
    point = aggregate.grouped_sum(order_cells(spark, sf, "nation", "yr", "status"), ["nation", "yr"], ["n"])
    s = summarise.summarise_draws(totals(spark, sf), ["nation", "yr"], "n")
    return rounded(views.point_draw_alignment(point, s, ["nation", "yr"], "n", "mean"), 4)


@query(
    "conservation_by_draw", "V15 V7 R4",
    f"""WITH {_DRAW}, dn AS (SELECT draw_id, nation, sum(n) AS t FROM dr GROUP BY ALL), twin AS (SELECT 'conserving' AS run, *, t AS a FROM dn UNION ALL SELECT 'lossy', *, CASE WHEN nation = 3 THEN 0.9 * t ELSE t END FROM dn)
    SELECT run, CAST(draw_id AS INTEGER) AS draw_id, nation, round(t, 4) AS before, round(a, 4) AS after, round(abs(t - a) / greatest(1, t), 4) AS error FROM twin""",
)
def conservation_by_draw(spark, sf):
    x = nation_draws(spark, sf)
    after = redistribute.redistribute_unknown(x, "status", "n", ["draw_id", "nation", "yr"], "P", ["F", "O"])
    # a twin that loses a tenth of one nation shows that the check finds a loss
    lossy = after.withColumn("n", F.when(F.col("nation") == 3, 0.9 * F.col("n")).otherwise(F.col("n")))
    runs = [validate.group_errors(x, y, ["draw_id", "nation"], "n").withColumn("run", F.lit(name)) for name, y in (("conserving", after), ("lossy", lossy))]
    return rounded(runs[0].unionByName(runs[1]), 4)


@query(
    "margins_of_draws", "A10 A11 A12 D15",
    f"""WITH {_DRAW}, g AS (SELECT draw_id, coalesce(nation, 25) AS nation, coalesce(status, 'all') AS status, yr, sum(n) AS n FROM dr GROUP BY GROUPING SETS ((draw_id, nation, status, yr), (draw_id, status, yr), (draw_id, nation, yr), (draw_id, yr)))
    SELECT CAST(draw_id AS INTEGER) AS draw_id, CAST(nation AS INTEGER) AS nation, status, {', '.join(f'round(coalesce(sum(n) FILTER (yr = {y}), 0), 4) AS age_{y}' for y in YEARS)} FROM g GROUP BY ALL""",
)
def margins_of_draws(spark, sf):
    m = aggregate.margins(nation_draws(spark, sf), ["draw_id", "nation", "status", "yr"], {"nation": 25, "status": "all"}, ["n"])
    return rounded(grid.pivot_codes(m, ["draw_id", "nation", "status"], "yr", YEARS, "n", prefix="age_"), 4)


_SERIES_ROWS = [("F", "done", 1.0), ("O", "open", 1.0), ("P", "open", 1.0), ("F", "all", 1.0), ("O", "all", 1.0), ("P", "all", 1.0)]


@query(
    "interval_cube_of_series", "D18 A21 D10",
    f"""WITH {_DRAW}, w AS (SELECT draw_id, nation, status, {', '.join(f'coalesce(sum(n) FILTER (yr = {y}), 0) AS c{i}' for i, y in enumerate(YEARS))} FROM dr GROUP BY ALL),
    ms AS (SELECT draw_id, nation, series_id, {', '.join(f'sum(c{i} * wt) AS c{i}' for i in range(7))} FROM w JOIN {values(_SERIES_ROWS, 'status', 'series_id', 'wt').replace('AS v', 'AS s')} USING (status) GROUP BY ALL),
    l AS (SELECT draw_id, nation, series_id, 1 AS age_id, c0 + c1 + c2 AS v FROM ms UNION ALL SELECT draw_id, nation, series_id, 2, c3 + c4 + c5 + c6 FROM ms UNION ALL SELECT draw_id, nation, series_id, 3, c0 + c1 + c2 + c3 + c4 + c5 + c6 FROM ms),
    q AS (SELECT nation, series_id, age_id, list_sort(list(v)) AS a, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx, count(*) AS c FROM l GROUP BY ALL)
    SELECT nation, series_id, age_id, round(mean, 4) AS mean, round({t8('a', 0.5)}, 4) AS median, round(sd, 4) AS sd, round(mn, 4) AS min, round(mx, 4) AS max, round({t8('a', 0.025)}, 4) AS lower, round({t8('a', 0.975)}, 4) AS upper, c AS n_draws FROM q""",
)
def interval_cube_of_series(spark, sf):
    wide = grid.pivot_codes(nation_draws(spark, sf), ["draw_id", "nation", "status"], "yr", YEARS, "n", prefix="age_").withColumnRenamed("status", "cause_id")
    mapping = small_table(spark, _SERIES_ROWS, "cause_id string, series_id string, weight double")
    cols = [f"age_{y}" for y in YEARS]
    cube = summarise.interval_cube(wide, mapping, ["nation"], cols, {1: [0, 1, 2], 2: [3, 4, 5, 6], 3: list(range(7))}, expected=DRAWS)
    return rounded(cube, 4)


@query(
    "fraction_intervals_in_draws", "D18 A20 Q4",
    f"""WITH {_DRAW}, f AS (SELECT draw_id, nation, sum(n) FILTER (status = 'O') / sum(n) AS f FROM dr GROUP BY ALL), q AS (SELECT nation, list_sort(list(f)) AS a, avg(f) AS mean, stddev_samp(f) AS sd, min(f) AS mn, max(f) AS mx, count(*) AS c FROM f GROUP BY nation)
    SELECT nation, 'open_of_all' AS series_id, round(mean, 6) AS mean, round({t8('a', 0.5)}, 6) AS median, round(sd, 6) AS sd, round(mn, 6) AS min, round(mx, 6) AS max, round({t8('a', 0.025)}, 6) AS lower, round({t8('a', 0.975)}, 6) AS upper, c AS n_draws FROM q""",
)
def fraction_intervals_in_draws(spark, sf):
    return rounded(summarise.fraction_intervals(nation_draws(spark, sf), ["nation"], "status", "n", {"open_of_all": ["O"]}, {"open_of_all": STATUSES}))


_ASR_WEIGHTS = [0.4, 0.1, 0.2, 0.2, 0.1]
_AGE_SPECS = {1: ([0, 1, 2], [1, 2]), 2: ([3, 4, 5, 6], [3, 4, 5, 6]), 25: (list(range(7)), list(range(1, 7)))}
_CELL_BY = ["storage_scope", "sex_code", "nation"]
_SCOPE_SQL = "CASE WHEN nation < 10 THEN 'province' ELSE 'population_group' END AS storage_scope, CAST(nation % 2 + 1 AS INTEGER) AS sex_code"


def _asr_sql() -> str:
    pairs = [("c0 + c1 + c2", "p1 + p2"), *[(f"c{k}", f"p{k}") for k in range(3, 7)]]
    return "1e5 * (" + " + ".join(f"{w} * ({c}) / ({p})" for w, (c, p) in zip(_ASR_WEIGHTS, pairs)) + f") / {sum(_ASR_WEIGHTS)}"


def _spec_sql(columns: str) -> str:
    out = [f"SELECT {columns}, {code} AS age_id, 'count' AS measure, {' + '.join(f'c{a}' for a in n)} AS v, CAST({' + '.join(f'p{a}' for a in d)} AS DOUBLE) AS population FROM rated" for code, (n, d) in _AGE_SPECS.items()]
    return " UNION ALL ".join([*out, f"SELECT {columns}, 99, 'asr', {_asr_sql()}, NULL FROM rated"])


_PUBLISHED = f"""{_DRAW}, pop AS (SELECT c_nationkey AS nation, {', '.join(f'CAST(count(*) + {10 * a} AS DOUBLE) AS p{a}' for a in range(7))} FROM customer GROUP BY 1),
    twofold AS (SELECT draw_id, nation, yr, status, n FROM dr UNION ALL SELECT 0, nation, yr, status, n FROM cells),
    series AS (SELECT * FROM {values(_SERIES_ROWS, 'status', 'series_id', 'wt')}),
    rated AS (SELECT draw_id, nation, series_id, {', '.join(f'coalesce(sum(n * wt) FILTER (yr = {y}), 0) AS c{i}' for i, y in enumerate(YEARS))}, {', '.join(f'any_value(p{a}) AS p{a}' for a in range(7))}
        FROM twofold JOIN series USING (status) JOIN pop USING (nation) GROUP BY ALL),
    spec AS ({_spec_sql('draw_id, nation, series_id')} UNION ALL SELECT draw_id, nation, 'open_of_all', 25, 'fraction', sum(n) FILTER (status = 'O') / sum(n), NULL FROM twofold GROUP BY ALL),
    q AS (SELECT nation, series_id, age_id, measure, max(population) AS population, list_sort(list(v) FILTER (draw_id > 0)) AS a, avg(v) FILTER (draw_id > 0) AS mean, max(v) FILTER (draw_id = 0) AS point FROM spec GROUP BY ALL)
    SELECT {_SCOPE_SQL}, nation, series_id, age_id, measure, round(point, 4) AS point, round(mean, 4) AS mean, round({t8('a', 0.5)}, 4) AS median, round({t8('a', 0.025)}, 4) AS lower, round({t8('a', 0.975)}, 4) AS upper,
      len(a) AS n_draws, round(1e5 * point / population, 4) AS rate_point, round(1e5 * ({t8('a', 0.025)}) / population, 4) AS rate_lower, round(1e5 * ({t8('a', 0.975)}) / population, 4) AS rate_upper, 'aligned' AS alignment FROM q"""


def _scoped(df):
    return df.withColumns({"storage_scope": F.when(F.col("nation") < 10, "province").otherwise("population_group"), "sex_code": (F.col("nation") % 2 + 1).cast("int")})


def _wide_ages(df, *keys):
    wide = grid.pivot_codes(_scoped(df), [*keys, *_CELL_BY, "status"], "yr", YEARS, "n", prefix="y")
    return wide.select(*keys, *_CELL_BY, F.col("status").alias("cause_id"), *[F.col(f"y{y}").alias(f"age_{k}") for k, y in enumerate(YEARS)])


@query("published_intervals_from_draw_store", "D10 D17 D18 S9 S11 Q4 Q5 A20 A21 Y4 Y5 Y9", f"WITH {_PUBLISHED}")
def published_intervals_from_draw_store(spark, sf):
    """Two blocks of draws are written, read as a store, checked, summarised and published as an interval store."""
    path = f"{run_folder(spark)}/published-{uuid.uuid4().hex}"
    cells = materialise(order_cells(spark, sf, "nation", "yr", "status"), "cells")
    drawn = materialise(_wide_ages(nation_draws(spark, sf), "draw_id"), "wide-draws")
    for block in range(2):
        first = block * DRAWS // 2 + 1
        stores.write_draw_block(drawn.filter(F.col("draw_id").between(first, first + DRAWS // 2 - 1)), f"{path}/draws", block)
    mapping = small_table(spark, _SERIES_ROWS, "cause_id string, series_id string, weight double")
    customers = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("c"))
    pops = [f"pop_{a}" for a in range(7)]
    population = _scoped(customers).select(*_CELL_BY, F.explode(F.array(*[F.lit(s) for s in ("done", "open", "all")])).alias("series_id"), *[(F.col("c") + 10 * a).cast("double").alias(p) for a, p in enumerate(pops)])
    ages = [f"age_{a}" for a in range(7)]
    point = materialise(_wide_ages(cells), "wide-points")
    # published points come from the long form, by another way than the draws
    long = point.unpivot([*_CELL_BY, "cause_id"], ages, "a", "deaths").withColumn("age", F.substring("a", 5, 2).cast("int"))
    by_age = long.join(mapping, "cause_id").groupBy(*_CELL_BY, "series_id", "age").agg(F.sum("deaths").alias("deaths"))
    dens = population.unpivot([*_CELL_BY, "series_id"], pops, "a", "population").withColumn("age", F.substring("a", 5, 2).cast("int")).drop("a")
    by_age = materialise(by_age.join(dens, [*_CELL_BY, "series_id", "age"]), "points")
    standard = small_table(spark, [(k + 1, w) for k, w in enumerate(_ASR_WEIGHTS)], "standard_age int, F double")
    keys = [*_CELL_BY, "series_id"]
    asr = rates.age_standardise(by_age, keys, "age", "deaths", "population", standard, ages=range(7)).select(*keys, F.lit(99).alias("age_id"), F.lit("asr").alias("measure"), F.col("ASR").alias("point"))
    specs = small_table(spark, [(a, c) for c, (n, _) in _AGE_SPECS.items() for a in n], "age int, age_id int")
    counts = by_age.join(specs, "age").groupBy(*keys, "age_id").agg(F.sum("deaths").alias("point")).select(*keys, "age_id", F.lit("count").alias("measure"), "point")
    part = long.groupBy(*_CELL_BY).agg((F.sum(F.when(F.col("cause_id") == "O", F.col("deaths"))) / F.sum("deaths")).alias("point"))
    part = part.select(*_CELL_BY, F.lit("open_of_all").alias("series_id"), F.lit(25).alias("age_id"), F.lit("fraction").alias("measure"), "point")
    i = intervals.IntervalInputs(
        _CELL_BY, ages, mapping, population, pops, _ASR_WEIGHTS, _AGE_SPECS, 99, counts.unionByName(asr).unionByName(part), point, {"open_of_all": (["O"], STATUSES)}
    )
    out = intervals.publish_intervals(spark, f"{path}/draws", f"{path}/intervals", i, DRAWS)
    names = ["age_id", "measure", "point", "mean", "median", "lower", "upper", "n_draws", "rate_point", "rate_lower", "rate_upper", "alignment"]
    return rounded(out.select("storage_scope", "sex_code", "nation", "series_id", *names), 4)


# ---------------------------------------------------------------- Gamma variates


def log_gamma_sql(key: str, shape: str) -> str:
    """Acceptance sampling on the same hash uniforms as the column expression."""
    d = f"(CASE WHEN {shape} < 1 THEN {shape} + 1 ELSE {shape} END - 1.0::DOUBLE / 3)"
    c = f"(1 / sqrt(9 * {d}))"
    v = f"power(1 + {c} * s.x, 3)"
    half = "0.5 / 4294967296.0::DOUBLE"
    numbers = f"list_transform(range(1, 17), lambda j: {{'x': {z_sql(key, 'j')}, 'u': {u_sql(key, 'j', chr(39) + 'u' + chr(39))} + {half}}})"
    tries = f"list_transform({numbers}, lambda s: CASE WHEN {v} > 0 THEN CASE WHEN ln(s.u) < 0.5 * s.x * s.x + {d} - {d} * {v} + {d} * ln({v}) THEN ln({d} * {v}) END END)"
    first = f"list_filter({tries}, lambda y: y IS NOT NULL)[1]"
    return f"({first} + CASE WHEN {shape} < 1 THEN ln({u_sql(key, chr(39) + 'boost' + chr(39))} + {half}) / {shape} ELSE 0 END)"


_DIRICHLET = f"""{cells_sql('regionkey', 'yr', 'priority')}, p AS (SELECT *, greatest(n / sum(n) OVER (PARTITION BY regionkey, yr), 2.220446049250313e-16) AS f, sum(n) OVER (PARTITION BY regionkey, yr) AS eff FROM cells),
  q AS (SELECT p.*, d, md5(concat_ws('|', '{SEED}', d, 'composition', regionkey, yr, priority)) AS k, greatest(f / sum(f) OVER (PARTITION BY regionkey, yr, d) * eff, 2.220446049250313e-16) AS shape FROM p, range(1, 21) t(d)),
  lg AS (SELECT *, {log_gamma_sql('k', 'shape')} AS lg FROM q), e AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY d, regionkey, yr)) AS e FROM lg)"""


@query(
    "dirichlet_composition_draws", "D7 M6",
    f"WITH {_DIRICHLET} SELECT CAST(d AS INTEGER) AS draw_id, regionkey, yr, priority, round(e / sum(e) OVER (PARTITION BY d, regionkey, yr), 6) AS draw_fraction FROM e",
)
def dirichlet_composition_draws(spark, sf):
    cells = order_cells(spark, sf, "regionkey", "yr", "priority")
    x = compose.share(cells, ["regionkey", "yr"], "n", "f")
    size = cells.groupBy("regionkey", "yr").agg(F.sum("n").alias("eff"))
    return rounded(draws.dirichlet_draws(x.join(size, ["regionkey", "yr"]), ["regionkey", "yr"], "priority", "f", "eff", 1, 20, SEED))


def _weighted_step(name: str, prev: str, on: str, src: int, targets: dict[int, str]) -> str:
    """One move in proportion to weighted targets, or to the weights alone where the targets are empty."""
    mass, total = " + ".join(f"c{t} * {w}" for t, w in targets.items()), " + ".join(targets.values())
    cols = []
    for i in range(1, 7):
        if i == src:
            cols.append(f"CASE WHEN {on} THEN 0 ELSE c{i} END AS c{i}")
        elif i in targets:
            w = targets[i]
            cols.append(f"CASE WHEN {on} THEN c{i} + c{src} * CASE WHEN {mass} > 0 THEN c{i} * {w} / ({mass}) ELSE {w} / ({total}) END ELSE c{i} END AS c{i}")
        else:
            cols.append(f"c{i}")
    return f"{name} AS (SELECT d, band, yr, {', '.join(cols)}, a1, a3, b2, b6, e2, e3, e6 FROM {prev})"


_SLOTS = [("promo_small_band", 1, "a1", 0.25), ("promo_small_band", 3, "a3", 0.25), ("promo_large_band", 2, "b2", 0.25), ("promo_large_band", 6, "b6", 0.25)]
_SLOTS += [("economy_late", t, f"e{t}", 0.28888888888888886) for t in (2, 3, 6)]
_WEIGHTED = f"""{TYPES_SQL}, slot AS (SELECT * FROM {values(_SLOTS, 'rule_id', 'target', 'name', 'shape')}),
  key AS (SELECT slot.*, d, md5(concat_ws('|', '{SEED}', d, 'targets', rule_id, target)) AS k FROM slot, range(1, 21) t(d)),
  g AS (SELECT *, greatest(exp({log_gamma_sql('k', 'shape')}) / shape, 2.2250738585072014e-308) AS g FROM key),
  w AS (SELECT *, g / avg(g) OVER (PARTITION BY d, rule_id) AS w FROM g),
  m AS (SELECT d, {', '.join(f"max(w) FILTER (name = '{n}') AS {n}" for _, _, n, _ in _SLOTS)} FROM w GROUP BY d),
  s0 AS (SELECT m.*, x.* FROM m, (SELECT band, yr, {', '.join(f'CAST(count(*) FILTER (code = {i}) AS DOUBLE) AS c{i}' for i in range(1, 7))} FROM typed GROUP BY ALL) x),
  {_weighted_step('s1', 's0', 'band <= 2', 4, {1: 'a1', 3: 'a3'})}, {_weighted_step('s2', 's1', 'band > 2', 4, {2: 'b2', 6: 'b6'})},
  {_weighted_step('s3', 's2', 'TRUE', 5, {6: '1'})}, {_weighted_step('s4', 's3', 'yr >= 1999', 1, {2: 'e2', 3: 'e3', 6: 'e6'})}"""


@query(
    "stochastic_rule_weights", "D9 D16 R7",
    f"WITH {_WEIGHTED} SELECT CAST(d AS INTEGER) AS draw_id, band, yr, {', '.join(f'round(c{i}, 5) AS c{i}' for i in range(1, 7))} FROM s4",
)
def stochastic_rule_weights(spark, sf):
    wide = grid.pivot_codes(type_cells(spark, sf), ["band", "yr"], "code", list(range(1, 7)), "n")
    mult = draws.rule_multipliers(spark, TYPE_RULES, 1, 20, SEED)
    x = draws.with_draws(wide, 1, 20).join(mult, "draw_id", "left")
    return rounded(redistribute.apply_move_rules(x, TYPE_RULES, multipliers="multipliers").drop("multipliers"), 5)


@query(
    "stochastic_rule_weight_audit", "D16 D9",
    f"""WITH {_WEIGHTED}, mv AS (SELECT 1 AS step, 'promo_small_band' AS rule_id, 2 AS targets, d, coalesce(sum(c4) FILTER (band <= 2), 0) AS moved FROM s0 GROUP BY d
      UNION ALL SELECT 2, 'promo_large_band', 2, d, coalesce(sum(c4) FILTER (band > 2), 0) FROM s1 GROUP BY d UNION ALL SELECT 3, 'small_to_standard', 1, d, sum(c5) FROM s2 GROUP BY d
      UNION ALL SELECT 4, 'economy_late', 3, d, coalesce(sum(c1) FILTER (yr >= 1999), 0) FROM s3 GROUP BY d),
      per AS (SELECT d, rule_id, min(w) AS lo, max(w) AS hi, avg(w) AS m, stddev_samp(w) AS sd FROM w GROUP BY ALL), sp AS (SELECT avg(sd / m) AS cv, min(lo) AS lo, max(hi) AS hi FROM per)
    SELECT step, rule_id, targets, count(*) AS draws, round(avg(moved), 4) AS mean_moved, round(min(moved), 4) AS min_moved, round(max(moved), 4) AS max_moved,
      round(any_value(cv), 4) AS mean_multiplier_cv, round(any_value(lo), 4) AS min_multiplier, round(any_value(hi), 4) AS max_multiplier FROM mv, sp GROUP BY step, rule_id, targets""",
)
def stochastic_rule_weight_audit(spark, sf):
    """Mass that each rule moves in each draw of the target weights, and how the weights spread."""
    wide = materialise(grid.pivot_codes(type_cells(spark, sf), ["band", "yr"], "code", list(range(1, 7)), "n"), "cells")
    mult = materialise(draws.rule_multipliers(spark, TYPE_RULES, 1, 20, SEED), "multipliers")
    x = draws.with_draws(wide, 1, 20).join(mult, "draw_id", "left")
    moved = redistribute.moved_by_rule(x, TYPE_RULES, ["draw_id"], multipliers="multipliers")
    spread = draws.multiplier_audit(mult).select("mean_multiplier_cv", "min_multiplier", "max_multiplier")
    per = moved.groupBy("step", "rule_id", "targets").agg(
        F.count("*").alias("draws"), F.avg("moved").alias("mean_moved"), F.min("moved").alias("min_moved"), F.max("moved").alias("max_moved")
    )
    return rounded(grid.attach_all(per, spread), 4)
