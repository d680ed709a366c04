"""Grouped regressions and the reallocation of misclassified counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import draws, regress
from tallyloom.plans.reallocation import Reallocation, reallocate
from tallyloom.queries.inputs import LINES_SUPPLIER, STATUSES, UNKNOWN_PRIORITY, cells_sql, lines_supplier, order_cells, table, values
from tallyloom.queries.registry import query, rounded
from tallyloom.queries.surveys import z_sql
from tallyloom.session import materialise

SEED = 20200101


def counts_and_exposure(spark, sf):
    """Orders per nation and year with supplier lines as exposure."""
    cells = order_cells(spark, sf, "nation", "yr", "status")
    e = lines_supplier(spark, sf).groupBy("nation", "yr").agg(F.count("*").cast("double").alias("exposure"))
    return cells.join(e, ["nation", "yr"])


_CE = f"""{cells_sql('nation', 'yr', 'status')}, {LINES_SUPPLIER}, ex AS (SELECT nation, yr, CAST(count(*) AS DOUBLE) AS exposure FROM ls GROUP BY ALL),
  ce AS (SELECT cells.*, exposure FROM cells JOIN ex USING (nation, yr))"""

_OLS = """SELECT {k}, count(*) AS n, CASE WHEN count(*) >= 2 AND max(x) > min(x) THEN regr_intercept(y, x) END AS intercept, CASE WHEN count(*) >= 2 AND max(x) > min(x) THEN regr_slope(y, x) END AS slope,
  CASE WHEN count(*) > 2 AND max(x) > min(x) THEN greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(*) - 2) * (1.0 / count(*) + avg(x) * avg(x) / regr_sxx(y, x)) END AS iv, median(y) AS med"""


@query(
    "ols_counts_on_exposure", "M12 M13",
    f"""WITH {_CE}, xy AS (SELECT nation, status, exposure / 100 AS x, n AS y FROM ce), f AS ({_OLS.format(k='nation, status')} FROM xy GROUP BY ALL)
    SELECT nation, status, n, round(intercept, 5) AS intercept, round(slope, 5) AS slope, round(iv, 5) AS intercept_variance, round(med, 5) AS median_y FROM f""",
)
def ols_counts_on_exposure(spark, sf):
    x = counts_and_exposure(spark, sf).select("nation", "status", (F.col("exposure") / 100).alias("x"), F.col("n").alias("y"))
    return rounded(regress.ols(x, ["nation", "status"], "x", "y"), 5)


@query(
    "fractional_base_year", "M12",
    f"""WITH {_CE}, t AS (SELECT nation, yr, sum(n) / any_value(exposure) AS x FROM ce GROUP BY ALL), f AS (SELECT nation, CASE WHEN count(*) >= 2 AND max(x) > min(x) THEN regr_intercept(yr, x) END AS i FROM t GROUP BY nation)
    SELECT round(min(CASE WHEN i < 1997 THEN i ELSE 1997 END), 4) AS base_year, count(*) AS nations FROM f""",
)
def fractional_base_year(spark, sf):
    x = counts_and_exposure(spark, sf).groupBy("nation", "yr").agg(F.sum("n").alias("n"), F.max("exposure").alias("e"))
    x = x.withColumn("x", F.col("n") / F.col("e"))
    b = regress.base_year(x, ["nation"], "x", "yr", 1997.0)
    return rounded(b.withColumn("nations", x.select(F.count_distinct("nation").alias("c")).scalar()), 4)


@query(
    "zero_exposure_intercepts", "M13",
    f"""WITH {_CE}, xy AS (SELECT nation, status, exposure / 100 AS x, n AS y FROM ce), f AS ({_OLS.format(k='nation, status')} FROM xy GROUP BY ALL)
    SELECT nation, status, n, round(greatest(0, coalesce(intercept, med, 0)), 5) AS intercept, round(intercept, 5) AS linear_intercept, round(iv, 5) AS intercept_variance, CASE WHEN intercept IS NOT NULL THEN 'linear_model' ELSE 'fixed_fallback' END AS status_label FROM f""",
)
def zero_exposure_intercepts(spark, sf):
    x = counts_and_exposure(spark, sf).select("nation", F.col("status").alias("grp"), (F.col("exposure") / 100).alias("x"), F.col("n").alias("y"))
    out = regress.zero_intercepts(x, ["nation", "grp"], "x", "y").withColumnRenamed("status", "status_label").withColumnRenamed("grp", "status")
    return rounded(out, 5)


@query(
    "zero_exposure_intercepts_log", "M13",
    f"""WITH {_CE}, xy AS (SELECT nation, exposure / 100 AS x, ln(sum(n)) AS y, sum(n) AS r FROM ce GROUP BY nation, yr, exposure), f AS ({_OLS.format(k='nation')}, median(r) AS mr FROM xy GROUP BY ALL)
    SELECT nation, n, round(greatest(0, coalesce(exp(intercept), mr, 0)), 4) AS intercept, round(intercept, 4) AS linear_intercept, round(iv, 4) AS intercept_variance, CASE WHEN intercept IS NOT NULL THEN 'log_linear_model' ELSE 'fixed_fallback' END AS status FROM f""",
)
def zero_exposure_intercepts_log(spark, sf):
    x = counts_and_exposure(spark, sf).groupBy("nation", "yr").agg(F.sum("n").alias("r"), F.max(F.col("exposure") / 100).alias("x"))
    return rounded(regress.zero_intercepts(x, ["nation"], "x", "r", log_scale=True), 4)


_POIS = f"""{_CE}, pd AS (SELECT nation, status, ln(1 + yr - 1994) AS x, n AS y, ln(exposure) AS o FROM ce),
  pg AS (SELECT nation, status, list({{'x': x, 'y': y, 'o': o}}) AS p, ln(sum(y) / sum(exp(o))) AS a0, count(*) AS points FROM pd GROUP BY ALL HAVING count(*) >= 2 AND sum(y) > 0),
  pit AS (WITH RECURSIVE it AS (SELECT nation, status, p, points, a0 AS a, 0.0::DOUBLE AS b, 0 AS i FROM pg
    UNION ALL SELECT nation, status, p, points, a + (h2 * u0 - h1 * u1) / (h0 * h2 - h1 * h1), b + (h0 * u1 - h1 * u0) / (h0 * h2 - h1 * h1), i + 1 FROM (
      SELECT *, list_sum(list_transform(p, lambda q: q.y - exp(q.o + a + b * q.x))) AS u0, list_sum(list_transform(p, lambda q: q.x * (q.y - exp(q.o + a + b * q.x)))) AS u1,
        list_sum(list_transform(p, lambda q: exp(q.o + a + b * q.x))) AS h0, list_sum(list_transform(p, lambda q: q.x * exp(q.o + a + b * q.x))) AS h1, list_sum(list_transform(p, lambda q: q.x * q.x * exp(q.o + a + b * q.x))) AS h2
      FROM it WHERE i < 25))
    SELECT nation, status, points, a, b, list_sum(list_transform(p, lambda q: exp(q.o + a + b * q.x))) AS h0, list_sum(list_transform(p, lambda q: q.x * exp(q.o + a + b * q.x))) AS h1, list_sum(list_transform(p, lambda q: q.x * q.x * exp(q.o + a + b * q.x))) AS h2 FROM it WHERE i = 25)"""


def poisson(spark, sf):
    x = counts_and_exposure(spark, sf).withColumn("x", F.log(1.0 + F.col("yr") - 1994))
    return regress.poisson_trend(x, ["nation", "status"], "x", "n", "exposure")


@query(
    "poisson_trends_with_offset", "M14",
    f"""WITH {_POIS} SELECT nation, status, round(a, 5) AS constant, round(b, 5) AS g, round(h2 / (h0 * h2 - h1 * h1), 5) AS var_constant, round(h0 / (h0 * h2 - h1 * h1), 5) AS var_g, round(-h1 / (h0 * h2 - h1 * h1), 5) AS cov, 'full_interaction' AS model_status, points FROM pit""",
)
def poisson_trends_with_offset(spark, sf):
    return rounded(poisson(spark, sf), 5)


# nation effects have the closed form ln(counts / fitted), so Newton moves the slope alone
_COMMON = """ml AS (SELECT status, nation, sum(y) AS t, sum(x * y) AS xy, list({'x': x, 'o': o}) AS p FROM pd GROUP BY ALL HAVING sum(y) > 0),
  mg AS (SELECT status, list({'t': t, 'xy': xy, 'p': p}) AS ls FROM ml GROUP BY ALL),
  mit AS (WITH RECURSIVE it AS (SELECT status, ls, 0.0::DOUBLE AS g, 0.0::DOUBLE AS v, 0 AS i FROM mg
    UNION ALL SELECT status, ls, g + list_sum(list_transform(m, lambda q: q.xy - q.t * q.m1 / q.m0)) / list_sum(list_transform(m, lambda q: q.t * (q.m2 / q.m0 - power(q.m1 / q.m0, 2)))),
      1 / list_sum(list_transform(m, lambda q: q.t * (q.m2 / q.m0 - power(q.m1 / q.m0, 2)))), i + 1
    FROM (SELECT *, list_transform(ls, lambda l: {'t': l.t, 'xy': l.xy, 'm0': list_sum(list_transform(l.p, lambda q: exp(q.o + g * q.x))), 'm1': list_sum(list_transform(l.p, lambda q: q.x * exp(q.o + g * q.x))),
      'm2': list_sum(list_transform(l.p, lambda q: q.x * q.x * exp(q.o + g * q.x)))}) AS m FROM it WHERE i < 20))
    SELECT status, g, v FROM it WHERE i = 20)"""


def common_slopes(spark, sf):
    x = counts_and_exposure(spark, sf).withColumn("x", F.log(1.0 + F.col("yr") - 1994))
    return x, regress.poisson_main_effects(x, ["status"], "x", ["nation"], "n", "exposure")


@query(
    "poisson_common_slopes", "M14",
    f"""WITH {_POIS}, {_COMMON} SELECT status, round(g, 6) AS g, round(v, 7) AS var_g, rows FROM mit JOIN (SELECT status, count(*) AS rows FROM pd GROUP BY 1) USING (status)""",
)
def poisson_common_slopes(spark, sf):
    fit = common_slopes(spark, sf)[1]
    return fit.select("status", F.round("g", 6).alias("g"), F.round("var_g", 7).alias("var_g"), "rows")


# the odd nations' counts are withheld from the full model, so that the common slope takes its place there
@query(
    "poisson_main_effects_fallback", "M14",
    f"""WITH {_POIS}, {_COMMON}, k AS (SELECT DISTINCT nation, status FROM pd)
    SELECT k.nation, k.status, round(CASE WHEN k.nation % 2 = 1 OR pit.b IS NULL THEN mit.g ELSE b END, 6) AS g,
      round(CASE WHEN k.nation % 2 = 1 OR pit.b IS NULL THEN mit.v ELSE h0 / (h0 * h2 - h1 * h1) END, 6) AS var_g,
      CASE WHEN k.nation % 2 = 1 OR pit.b IS NULL THEN 'main_effect_fallback' ELSE 'full_interaction' END AS model_status
    FROM k LEFT JOIN pit USING (nation, status) LEFT JOIN mit USING (status)""",
)
def poisson_main_effects_fallback(spark, sf):
    x, common = common_slopes(spark, sf)
    odd = F.col("nation") % 2 == 1
    full = regress.poisson_trend(x.withColumn("n", F.when(odd, 0).otherwise(F.col("n"))), ["nation", "status"], "x", "n", "exposure")
    out = regress.with_fallback(full, common, ["nation", "status"], ["status"])
    return out.select("nation", "status", F.round("g", 6).alias("g"), F.round("var_g", 6).alias("var_g"), "model_status")


# causes are priorities; the two most urgent form the modelled group
_CODES = ["1-URGENT", "2-HIGH"]
_BASE = f"""{cells_sql('nation', 'yr', 'priority')}, b AS (SELECT g.nation, p.priority, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT nation FROM cells WHERE yr = 1995) g
    CROSS JOIN {values([(c,) for c in _CODES], 'priority').replace('AS v', 'AS p')} LEFT JOIN cells c ON c.nation = g.nation AND c.priority = p.priority AND c.yr = 1995 GROUP BY ALL),
  ic AS (SELECT nation, 2.0 + nation AS intercept FROM (SELECT DISTINCT nation FROM cells)),
  ci AS (SELECT b.nation, priority, CASE WHEN sum(n) OVER (PARTITION BY b.nation) > 0 THEN n / sum(n) OVER (PARTITION BY b.nation) END * coalesce(intercept, 0) AS cause_intercept FROM b LEFT JOIN ic USING (nation))"""


def cause_intercepts(spark, sf, cells=None):
    if cells is None:
        cells = materialise(order_cells(spark, sf, "nation", "yr", "priority"), "cells")
    ic = cells.select("nation").distinct().withColumn("intercept", 2.0 + F.col("nation"))
    return cells, regress.intercept_by_cause(cells.filter("yr = 1995").filter(F.col("priority").isin(_CODES)), ["nation"], "priority", _CODES, "n", ic)


@query(
    "intercepts_shared_by_cause", "M15 J7 W1",
    f"WITH {_BASE} SELECT nation, priority, round(CAST(cause_intercept AS DOUBLE), 6) AS cause_intercept FROM ci",
)
def intercepts_shared_by_cause(spark, sf):
    return rounded(cause_intercepts(spark, sf)[1])


_EXC = f"""{_BASE}, pop AS (SELECT c_nationkey AS nation, CAST(count(*) AS DOUBLE) * 100000 AS population FROM customer GROUP BY 1),
  ex0 AS (SELECT c.nation, c.yr, c.priority, c.n, population, CAST(cause_intercept * power(1 + greatest(0, c.yr - 1995.5), 0.5 * 0.2) / 20 * population / 1e5 AS DOUBLE) AS e FROM cells c JOIN pop USING (nation) LEFT JOIN ci USING (nation, priority) WHERE c.priority IN ('1-URGENT', '2-HIGH')),
  ex AS (SELECT nation, yr, priority, n, CASE WHEN e IS NULL OR e > n OR yr >= 2001 THEN n ELSE e END AS expected FROM ex0)"""


def excess_rows(spark, sf, cells=None):
    cells, ci = cause_intercepts(spark, sf, cells)
    pop = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg((F.count("*") * 100000.0).alias("population"))
    panel = cells.filter(F.col("priority").isin(_CODES)).join(pop, "nation")
    trends = panel.select("nation", "priority").distinct().withColumns({"g": F.lit(0.2), "model_status": F.lit("full_interaction")})
    ci = ci.withColumn("cause_intercept", F.col("cause_intercept") / 20)
    return regress.expected_and_excess(
        panel, trends, ci, ["nation", "priority"], ["nation", "priority"], "yr", "n", "population", F.lit(0.5), 1995.5, F.col("yr") >= 2001
    )


@query(
    "expected_background_and_excess", "M16 P22",
    f"WITH {_EXC} SELECT nation, yr, priority, n, round(expected, 5) AS expected, round(greatest(0, n - expected), 5) AS excess FROM ex",
)
def expected_background_and_excess(spark, sf):
    return rounded(excess_rows(spark, sf).select("nation", "yr", "priority", "n", "expected", "excess"), 5)


_ALLOC = f"""{_EXC}, og2 AS (SELECT nation, yr, priority, status, CAST(count(*) AS DOUBLE) AS n FROM og GROUP BY ALL),
  src AS (SELECT * FROM og2 WHERE priority IN ('1-URGENT', '2-HIGH')), dt AS (SELECT nation, yr, priority, sum(greatest(0, n - expected)) AS d FROM ex GROUP BY ALL),
  al AS (SELECT g.nation, g.yr, g.priority, s.status, coalesce(x.n, 0) AS n, coalesce(d, 0) AS d, sum(coalesce(x.n, 0)) OVER (PARTITION BY g.nation, g.yr, g.priority) AS t
    FROM (SELECT nation, yr, priority FROM src UNION SELECT nation, yr, priority FROM dt) g CROSS JOIN {values([(s,) for s in STATUSES], 'status').replace('AS v', 'AS s')}
    LEFT JOIN src x ON x.nation = g.nation AND x.yr = g.yr AND x.priority = g.priority AND x.status = s.status LEFT JOIN dt ON dt.nation = g.nation AND dt.yr = g.yr AND dt.priority = g.priority),
  mv AS (SELECT *, least(n, greatest(0, d * CASE WHEN t > 0 THEN n / t ELSE 1.0 / 3 END)) AS moved FROM al)"""


def allocation(spark, sf):
    # the orders are read once; everything below works on their cells
    groups = materialise(order_cells(spark, sf, "nation", "yr", "priority", "status"), "cells")
    cells = groups.groupBy("nation", "yr", "priority").agg(F.sum("n").alias("n"))
    a = regress.allocate_excess(groups.filter(F.col("priority").isin(_CODES)), excess_rows(spark, sf, cells), ["nation", "yr", "priority"], "status", STATUSES, "n", "excess")
    return groups, a


@query(
    "excess_allocated_to_groups", "M17 J7",
    f"WITH {_ALLOC} SELECT nation, yr, priority, status, n, round(moved, 5) AS transferred, round(n - moved, 5) AS retained FROM mv",
)
def excess_allocated_to_groups(spark, sf):
    return rounded(allocation(spark, sf)[1].select("nation", "yr", "priority", "status", "n", "transferred", "retained"), 5)


@query(
    "reassembled_after_reallocation", "M18 M19 O4 V5",
    f"""WITH {_ALLOC}, allr AS (SELECT nation, yr, status, priority, n FROM og2 WHERE priority NOT IN ('1-URGENT', '2-HIGH')
      UNION ALL SELECT nation, yr, status, '3-MEDIUM', n - moved FROM mv WHERE priority = '1-URGENT' UNION ALL SELECT nation, yr, status, '2-HIGH', n - moved FROM mv WHERE priority = '2-HIGH'
      UNION ALL SELECT nation, yr, status, '{UNKNOWN_PRIORITY}', moved FROM mv)
    SELECT nation, yr, status, priority, round(sum(n), 5) AS n FROM allr GROUP BY ALL""",
)
def reassembled_after_reallocation(spark, sf):
    groups, a = allocation(spark, sf)
    out = regress.reassemble(
        groups, a, ["nation", "yr", "status"], "priority", "n", _CODES, {"1-URGENT": "3-MEDIUM", "2-HIGH": "2-HIGH"}, UNKNOWN_PRIORITY
    )
    return rounded(out.select("nation", "yr", "status", "priority", "n"), 5)


@query("end_to_end_reallocation", "M19 M14 M13 M15 M16 M17 M18")
def end_to_end_reallocation(spark, sf):
    cells = order_cells(spark, sf, "nation", "segment", "yr", "priority", "status")
    exposure = lines_supplier(spark, sf).groupBy("nation", "yr").agg(F.count("*").cast("double").alias("population"))
    prevalence = order_cells(spark, sf, "nation", "yr").withColumn("prevalence", F.col("n") / 1000).drop("n")
    spec = Reallocation(
        place="nation", sex="segment", year="yr", code="priority", member="status", members=STATUSES, value="n", model_codes=_CODES,
        destination={"1-URGENT": "1-URGENT", "2-HIGH": "2-HIGH"}, receiver=UNKNOWN_PRIORITY, base=1994.5, base_period=1995, early=(1995, 1999),
    )
    return reallocate(cells, exposure, prevalence, spec)


@query(
    "slope_draws_from_covariance", "D8 M14",
    f"""WITH {_POIS} SELECT CAST(d AS INTEGER) AS draw_id, nation, status, round(b + sqrt(greatest(h0 / (h0 * h2 - h1 * h1), 0)) * {z_sql(str(SEED), 'd', "'trend'", 'nation', 'status')}, 5) AS g FROM pit, range(1, 21) t(d)""",
)
def slope_draws_from_covariance(spark, sf):
    drawn = draws.draw_slopes(poisson(spark, sf), ["nation", "status"], 1, 20, SEED, shared=["status"])
    return rounded(drawn.select("draw_id", "nation", "status", "g"), 5)


@query(
    "intercept_draws", "D8 M13",
    f"""WITH {_CE}, xy AS (SELECT nation, status AS grp, exposure / 100 AS x, n AS y FROM ce), f AS ({_OLS.format(k='nation, grp')} FROM xy GROUP BY ALL)
    SELECT CAST(d AS INTEGER) AS draw_id, nation, grp, round(greatest(0, CASE WHEN iv IS NOT NULL AND intercept IS NOT NULL THEN intercept + sqrt(greatest(iv, 0)) * {z_sql(str(SEED), 'd', "'intercept'", 'nation', 'grp')}
      ELSE greatest(0, coalesce(intercept, med, 0)) END), 4) AS intercept FROM f, range(1, 21) t(d)""",
)
def intercept_draws(spark, sf):
    x = counts_and_exposure(spark, sf).select("nation", F.col("status").alias("grp"), (F.col("exposure") / 100).alias("x"), F.col("n").alias("y"))
    fit = regress.zero_intercepts(x, ["nation", "grp"], "x", "y")
    drawn = draws.draw_intercepts(fit, ["nation", "grp"], 1, 20, SEED)
    return rounded(drawn.select("draw_id", "nation", "grp", "intercept"), 4)


@query(
    "multivariate_coefficient_draws", "D8",
    f"""WITH {_POIS}, v AS (SELECT *, h2 / (h0 * h2 - h1 * h1) AS va, -h1 / (h0 * h2 - h1 * h1) AS vab, h0 / (h0 * h2 - h1 * h1) AS vb FROM pit),
      z AS (SELECT *, {z_sql(str(SEED), 'd', "'pair'", 'nation', 'status', "'1'")} AS z1, {z_sql(str(SEED), 'd', "'pair'", 'nation', 'status', "'2'")} AS z2 FROM v, range(1, 21) t(d))
    SELECT CAST(d AS INTEGER) AS draw_id, nation, status, round(a + sqrt(va) * z1, 5) AS constant, round(b + vab / sqrt(va) * z1 + sqrt(greatest(vb - vab * vab / va, 0)) * z2, 5) AS g FROM z""",
)
def multivariate_coefficient_draws(spark, sf):
    fit = draws.with_draws(poisson(spark, sf).filter("g IS NOT NULL"), 1, 20)
    key = (SEED, F.col("draw_id"), "pair", F.col("nation"), F.col("status"))
    a, b = draws.draw_pair(*[F.col(c) for c in ("constant", "g", "var_constant", "cov", "var_g")], *key)
    return rounded(fit.select("draw_id", "nation", "status", a.alias("constant"), b.alias("g")), 5)
