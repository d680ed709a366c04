"""Compositions: smoothing, interpolation, log ratios and annual fraction panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import aggregate, compose, grid
from tallyloom.queries.inputs import LINES_PART, P_TYPES, STATUSES, YEARS, cells_sql, in_list, lines_part, order_cells, values
from tallyloom.queries.registry import query, rounded

ANCHORS = [1996, 1998, 2000]
TREE = compose.CompositionTree({"basic": ["ECONOMY", "SMALL", "STANDARD"], "premium": ["LARGE", "PROMO"], "mid": ["MEDIUM"]}, "STANDARD")
_SMOOTH = compose.smoothing_weights(YEARS, 5)
_INTERP = compose.interpolation_weights(YEARS, ANCHORS)
_CHAIN = compose.chain_weights(compose.smoothing_weights(YEARS, 3), _INTERP)


def _w(weights, target="yr", source="src"):
    return f"(SELECT * FROM {values([(i, j, w) for (i, j), w in sorted(weights.items())], target, source, 'w')})"


@query(
    "triangular_smoothing_over_years", "W3",
    f"WITH {cells_sql('nation', 'yr')} SELECT nation, CAST(w.yr AS INTEGER) AS yr, round(CAST(sum(n * w.w) AS DOUBLE), 6) AS n FROM cells c JOIN {_w(_SMOOTH)} w ON w.src = c.yr GROUP BY ALL",
)
def triangular_smoothing_over_years(spark, sf):
    return rounded(compose.apply_weights(order_cells(spark, sf, "nation", "yr"), _SMOOTH, ["nation"], "yr", "n"))


@query(
    "anchor_interpolation_over_years", "W4",
    f"WITH {cells_sql('nation', 'yr')} SELECT nation, CAST(w.yr AS INTEGER) AS yr, round(CAST(sum(n * w.w) AS DOUBLE), 6) AS n FROM cells c JOIN {_w(_INTERP)} w ON w.src = c.yr GROUP BY ALL",
)
def anchor_interpolation_over_years(spark, sf):
    return rounded(compose.apply_weights(order_cells(spark, sf, "nation", "yr"), _INTERP, ["nation"], "yr", "n"))


@query(
    "softmax_of_log_counts", "W5",
    f"""WITH {LINES_PART}, c AS (SELECT brand, ptype, ln(count(*)) / 2 AS s FROM lp GROUP BY ALL)
    SELECT brand, ptype, round(exp(s) / sum(exp(s)) OVER (PARTITION BY brand), 6) AS p FROM c""",
)
def softmax_of_log_counts(spark, sf):
    x = lines_part(spark, sf).groupBy("brand", "ptype").agg((F.log(F.count("*").cast("double")) / 2).alias("s"))
    return rounded(compose.softmax(x, ["brand"], "s", "p").drop("s"))


@query(
    "source_zero_flags", "M5 A17",
    f"""WITH {cells_sql('nation', 'mon', 'yr', 'status')}, g AS (SELECT nation, yr, mon, count(*) FILTER (status = 'F') AS f, sum(n) FILTER (status = 'F') AS v FROM cells GROUP BY ALL)
    SELECT nation, yr, mon, f = 0 AS source_zero, round(greatest(coalesce(v, 0), 0.5), 6) AS n FROM g""",
)
def source_zero_flags(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "mon", "status").withColumn("n", F.when(F.col("status") == "F", F.col("n")))
    return rounded(compose.floor_counts(cells, ["nation", "yr", "mon"], "n", 0.5))


# ---------------------------------------------------------------- survey fractions with donors

_STRATA = ["nation", "yr", "mon"]
_LEVELS = {"nation_year": ["nation", "yr"], "year": ["yr"], "all": []}
_FR_SQL = f"""{cells_sql('nation', 'regionkey', 'yr', 'mon', 'status', 'priority')},
  o AS (SELECT nation, yr, mon, status, sum(n) FILTER (priority = '1-URGENT') AS v, sum(n) AS m FROM cells GROUP BY ALL),
  g AS (SELECT s.nation, s.yr, s.mon, k.status, coalesce(o.v, 0) AS v, s.eff FROM (SELECT nation, yr, mon, sum(m) AS eff FROM o GROUP BY ALL) s
    CROSS JOIN {values([(s,) for s in STATUSES], 'status').replace('AS v', 'AS k')} LEFT JOIN o ON o.nation = s.nation AND o.yr = s.yr AND o.mon = s.mon AND o.status = k.status),
  t AS (SELECT *, sum(v) OVER (PARTITION BY nation, yr, mon) AS tot FROM g),
  l1 AS (SELECT nation, yr, status, sum(v) AS v FROM t GROUP BY ALL), t1 AS (SELECT nation, yr, sum(v) AS tv FROM l1 GROUP BY ALL),
  e1 AS (SELECT nation, yr, sum(eff) AS e FROM (SELECT DISTINCT nation, yr, mon, eff FROM t) GROUP BY ALL),
  l2 AS (SELECT yr, status, sum(v) AS v FROM t GROUP BY ALL), t2 AS (SELECT yr, sum(v) AS tv FROM l2 GROUP BY ALL),
  e2 AS (SELECT yr, sum(eff) AS e FROM (SELECT DISTINCT nation, yr, mon, eff FROM t) GROUP BY ALL),
  fr AS (SELECT t.nation, t.yr, t.mon, t.status, CASE WHEN tot > 0 THEN t.v / tot WHEN t1.tv > 0 THEN l1.v / t1.tv ELSE l2.v / t2.tv END AS fraction,
    CASE WHEN tot > 0 THEN 'own' WHEN t1.tv > 0 THEN 'borrowed:nation_year' ELSE 'borrowed:year' END AS fraction_source,
    CASE WHEN tot > 0 THEN eff WHEN t1.tv > 0 THEN e1.e ELSE e2.e END AS effective_n
    FROM t LEFT JOIN l1 USING (nation, yr, status) LEFT JOIN t1 USING (nation, yr) LEFT JOIN e1 USING (nation, yr)
    LEFT JOIN l2 ON l2.yr = t.yr AND l2.status = t.status LEFT JOIN t2 ON t2.yr = t.yr LEFT JOIN e2 ON e2.yr = t.yr)"""


def borrowed_fractions(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "mon", "status", "priority")
    obs = cells.groupBy(*_STRATA, "status").agg(
        F.sum(F.when(F.col("priority") == "1-URGENT", F.col("n")).otherwise(0.0)).alias("v"), F.sum("n").alias("m")
    )
    size = obs.groupBy(*_STRATA).agg(F.sum("m").alias("eff"))
    counts = grid.complete_codes(obs, _STRATA, "status", STATUSES, "v").join(size, _STRATA)
    return compose.counts_to_fractions(counts, _STRATA, "status", STATUSES, "v", _LEVELS, "eff")


@query(
    "fractions_with_borrowed_donors", "M6 J8 W1",
    f"WITH {_FR_SQL} SELECT nation, yr, mon, status, round(fraction, 6) AS fraction, fraction_source, round(effective_n, 6) AS effective_n FROM fr",
)
def fractions_with_borrowed_donors(spark, sf):
    return rounded(borrowed_fractions(spark, sf).select(*_STRATA, "status", "fraction", "fraction_source", "effective_n"))


@query(
    "borrowing_diagnostics", "Q12 M6",
    f"""WITH {_FR_SQL} SELECT yr, count(*) AS cells, count(*) FILTER (fraction_source <> 'own') AS borrowed, round(avg(fraction), 6) AS mean_fraction,
      round(quantile_cont(fraction, 0.95), 6) AS p95_fraction, round(max(fraction), 6) AS max_fraction FROM fr GROUP BY yr""",
)
def borrowing_diagnostics(spark, sf):
    x = borrowed_fractions(spark, sf)
    return rounded(x.groupBy("yr").agg(
        F.count("*").alias("cells"), F.count_if(F.col("fraction_source") != "own").alias("borrowed"), F.avg("fraction").alias("mean_fraction"),
        F.percentile("fraction", F.lit(0.95)).alias("p95_fraction"), F.max("fraction").alias("max_fraction"),
    ))


# ---------------------------------------------------------------- anchors, corrections, log ratios

_AF_SQL = f"""{LINES_PART}, af AS (SELECT linestatus, yr, ptype, sum(qty) AS q, count(*) AS c FROM lp WHERE yr IN {in_list(ANCHORS)} GROUP BY ALL),
  fx AS (SELECT linestatus, yr, ptype, q / sum(q) OVER (PARTITION BY linestatus, yr) AS f, CAST(sum(c) OVER (PARTITION BY linestatus, yr) AS DOUBLE) AS eff FROM af)"""


def anchor_fractions(spark, sf):
    x = lines_part(spark, sf).filter(F.col("yr").isin(ANCHORS)).groupBy("linestatus", "yr", "ptype").agg(F.sum("qty").alias("q"), F.count("*").cast("double").alias("c"))
    x = compose.share(x, ["linestatus", "yr"], "q", "f")
    n = x.groupBy("linestatus", "yr").agg(F.sum("c").alias("eff"))
    return x.join(n, ["linestatus", "yr"]).select("linestatus", "yr", "ptype", "f", "eff")


CORRECTIONS = [
    compose.AnchorCorrection(1, target=1996, middle=1998, far=2000, require_source_zero=True),
    compose.AnchorCorrection(4, target=2000, middle=1998, far=1996, require_far_positive=True),
]


@query(
    "anchor_corrections", "M7 W8",
    f"""WITH {_AF_SQL}, w AS (SELECT linestatus, CAST(list_position({P_TYPES}, ptype) AS INTEGER) AS code, max(f) FILTER (yr = 1996) AS a, max(f) FILTER (yr = 1998) AS b, max(f) FILTER (yr = 2000) AS c FROM fx GROUP BY ALL),
    z AS (SELECT *, code = 1 AND linestatus = 'O' AS zero FROM w),
    n AS (SELECT linestatus, code, CASE WHEN code = 1 THEN greatest(CASE WHEN zero AND b > 1e-14 THEN 2 * b - c ELSE a END, 1e-5) ELSE a END AS a, b,
      CASE WHEN code = 4 THEN greatest(CASE WHEN b > 1e-14 AND a > 1e-14 THEN 2 * b - a ELSE c END, 1e-5) ELSE c END AS c, code = 1 AND zero AS fa, code = 4 AS fc FROM z),
    l AS (SELECT linestatus, code, 1996 AS yr, greatest(a, 0) AS f, fa AS k FROM n UNION ALL SELECT linestatus, code, 1998, greatest(b, 0), FALSE FROM n UNION ALL SELECT linestatus, code, 2000, greatest(c, 0), fc FROM n),
    s AS (SELECT linestatus, code, yr, k, f / sum(f) OVER (PARTITION BY linestatus, yr) AS f FROM l), m AS (SELECT *, greatest(f, 1e-8) AS g FROM s)
    SELECT linestatus, code, CAST(yr AS INTEGER) AS yr, k AS correction_applied, round(f, 6) AS fraction_corrected, round(g / sum(g) OVER (PARTITION BY linestatus, yr), 6) AS fraction_model FROM m""",
)
def anchor_corrections(spark, sf):
    code = F.array_position(F.array(*[F.lit(t) for t in P_TYPES]), F.col("ptype")).cast("int")
    x = anchor_fractions(spark, sf).withColumn("code", code)
    x = x.withColumn("zero", (F.col("code") == 1) & (F.col("linestatus") == "O"))
    return rounded(compose.correct_anchors(x, ["linestatus"], "code", "yr", "f", "zero", CORRECTIONS, ANCHORS))


_GROUP_CASE = "CASE WHEN ptype IN ('ECONOMY', 'SMALL', 'STANDARD') THEN 'basic' WHEN ptype IN ('LARGE', 'PROMO') THEN 'premium' ELSE 'mid' END"
_ALR_SQL = f"""{_AF_SQL}, gx AS (SELECT *, {_GROUP_CASE} AS g FROM fx),
  br AS (SELECT linestatus, yr, g, sum(f) AS bf, max(eff) AS eff FROM gx GROUP BY ALL),
  ba AS (SELECT b.*, r.bf AS rf FROM br b JOIN br r ON r.linestatus = b.linestatus AND r.yr = b.yr AND r.g = 'basic'),
  rc AS (SELECT linestatus, yr, g, f AS rf FROM gx WHERE ptype IN ('STANDARD', 'PROMO', 'MEDIUM')),
  wa AS (SELECT x.*, rf, f / sum(f) OVER (PARTITION BY linestatus, yr, g) AS wf FROM gx x JOIN rc USING (linestatus, yr, g)),
  bl AS (SELECT linestatus, yr, g, bf, g = 'basic' AS ref, CASE WHEN g = 'basic' THEN 0 ELSE ln(bf) - ln(rf) END AS lr, CASE WHEN g = 'basic' THEN 0 ELSE 1 / (eff * bf) + 1 / (eff * rf) END AS v FROM ba),
  wl AS (SELECT linestatus, yr, ptype, g, wf, ptype IN ('STANDARD', 'PROMO', 'MEDIUM') AS ref, CASE WHEN ptype IN ('STANDARD', 'PROMO', 'MEDIUM') THEN 0 ELSE ln(f) - ln(rf) END AS lr,
    CASE WHEN ptype IN ('STANDARD', 'PROMO', 'MEDIUM') THEN 0 ELSE 1 / (eff * f) + 1 / (eff * rf) END AS v FROM wa)"""


def observations(spark, sf):
    return compose.log_ratio_observations(anchor_fractions(spark, sf), TREE, ["linestatus"], "yr", "ptype", "f", "eff")


@query(
    "log_ratios_broad", "M8",
    f"WITH {_ALR_SQL} SELECT linestatus, yr, g AS broad_group, round(bf, 6) AS broad_fraction, ref AS is_reference, round(lr, 6) AS log_ratio, round(v, 6) AS alr_variance FROM bl",
)
def log_ratios_broad(spark, sf):
    return rounded(observations(spark, sf)[0])


@query(
    "log_ratios_within", "M8 P21",
    f"WITH {_ALR_SQL} SELECT linestatus, yr, ptype, g AS broad_group, round(wf, 6) AS within_fraction, ref AS is_reference, round(lr, 6) AS log_ratio, round(v, 6) AS alr_variance FROM wl",
)
def log_ratios_within(spark, sf):
    return rounded(observations(spark, sf)[1])


_ANN_SQL = f"""{_ALR_SQL}, ab AS (SELECT linestatus, g, w.yr, sum(lr * w.w) AS lr FROM bl JOIN {_w(_CHAIN)} w ON w.src = bl.yr GROUP BY ALL),
  aw AS (SELECT linestatus, g, ptype, w.yr, sum(lr * w.w) AS lr FROM wl JOIN {_w(_CHAIN)} w ON w.src = wl.yr GROUP BY ALL),
  pb AS (SELECT linestatus, g, yr, exp(lr) / sum(exp(lr)) OVER (PARTITION BY linestatus, yr) AS p FROM ab),
  pw AS (SELECT linestatus, g, ptype, yr, exp(lr) / sum(exp(lr)) OVER (PARTITION BY linestatus, yr, g) AS p FROM aw),
  pf AS (SELECT linestatus, g, ptype, yr, pb.p * pw.p AS f FROM pw JOIN pb USING (linestatus, g, yr))"""


@query(
    "annual_fraction_panel", "M9 M10 W5",
    f"WITH {_ANN_SQL} SELECT linestatus, CAST(yr AS INTEGER) AS yr, g AS broad_group, ptype, round(CAST(f / sum(f) OVER (PARTITION BY linestatus, yr) AS DOUBLE), 6) AS fraction FROM pf",
)
def annual_fraction_panel(spark, sf):
    return rounded(compose.fit_fraction_panel(anchor_fractions(spark, sf), TREE, ["linestatus"], "yr", "ptype", "f", "eff", YEARS, ANCHORS, 3))


@query(
    "log_ratio_trend_table", "M11 M9",
    f"""WITH {_ANN_SQL} SELECT linestatus, CAST(yr AS INTEGER) AS yr, level, status, series, round(CAST(lr AS DOUBLE), 6) AS log_ratio FROM (
      SELECT linestatus, yr, 'broad' AS level, 'observed' AS status, g AS series, lr FROM bl UNION ALL SELECT linestatus, yr, 'within', 'observed', ptype, lr FROM wl
      UNION ALL SELECT linestatus, yr, 'broad', 'annual', g, lr FROM ab UNION ALL SELECT linestatus, yr, 'within', 'annual', ptype, lr FROM aw)""",
)
def log_ratio_trend_table(spark, sf):
    b, w = observations(spark, sf)
    ab, aw = compose.annual_log_ratios(b, w, ["linestatus"], "yr", "ptype", YEARS, ANCHORS, 3)
    return rounded(compose.log_ratio_trends(b, w, ab, aw, ["linestatus"], "yr", "ptype"))


@query(
    "survey_against_model_composition", "Q9",
    f"""WITH {_ANN_SQL}, m AS (SELECT linestatus, yr, g, ptype, f / sum(f) OVER (PARTITION BY linestatus, yr) AS mf FROM pf),
    env AS (SELECT linestatus, yr, CAST(count(*) AS DOUBLE) AS e FROM lp GROUP BY ALL),
    j AS (SELECT fx.yr, m.g, sum(fx.f * e) AS s, sum(mf * e) AS md FROM fx JOIN m USING (linestatus, yr, ptype) JOIN env USING (linestatus, yr) GROUP BY ALL)
    SELECT yr, g AS broad_group, round(CAST(s / sum(s) OVER (PARTITION BY yr) AS DOUBLE), 6) AS survey_share, round(CAST(md / sum(md) OVER (PARTITION BY yr) AS DOUBLE), 6) AS model_share FROM j""",
)
def survey_against_model_composition(spark, sf):
    from tallyloom.plans.views import composition_comparison

    obs = anchor_fractions(spark, sf)
    model = compose.fit_fraction_panel(obs, TREE, ["linestatus"], "yr", "ptype", "f", "eff", YEARS, ANCHORS, 3)
    env = lines_part(spark, sf).groupBy("linestatus", "yr").agg(F.count("*").cast("double").alias("envelope"))
    return rounded(composition_comparison(obs, "f", model, "fraction", env, ["linestatus", "yr"], "ptype", ["yr"], "broad_group"))


@query(
    "source_table_by_status", "Q11 A5",
    f"""WITH {LINES_PART}, c AS (SELECT ptype, linestatus, CAST(count(*) AS DOUBLE) AS n FROM lp GROUP BY ALL), s AS (SELECT *, 100 * n / sum(n) OVER (PARTITION BY linestatus) AS p FROM c)
    SELECT ptype, sum(n) FILTER (linestatus = 'F') AS n_F, sum(n) FILTER (linestatus = 'O') AS n_O, round(sum(p) FILTER (linestatus = 'F'), 6) AS percent_F, round(sum(p) FILTER (linestatus = 'O'), 6) AS percent_O FROM s GROUP BY ptype""",
)
def source_table_by_status(spark, sf):
    from tallyloom.plans.views import source_table

    return rounded(source_table(aggregate.tally(lines_part(spark, sf), ["ptype", "linestatus"], "n"), "ptype", "linestatus", ["F", "O"], "n"))
