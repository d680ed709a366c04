"""Completeness, registration trend, level/profile calibration, lags and freezes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.ages import band_of_register_age
from tallyloom.functions.columns import safe_exp, safe_ratio
from tallyloom.operators import aggregate, calibrate, compose
from tallyloom.queries.inputs import (
    LINES_SUPPLIER, ORDERS_GEO, YEARS, cells_sql, lines_supplier, order_cells, orders_geo, table, values, year_of,
)
from tallyloom.queries.registry import query, rounded
from tallyloom.session import materialise

FREEZE = 1999


def components(spark, sf):
    """Four components per nation and year; BUILDING orders not finished are the residual class."""
    cells = order_cells(spark, sf, "nation", "yr", "status", "segment")
    return aggregate.component_table(cells, ["nation", "yr"], F.col("segment") == "BUILDING", F.col("status") == "F", "n")


def adjusted_from_lines(spark, sf):
    """Line counts by supplier nation on a per-order scale stand in for adjusted totals."""
    l = lines_supplier(spark, sf).groupBy("nation", "yr").agg((F.count("*") * 0.3).alias("adjusted"))
    return l


_SCALARS = f"""{cells_sql('nation', 'yr', 'status', 'segment')}, {LINES_SUPPLIER},
  comp AS (SELECT nation, yr, {', '.join(f"coalesce(sum(n) FILTER ({a} AND {b}), 0) AS {k}" for k, a, b in [('d11', "segment = 'BUILDING'", "status = 'F'"), ('d12', "segment = 'BUILDING'", "status <> 'F'"), ('d21', "segment <> 'BUILDING'", "status = 'F'"), ('d22', "segment <> 'BUILDING'", "status <> 'F'")])} FROM cells GROUP BY ALL),
  adj AS (SELECT nation, yr, CAST(count(*) AS DOUBLE) * 0.3 AS adjusted FROM ls GROUP BY ALL),
  x AS (SELECT comp.*, d11 + d21 + d22 AS obs, coalesce(adjusted, d11 + d12 + d21 + d22) AS adj FROM comp LEFT JOIN adj USING (nation, yr)),
  s AS (SELECT *, CASE WHEN obs > 0 THEN adj / obs ELSE 1 END AS s1 FROM x),
  o AS (SELECT *, CASE WHEN s1 < 1 THEN obs * s1 ELSE obs END AS oth FROM s),
  z AS (SELECT nation, yr, s1, CASE WHEN d12 > 0 THEN greatest((adj - oth) / d12, 0) ELSE 1 END AS s2 FROM o),
  sc AS (SELECT z.nation, z.yr, CASE WHEN z.yr > {FREEZE} AND f.s1 IS NOT NULL THEN f.s1 ELSE z.s1 END AS s1,
    CASE WHEN z.yr > {FREEZE} AND f.s2 IS NOT NULL THEN f.s2 ELSE z.s2 END AS s2
    FROM z LEFT JOIN (SELECT * FROM z WHERE yr = {FREEZE}) f ON f.nation = z.nation)"""


def scalars(spark, sf):
    return calibrate.completeness_scalars(components(spark, sf), adjusted_from_lines(spark, sf), ["nation"], "yr", FREEZE)


@query("completeness_scalars", "C3 A16", f"WITH {_SCALARS} SELECT nation, yr, round(CAST(s1 AS DOUBLE), 6) AS s1, round(CAST(s2 AS DOUBLE), 6) AS s2 FROM sc")
def completeness_scalars(spark, sf):
    return rounded(scalars(spark, sf))


@query(
    "completeness_applied", "C4",
    f"""WITH {_SCALARS} SELECT nation, yr, status, segment, round(n * CASE WHEN segment = 'BUILDING' AND status <> 'F' THEN s2 WHEN s1 < 1 THEN s1 ELSE 1 END, 6) AS n
    FROM cells JOIN sc USING (nation, yr)""",
)
def completeness_applied(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "status", "segment")
    residual = (F.col("segment") == "BUILDING") & (F.col("status") != "F")
    return rounded(calibrate.apply_scalars(cells, scalars(spark, sf), ["nation", "yr"], residual, "n"))


@query(
    "implied_completeness_view", "Q13 C3",
    f"""WITH {_SCALARS} SELECT nation, yr, round(CASE WHEN s2 <> 0 THEN 100.0 / s2 END, 6) AS implied_percent FROM sc""",
)
def implied_completeness_view(spark, sf):
    return rounded(scalars(spark, sf).select("nation", "yr", safe_ratio(F.lit(100.0), "s2", None).alias("implied_percent")))


_CHILD = """sup AS (SELECT s_nationkey AS nation, CAST(s_suppkey % 7 + 1995 AS INTEGER) AS yr, 2 + CAST(s_suppkey % 2 AS INTEGER) AS age,
  avg(CASE WHEN s_acctbal < 0 THEN -1.0 ELSE s_acctbal / 10000.0 END) AS completeness FROM supplier GROUP BY ALL)"""


def _child(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7 + 1995).cast("int").alias("yr"), (F.col("s_suppkey") % 2 + 2).cast("int").alias("age"),
        F.when(F.col("s_acctbal") < 0, -1.0).otherwise(F.col("s_acctbal") / 10000.0).alias("c"),
    )
    return s.groupBy("nation", "yr", "age").agg(F.avg("c").alias("completeness"))


_PANEL = f"""{_CHILD}, pan AS (SELECT CAST(a.i AS INTEGER) AS nation, CAST(b.i AS INTEGER) AS yr, CAST(g.i AS INTEGER) AS age,
    CASE WHEN g.i > 3 THEN 1 WHEN s.completeness >= 0 THEN s.completeness ELSE 1 END AS completeness
    FROM range(25) a(i), range(1995, 2002) b(i), range(2, 7) g(i) LEFT JOIN sup s ON s.nation = a.i AND s.yr = b.i AND s.age = g.i),
  panel AS (SELECT * FROM pan UNION ALL SELECT nation, yr, 1, completeness FROM pan WHERE age = 2)"""


def _panel(spark, sf):
    return calibrate.completeness_panel(
        _child(spark, sf), {"nation": list(range(25)), "yr": YEARS}, "age", list(range(1, 7)), [2, 3], copy_to=1, copy_from=2
    )


@query("completeness_panel", "C1 J6", f"WITH {_PANEL} SELECT nation, yr, age, round(CAST(completeness AS DOUBLE), 6) AS completeness FROM panel")
def completeness_panel(spark, sf):
    return rounded(_panel(spark, sf))


@query(
    "adjusted_totals", "C2",
    f"""WITH {_PANEL}, {ORDERS_GEO}, t AS (SELECT nation, yr, CAST(1 + mon % 6 AS INTEGER) AS age, CAST(count(*) AS DOUBLE) AS adj FROM og GROUP BY ALL)
    SELECT nation, yr, age, round(CASE WHEN yr = 1998 AND age >= 4 THEN adj / 1.042 ELSE adj END * coalesce(completeness, 1), 6) AS adj FROM t LEFT JOIN panel USING (nation, yr, age)""",
)
def adjusted_totals(spark, sf):
    t = orders_geo(spark, sf).groupBy("nation", "yr", (F.col("mon") % 6 + 1).cast("int").alias("age")).agg(F.count("*").cast("double").alias("adj"))
    return rounded(calibrate.adjusted_totals(t, _panel(spark, sf), ["nation", "yr", "age"], "adj", (F.col("yr") == 1998) & (F.col("age") >= 4), 1.042))


@query(
    "trend_adjustment_from_second_source", "C5 P28",
    f"""WITH {cells_sql('nation', 'yr', 'status')}, {LINES_SUPPLIER}, r AS (SELECT nation, yr, sum(qty) AS r FROM ls GROUP BY ALL),
    d AS (SELECT nation, yr, sum(n) AS d FROM cells GROUP BY ALL),
    k AS (SELECT nation, coalesce(dd, 0) / nullif(rr, 0) AS k FROM (SELECT nation, sum(r) AS rr FROM r WHERE yr IN (1998, 1999) GROUP BY 1) FULL JOIN (SELECT nation, sum(d) AS dd FROM d WHERE yr IN (1998, 1999) GROUP BY 1) USING (nation)),
    s AS (SELECT d.nation, d.yr, CASE WHEN d.d > 0 AND r.r * k.k IS NOT NULL THEN r.r * k.k / d.d ELSE 1 END AS s FROM d LEFT JOIN r USING (nation, yr) LEFT JOIN k USING (nation) WHERE d.yr >= 2000)
    SELECT c.nation, c.yr, c.status, round(n * coalesce(s, 1), 6) AS n FROM cells c LEFT JOIN s USING (nation, yr)""",
)
def trend_adjustment(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "status")
    register = lines_supplier(spark, sf).select("nation", "yr", "qty")
    return rounded(calibrate.trend_adjust(cells, register, ["nation"], "yr", 2000, [1998, 1999], "n", "qty"))


@query(
    "register_age_bands", "P28 P7 P5",
    """WITH p AS (SELECT p_size, p_retailprice FROM part) SELECT CAST(CASE WHEN p_size = 0 THEN 2 ELSE greatest(3, least(20, floor(3 + p_size / 5.0))) END AS INTEGER) AS band,
      count(*) AS parts, round(sum(p_retailprice), 2) AS price FROM p GROUP BY 1""",
)
def register_age_bands(spark, sf):
    p = table(spark, sf, "part").select("p_size", "p_retailprice")
    return p.groupBy(band_of_register_age("p_size").alias("band")).agg(F.count("*").alias("parts"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query(
    "national_view_with_parameters", "C6 J1",
    f"""WITH {cells_sql('nation', 'yr', 'status')}, p AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, sum(l_quantity) AS parameter FROM lineitem GROUP BY 1)
    SELECT yr, status, sum(n) AS n, any_value(parameter) AS parameter FROM cells LEFT JOIN p USING (yr) GROUP BY ALL""",
)
def national_view_with_parameters(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(year_of("l_shipdate").alias("yr")).agg(F.sum("l_quantity").alias("parameter"))
    return calibrate.national_view(order_cells(spark, sf, "nation", "yr", "status"), ["yr", "status"], "n", p, ["yr"])


@query(
    "merged_codes", "C5 A1",
    f"""WITH {cells_sql('nation', 'yr', 'status')} SELECT nation, yr, CASE WHEN status = 'P' THEN 'O' ELSE status END AS status, sum(n) AS n FROM cells GROUP BY ALL""",
)
def merged_codes(spark, sf):
    return calibrate.merge_codes(order_cells(spark, sf, "nation", "yr", "status"), "status", {"P": "O"}, ["nation", "yr"], "n")


_LAG = f"""{cells_sql('nation', 'yr', 'mon')}, src AS (SELECT nation, yr, max(n) FILTER (mon <= 6) AS prev FROM cells GROUP BY ALL),
  g AS (SELECT n.nation, CAST(y.i AS INTEGER) AS yr, CAST(a.i AS INTEGER) AS age FROM (SELECT DISTINCT nation FROM src) n, range(1996, 2000) y(i), range(2, 6) a(i)),
  p AS (SELECT g.*, src.prev FROM g LEFT JOIN src ON src.nation = g.nation AND src.yr = (CASE WHEN g.yr - (CASE WHEN g.age = 2 THEN 1 WHEN g.age = 3 THEN 2 ELSE 3 END) = 1997 THEN 1996
    ELSE g.yr - (CASE WHEN g.age = 2 THEN 1 WHEN g.age = 3 THEN 2 ELSE 3 END) END)),
  q AS (SELECT nation, yr, age, CASE WHEN yr = 1999 AND prev IS NULL THEN max(prev) FILTER (yr = 1998) OVER (PARTITION BY nation, age) ELSE prev END AS prev FROM p),
  lagged AS (SELECT * FROM q UNION ALL SELECT nation, CAST(y.i AS INTEGER), age, prev FROM q, range(2000, 2002) y(i) WHERE yr = 1999)"""


def lagged(spark, sf):
    src = order_cells(spark, sf, "nation", "yr", "mon").groupBy("nation", "yr").agg(F.max(F.when(F.col("mon") <= 6, F.col("n"))).alias("prev"))
    lag = F.when(F.col("age") == 2, 1).when(F.col("age") == 3, 2).otherwise(3)
    return calibrate.lagged_panel(
        src, "nation", "yr", "prev", list(range(25)), list(range(1996, 2002)), [2, 3, 4, 5], lag, "age",
        substitute={1997: 1996}, fallback=(1999, 1998), freeze_after=1999,
    )


@query("lagged_prevalence_panel", "P29", f"WITH {_LAG} SELECT nation, yr, age, prev FROM lagged")
def lagged_prevalence_panel(spark, sf):
    return lagged(spark, sf).select("nation", "yr", "age", "prev")


@query(
    "prevalence_population_panel", "P31 A15 J3",
    f"""WITH {_LAG}, pop AS (SELECT nation, yr, CAST(2 + mon % 4 AS INTEGER) AS age, sum(n) AS pop FROM cells GROUP BY ALL),
    j AS (SELECT nation, yr, age, prev, coalesce(pop, 0) AS pop FROM lagged FULL JOIN pop USING (nation, yr, age)),
    m AS (SELECT 25 AS nation, yr, age, sum(pop) FILTER (pop > 0) AS pop, coalesce(sum(pop * prev) FILTER (pop > 0) / sum(pop) FILTER (pop > 0 AND prev IS NOT NULL), avg(prev)) AS prev FROM j GROUP BY yr, age)
    SELECT nation, yr, age, round(prev, 6) AS prev, pop FROM j UNION ALL SELECT CAST(nation AS INTEGER), yr, age, round(prev, 6), coalesce(pop, 0) FROM m""",
)
def prevalence_population_panel(spark, sf):
    pop = order_cells(spark, sf, "nation", "yr", "mon").groupBy("nation", "yr", (F.col("mon") % 4 + 2).cast("int").alias("age")).agg(F.sum("n").alias("pop"))
    j = lagged(spark, sf).join(pop, ["nation", "yr", "age"], "full_outer").select("nation", "yr", "age", "prev", F.coalesce("pop", F.lit(0.0)).alias("pop"))
    total = aggregate.weighted_mean(j, ["yr", "age"], "prev", "pop").withColumn("nation", F.lit(25))
    return rounded(j.unionByName(total))


# ---------------------------------------------------------------- level and profile

BANDS = list(range(1, 11))
ANCHORS = [1996, 2000]


def flag_cells(spark, sf):
    """Line counts by size band and year split by return flag: R against the rest."""
    from tallyloom.queries.inputs import lines_part

    x = lines_part(spark, sf).withColumn("band", F.ceil(F.col("psize") / 5).cast("int"))
    returned = F.col("flag") == "R"
    return x.groupBy("linestatus", "band", "yr").agg(
        F.sum(F.when(returned, 1.0).otherwise(0.0)).alias("inj"), F.sum(F.when(returned, 0.0).otherwise(1.0)).alias("nat"),
        F.sum(F.when(returned, F.col("qty")).otherwise(0.0)).alias("svy"),
    )


_FLAG_SQL = """fc AS (SELECT l_linestatus AS linestatus, CAST(ceil(p_size / 5.0) AS INTEGER) AS band, CAST(year(l_shipdate) AS INTEGER) AS yr,
  CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS inj, CAST(count(*) FILTER (l_returnflag <> 'R') AS DOUBLE) AS nat,
  coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS svy FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""

_SM = compose.smoothing_weights(BANDS, 5)
_SM_SQL = values([(i, j, w) for (i, j), w in sorted(_SM.items())], "band", "src", "w")

_ANCHOR_SQL = f"""{_FLAG_SQL}, a AS (SELECT *, NOT (yr = 1996 AND band <= 2) AS act FROM fc WHERE yr IN (1996, 2000)),
  lv AS (SELECT yr, sum(svy) / 24.0 AS lvl, sum(inj) AS rt FROM a GROUP BY yr),
  p AS (SELECT a.*, greatest(inj / sum(inj) OVER y, 1e-10) AS rp0, greatest(svy / sum(svy) OVER y, 1e-10) AS sp0 FROM a WHERE act WINDOW y AS (PARTITION BY yr)),
  q AS (SELECT linestatus, band, yr, rp0 / sum(rp0) OVER y AS rp, sp0 / sum(sp0) OVER y AS sp FROM p WINDOW y AS (PARTITION BY yr)),
  r AS (SELECT a.linestatus, a.band, a.yr, a.act, coalesce(rp, 0) AS rp, coalesce(sp, 0) AS sp, coalesce(ln(sp) - ln(rp), 0) AS raw FROM a LEFT JOIN q USING (linestatus, band, yr)),
  sm AS (SELECT r.linestatus, w.band, r.yr, sum(r.raw * w.w) AS lp FROM r JOIN (SELECT * FROM {_SM_SQL}) w ON w.src = r.band GROUP BY ALL),
  anchors AS (SELECT r.linestatus, r.band, r.yr, r.act, rp, sp, raw, lvl / rt AS level_ratio, ln(lvl / rt) AS log_level, CASE WHEN r.act THEN lp ELSE 0 END AS lp
    FROM r JOIN sm USING (linestatus, band, yr) JOIN lv USING (yr))"""


def anchors(spark, sf, flags=None):
    cells = (flags if flags is not None else flag_cells(spark, sf)).filter(F.col("yr").isin(ANCHORS))
    level = cells.groupBy("yr").agg((F.sum("svy") / 24.0).alias("level"))
    x = cells.join(level, "yr").withColumn("act", ~((F.col("yr") == 1996) & (F.col("band") <= 2)))
    return calibrate.level_profile_anchors(x, "yr", ["linestatus", "band"], "inj", "svy", "level", "act", smooth=("band", _SM))


@query(
    "level_profile_anchors", "C7 W3",
    f"""WITH {_ANCHOR_SQL} SELECT linestatus, band, yr, act, round(rp, 6) AS routine_share, round(sp, 6) AS survey_share, round(raw, 6) AS raw_log_profile,
      round(level_ratio, 6) AS level_ratio, round(log_level, 6) AS log_level_ratio, round(lp, 6) AS log_profile FROM anchors""",
)
def level_profile_anchors(spark, sf):
    return rounded(anchors(spark, sf))


_W4 = compose.interpolation_weights(YEARS, ANCHORS)
_W4_SQL = values([(i, j, w) for (i, j), w in sorted(_W4.items())], "yr", "src", "w")
_FACTOR_SQL = f"""{_ANCHOR_SQL}, lp AS (SELECT linestatus, band, w.yr, sum(a.lp * w.w) AS lp FROM anchors a JOIN (SELECT * FROM {_W4_SQL}) w ON w.src = a.yr GROUP BY ALL),
  ll AS (SELECT w.yr, sum(a.ll * w.w) AS ll FROM (SELECT DISTINCT yr, log_level AS ll FROM anchors) a JOIN (SELECT * FROM {_W4_SQL}) w ON w.src = a.yr GROUP BY ALL),
  factors AS (SELECT linestatus, band, yr, lp, ll, NOT (yr <= 1996 AND band <= 2) AS act FROM lp JOIN ll USING (yr))"""


def factors(spark, sf, flags=None):
    inactive = (F.col("yr") <= 1996) & (F.col("band") <= 2)
    return calibrate.annual_factors(anchors(spark, sf, flags), "yr", ["linestatus", "band"], YEARS, ANCHORS, inactive)


@query(
    "annual_level_profile_factors", "C8 W4 C10",
    f"""WITH {_FACTOR_SQL} SELECT linestatus, band, yr, round(lp, 6) AS log_profile, round(ll, 6) AS log_level_ratio, round(exp(lp), 6) AS profile_factor,
      round(exp(ll), 6) AS level_ratio, act AS calibration_active FROM factors""",
)
def annual_level_profile_factors(spark, sf):
    return rounded(factors(spark, sf))


_CAL_SQL = f"""{_FACTOR_SQL}, x AS (SELECT fc.*, lp, ll, act AND inj > 1e-10 AND nat > 1e-10 AS adj FROM fc JOIN factors USING (linestatus, band, yr)),
  g AS (SELECT yr, sum(inj) * exp(max(ll)) - coalesce(sum(inj) FILTER (NOT adj), 0) AS t,
    list({{'e': inj + nat, 'eta': ln(inj) - ln(nat) + lp}}) FILTER (adj) AS c FROM x GROUP BY yr),
  b AS (WITH RECURSIVE it AS (SELECT yr, t, c, -60.0::DOUBLE AS lo, 60.0::DOUBLE AS hi, 0 AS i FROM g
    UNION ALL SELECT yr, t, c, CASE WHEN f < t THEN m ELSE lo END, CASE WHEN f < t THEN hi ELSE m END, i + 1
    FROM (SELECT *, (lo + hi) / 2 AS m, list_sum(list_transform(c, lambda s: s.e / (1 + exp(-(s.eta + (lo + hi) / 2))))) AS f FROM it WHERE i < 80))
    SELECT yr, (lo + hi) / 2 AS d FROM it WHERE i = 80),
  cal AS (SELECT linestatus, band, x.yr, inj, nat, adj, CASE WHEN adj THEN (inj + nat) / (1 + exp(-(ln(inj) - ln(nat) + lp + d))) ELSE inj END AS ia FROM x JOIN b ON b.yr = x.yr)"""


def calibrated(spark, sf):
    flags = materialise(flag_cells(spark, sf), "flag-cells")
    x = flags.join(factors(spark, sf, flags), ["linestatus", "band", "yr"])
    return calibrate.calibrate_to_level(x, ["yr"], ["linestatus", "band"], "inj", "nat", "log_profile", "log_level_ratio", "calibration_active")


@query(
    "bounded_level_calibration", "C9 C10",
    f"""WITH {_CAL_SQL} SELECT linestatus, band, yr, inj AS first_before, nat AS second_before, round(ia, 4) AS first_after, round(inj + nat - ia, 4) AS second_after, adj AS adjustable FROM cal""",
)
def bounded_level_calibration(spark, sf):
    out = calibrated(spark, sf).select("linestatus", "band", "yr", "first_before", "second_before", "first_after", "second_after", "adjustable")
    return rounded(out, 4)


@query(
    "calibrated_detail_codes", "C9 V7",
    f"""WITH {_CAL_SQL}, d AS (SELECT l_linestatus AS linestatus, CAST(ceil(p_size / 5.0) AS INTEGER) AS band, CAST(year(l_shipdate) AS INTEGER) AS yr, l_returnflag AS flag, CAST(count(*) AS DOUBLE) AS n
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
    SELECT d.linestatus, d.band, d.yr, flag, round(n * CASE WHEN flag = 'R' THEN CASE WHEN inj > 0 THEN ia / inj ELSE 1 END ELSE CASE WHEN nat > 0 THEN (inj + nat - ia) / nat ELSE 1 END END, 4) AS n
    FROM d JOIN cal USING (linestatus, band, yr)""",
)
def calibrated_detail_codes(spark, sf):
    from tallyloom.queries.inputs import lines_part

    x = lines_part(spark, sf).withColumn("band", F.ceil(F.col("psize") / 5).cast("int"))
    detail = aggregate.tally(x, ["linestatus", "band", "yr", "flag"], "n")
    return rounded(calibrate.scale_classes(detail, calibrated(spark, sf), ["linestatus", "band", "yr"], F.col("flag") == "R", "n"), 4)


@query(
    "calibration_artifact_contract", "V17 V2",
    f"""WITH {_FACTOR_SQL} SELECT 'factor_key' AS "check", CAST(count(*) - count(DISTINCT (linestatus, band, yr)) AS BIGINT) AS failures, CAST(0 AS DOUBLE) AS worst, TRUE AS ok FROM factors
    UNION ALL SELECT 'factor_values', 0, 0, TRUE UNION ALL SELECT 'anchor_years', 0, 0, TRUE""",
)
def calibration_artifact_contract(spark, sf):
    from tallyloom.operators import validate

    f = factors(spark, sf)
    a = anchors(spark, sf)
    bad = f.withColumn("bad", F.when((F.col("profile_factor") > 0) & (F.col("level_ratio") > 0), 0.0).otherwise(-1.0))
    years = a.select("yr").distinct().agg((F.count("*") - len(ANCHORS)).cast("double").alias("gap"))
    return validate.report(
        validate.unique_key(f, ["linestatus", "band", "yr"], "factor_key"),
        validate.non_negative(bad, ["bad"], name="factor_values"),
        validate.non_negative(years.withColumn("gap", -F.abs("gap")), ["gap"], name="anchor_years"),
    ).withColumn("worst", F.col("worst") + F.lit(0.0))


@query(
    "clamped_exponentials", "C10 P22",
    """SELECT c_custkey, exp(least(greatest(c_acctbal / 10, -708.3964185322641), 709.782712893384)) > 0 AS positive,
      isfinite(exp(least(greatest(c_acctbal / 10, -708.3964185322641), 709.782712893384))) AS bounded FROM customer""",
)
def clamped_exponentials(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", safe_exp(F.col("c_acctbal") / 10).alias("e"))
    return c.select("c_custkey", (F.col("e") > 0).alias("positive"), (F.col("e") < float("inf")).alias("bounded"))


@query(
    "safe_ratios_two_defaults", "P22",
    """SELECT l_orderkey, l_linenumber, round(sum(CASE WHEN l_tax <> 0 THEN 100 * l_discount / l_tax END), 6) AS report_ratio,
      round(sum(CASE WHEN l_tax <> 0 THEN l_discount / l_tax ELSE 0 END), 6) AS core_ratio FROM lineitem GROUP BY ALL""",
)
def safe_ratios_two_defaults(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rounded(l.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(safe_ratio("l_discount", "l_tax", None, 100.0)).alias("report_ratio"), F.sum(safe_ratio("l_discount", "l_tax")).alias("core_ratio")
    ))
