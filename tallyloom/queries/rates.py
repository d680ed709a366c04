"""Rates, aggregate ages, standardisation, years of life lost and the published cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import ages as age_codes
from tallyloom.functions.ages import band_midpoint, band_of_table_age, band_of_unit_age, band_of_years
from tallyloom.operators import aggregate, grid, rates, validate
from tallyloom.plans import views
from tallyloom.queries.inputs import LINES_PART, in_list, lines_part, table, values
from tallyloom.queries.registry import query, rounded
from tallyloom.session import materialise, small_table

AGES = list(range(20))
WEIGHTS = [8.86, 8.69, 8.60, 8.47, 8.22, 7.93, 7.61, 7.15, 6.59, 6.04, 5.37, 4.55, 3.72, 2.96, 2.21, 1.52, 0.91, 0.60]
_W_SQL = values([(i + 1, w) for i, w in enumerate(WEIGHTS)], "standard_age", "pct")

# Line items stand for deaths and parts for population; size modulo 20 is the age and
# line status the sex.
_CELLS_SQL = f"""{LINES_PART}, d AS (SELECT ptype, yr, CASE WHEN linestatus = 'F' THEN 1 ELSE 2 END AS sex, CAST(psize % 20 AS INTEGER) AS age, CAST(count(*) AS DOUBLE) AS deaths FROM lp GROUP BY ALL),
  pa AS (SELECT p_type AS ptype, CAST(p_size % 20 AS INTEGER) AS age FROM part), pp AS (SELECT ptype, age, CAST(count(*) AS DOUBLE) * 100 AS pop FROM pa WHERE age > 0 GROUP BY ALL),
  cells AS (SELECT d.*, coalesce(pop, 0) AS pop FROM d LEFT JOIN pp USING (ptype, age)), wts AS (SELECT standard_age, pct / 100.0 AS f FROM {_W_SQL})"""


def deaths_and_population(spark, sf):
    l = lines_part(spark, sf).select(
        "ptype", "yr", F.when(F.col("linestatus") == "F", 1).otherwise(2).alias("sex"), (F.col("psize") % 20).cast("int").alias("age")
    )
    d = aggregate.tally(l, ["ptype", "yr", "sex", "age"], "deaths")
    p = table(spark, sf, "part").select(F.col("p_type").alias("ptype"), (F.col("p_size") % 20).cast("int").alias("age")).filter("age > 0")
    pop = p.groupBy("ptype", "age").agg((F.count("*") * 100.0).alias("pop"))
    return d.join(pop, ["ptype", "age"], "left").fillna(0.0, ["pop"])


def weights(spark):
    raw = small_table(spark, [(i + 1, w) for i, w in enumerate(WEIGHTS)], "age int, percent double")
    return rates.standard_weights(raw, "age", "percent")


_ASR = """st AS (SELECT ptype, yr, sex, CASE WHEN age <= 2 THEN 1 ELSE age - 1 END AS standard_age, sum(deaths) AS dd, sum(CASE WHEN age > 0 THEN pop ELSE 0 END) AS pp FROM cells GROUP BY ALL),
  asr AS (SELECT ptype, yr, sex, CAST(1e5 * sum(dd / pp * f) FILTER (pp > 0) / sum(f) FILTER (pp > 0) AS DOUBLE) AS ASR FROM st JOIN wts USING (standard_age) GROUP BY ALL)"""


@query(
    "age_standardised_rates", "Y5 Y8",
    f"WITH {_CELLS_SQL}, {_ASR} SELECT ptype, yr, sex, round(ASR, 6) AS ASR FROM asr",
)
def age_standardised_rates(spark, sf):
    return rounded(rates.age_standardise(deaths_and_population(spark, sf), ["ptype", "yr", "sex"], "age", "deaths", "pop", weights(spark)))


@query(
    "age_standardised_wide_rows", "Y5 Y9 A12",
    f"WITH {_CELLS_SQL}, {_ASR} SELECT ptype, yr, sex, round(ASR, 6) AS ASR FROM asr",
)
def age_standardised_wide_rows(spark, sf):
    cells = deaths_and_population(spark, sf)
    by = ["ptype", "yr", "sex"]
    d = grid.pivot_codes(cells, by, "age", AGES, "deaths", prefix="age_")
    p = rates.base_population_wide(cells, by, "age", "pop", AGES)
    value = rates.asr_wide([f"age_{a}" for a in AGES], [f"pop_{a}" for a in AGES], [w / 100 for w in WEIGHTS])
    return rounded(d.join(p, by).select(*by, value.alias("ASR")))


@query(
    "base_age_denominators_wide", "Y9 A5",
    f"WITH {_CELLS_SQL} SELECT ptype, yr, {', '.join(f'coalesce(max(pop) FILTER (age = {a}), 0) AS pop_{a}' for a in AGES)} FROM cells GROUP BY ALL",
)
def base_age_denominators_wide(spark, sf):
    return rates.base_population_wide(deaths_and_population(spark, sf), ["ptype", "yr"], "age", "pop", AGES)


@query(
    "standard_weight_table", "Y8",
    f"""SELECT p_size AS standard_age, round(pct / 100.0, 6) AS F, count(*) AS parts FROM part JOIN (SELECT * FROM {_W_SQL}) w ON w.standard_age = p_size GROUP BY ALL""",
)
def standard_weight_table(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_size").alias("standard_age"))
    out = p.join(weights(spark), "standard_age").groupBy("standard_age", "F").agg(F.count("*").alias("parts"))
    return rounded(out)


_AGG = {20: ([0, 1, 2], [1, 2]), 21: ([3, 4], [3, 4]), 22: (list(range(5, 11)),) * 2, 23: (list(range(11, 14)),) * 2, 24: (list(range(14, 20)),) * 2, 25: (list(range(20)), list(range(1, 20))), 26: (list(range(5, 20)),) * 2}


def _agg_sql():
    parts = ["SELECT ptype, yr, sex, age, deaths, pop FROM cells"]
    for code, (n, d) in _AGG.items():
        parts.append(
            f"SELECT ptype, yr, sex, {code}, coalesce(sum(deaths) FILTER (age IN {in_list(n)}), 0), coalesce(sum(pop) FILTER (age IN {in_list(d)}), 0) FROM cells WHERE age IN {in_list(n)} GROUP BY ALL"
        )
    return " UNION ALL ".join(parts)


@query(
    "aggregate_age_rows", "A13 A28",
    f"WITH {_CELLS_SQL} SELECT ptype, yr, sex, CAST(age AS INTEGER) AS age, deaths, pop FROM ({_agg_sql()})",
)
def aggregate_age_rows(spark, sf):
    return rates.age_groups(deaths_and_population(spark, sf), ["ptype", "yr", "sex"], "age", ["deaths"], ["pop"])


@query(
    "crude_rates_by_series", "A19 Y4",
    f"""WITH {_CELLS_SQL}, s AS (SELECT * FROM {values([('ECONOMY', 'basic'), ('SMALL', 'basic'), ('LARGE', 'top'), ('PROMO', 'top'), ('ECONOMY', 'all'), ('LARGE', 'all'), ('MEDIUM', 'all'), ('PROMO', 'all'), ('SMALL', 'all'), ('STANDARD', 'all')], 'ptype', 'series_id')}),
    u AS (SELECT age, max(pop) AS q FROM pp GROUP BY age), a AS (SELECT yr, sex, series_id, age, sum(deaths) AS dd, max(coalesce(q, 0)) AS p FROM d JOIN s USING (ptype) LEFT JOIN u USING (age) GROUP BY ALL),
    g AS (SELECT yr, sex, series_id, CASE WHEN age < 5 THEN 22 ELSE 26 END AS age_id, sum(dd) AS deaths, sum(p) FILTER (age > 0) AS population FROM a GROUP BY ALL
      UNION ALL SELECT yr, sex, series_id, 25, sum(dd), sum(p) FILTER (age > 0) FROM a GROUP BY ALL)
    SELECT yr, sex, series_id, CAST(age_id AS INTEGER) AS age_id, deaths, population, round(1e5 * deaths / population, 6) AS crude_rate FROM g""",
)
def crude_rates_by_series(spark, sf):
    series = small_table(spark, [("ECONOMY", "basic"), ("SMALL", "basic"), ("LARGE", "top"), ("PROMO", "top")] + [(t, "all") for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")],
        "ptype string, series_id string",
    )
    age_map = small_table(spark, [(a, 22 if a < 5 else 26, True, a > 0) for a in AGES] + [(a, 25, True, a > 0) for a in AGES],
        "age int, age_id int, in_numerator boolean, in_denominator boolean",
    )
    cells = deaths_and_population(spark, sf)
    shared = cells.groupBy("age").agg(F.max("pop").alias("q"))
    x = cells.drop("pop").join(shared, "age")
    return rounded(rates.series_rates(x, ["yr", "sex"], "ptype", "age", "deaths", "q", series, age_map))


@query(
    "comparison_series_fractions", "A20 J2",
    f"""WITH {_CELLS_SQL} SELECT yr, sex, series_id, sum(deaths) FILTER (num) AS count, sum(deaths) AS denominator, round(sum(deaths) FILTER (num) / sum(deaths), 6) AS fraction
    FROM d JOIN {values([('ECONOMY', 'small_of_basic', False), ('SMALL', 'small_of_basic', True), ('PROMO', 'promo_of_top', True), ('LARGE', 'promo_of_top', False)], 'ptype', 'series_id', 'num').replace('AS v', 'AS s')} USING (ptype) GROUP BY ALL""",
)
def comparison_series_fractions(spark, sf):
    members = small_table(spark, [("ECONOMY", "small_of_basic", False, True), ("SMALL", "small_of_basic", True, True), ("PROMO", "promo_of_top", True, True), ("LARGE", "promo_of_top", False, True)],
        "ptype string, series_id string, in_numerator boolean, in_denominator boolean",
    )
    return rounded(rates.comparison_series(deaths_and_population(spark, sf), ["yr", "sex"], "ptype", "deaths", members))


_YLL = f"""{_CELLS_SQL}, sch AS (SELECT age, sex, 90.0 - sex * 2 - age * 4 AS l FROM range(20) a(age), range(1, 3) s(sex)),
  y AS (SELECT ptype, yr, sex, age, deaths, deaths * l AS YLL00, deaths * (1 - exp(-0.03 * l)) / 0.03 AS YLL03, deaths * (1 - exp(-0.015 * l)) / 0.015 AS YLL015 FROM d JOIN sch USING (age, sex))"""


def schedule(spark):
    g = grid.level_grid(spark, {"age": AGES, "sex": [1, 2]})
    return g.withColumns(rates.discounted_years((90.0 - F.col("sex") * 2 - F.col("age") * 4).cast("double")))


@query(
    "years_of_life_lost", "Y1 Y2",
    f"WITH {_YLL} SELECT ptype, yr, sex, age, deaths, round(CAST(YLL00 AS DOUBLE), 6) AS YLL00, round(CAST(YLL03 AS DOUBLE), 6) AS YLL03, round(CAST(YLL015 AS DOUBLE), 6) AS YLL015 FROM y",
)
def years_of_life_lost(spark, sf):
    return rounded(rates.yll(deaths_and_population(spark, sf).drop("pop"), schedule(spark), ["sex", "age"], "deaths"))


@query(
    "years_of_life_lost_national", "Y2 A10",
    f"""WITH {_YLL} SELECT ptype, yr, sex, round(CAST(sum(deaths) AS DOUBLE), 4) AS deaths, round(CAST(sum(YLL03) AS DOUBLE), 4) AS YLL03 FROM y GROUP BY ALL
    UNION ALL SELECT 'ALL', yr, sex, round(CAST(sum(deaths) AS DOUBLE), 4), round(CAST(sum(YLL03) AS DOUBLE), 4) FROM y GROUP BY ALL""",
)
def years_of_life_lost_national(spark, sf):
    y = rates.yll(deaths_and_population(spark, sf).drop("pop"), schedule(spark), ["sex", "age"], "deaths")
    return rounded(rates.append_total(y, ["yr", "sex"], "ptype", "ALL", ["deaths", "YLL03"]), 4)


# ---------------------------------------------------------------- final cube on the driver tables

_CUBE_D = """od AS (SELECT 1 + CAST(n_regionkey AS INTEGER) AS place, 1 + CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) % 4 AS INTEGER) AS grp,
    CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS Sex, CAST(year(o_orderdate) AS INTEGER) AS DeathYear, CAST(41 + list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) AS INTEGER) AS nbdcode,
    CAST((month(o_orderdate) + 12 * (day(o_orderdate) % 2)) % 20 AS INTEGER) AS age
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
  dd AS (SELECT place, grp, Sex, DeathYear, nbdcode, age, CAST(count(*) AS DOUBLE) AS n FROM od GROUP BY ALL),
  pc AS (SELECT place, grp, Sex, DeathYear, a.i AS age, b + a.i AS pop FROM (SELECT place, grp, Sex, DeathYear, CAST(count(*) AS DOUBLE) * 10 AS b FROM od GROUP BY ALL), range(1, 20) a(i))"""


def cube_inputs(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    pos = lambda c, vs: F.array_position(F.array(*[F.lit(v) for v in vs]), F.col(c))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey).select(
        (F.col("n_regionkey") + 1).cast("int").alias("Death_Prov"),
        (pos("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) % 4 + 1).cast("int").alias("Popgroup"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("Sex"), F.year("o_orderdate").cast("int").alias("DeathYear"),
        (pos("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]) + 41).cast("int").alias("nbdcode"),
        ((F.month("o_orderdate") + 12 * (F.dayofmonth("o_orderdate") % 2)) % 20).cast("int").alias("age"),
    )
    keys = ["Death_Prov", "Popgroup", "Sex", "DeathYear", "nbdcode", "age"]
    d = aggregate.tally(x, keys, "Deaths").withColumns(
        {"YLL00": F.col("Deaths") * 3.0, "YLL03": F.col("Deaths") * 2.0, "YLL015": F.col("Deaths") * 2.5}
    )
    base = x.groupBy("Death_Prov", "Popgroup", "Sex", "DeathYear").agg((F.count("*") * 10.0).alias("b"))
    pop = base.withColumn("age5", F.explode(F.sequence(F.lit(2), F.lit(20)))).withColumn("Pop", F.col("b") + F.col("age5") - 1).drop("b")
    return d, pop


def cube(spark, sf):
    d, pop = cube_inputs(spark, sf)
    den = rates.denominators(pop, "Death_Prov", "Popgroup", "Sex", "DeathYear", "age5", "Pop", list(range(2, 21)))
    return rates.final_cube(d, den, weights(spark), places=range(1, 6), female_only=(42, 43), male_only=(46,))


_DEN_SQL = """den AS (SELECT place AS Grouping, Sex, DeathYear, age, sum(pop) AS Pop FROM pc GROUP BY ALL UNION ALL SELECT grp + 10, Sex, DeathYear, age, sum(pop) FROM pc GROUP BY ALL
    UNION ALL SELECT DISTINCT place, Sex, DeathYear, 0, 0 FROM pc UNION ALL SELECT DISTINCT grp + 10, Sex, DeathYear, 0, 0 FROM pc)"""


@query(
    "database_denominators", "Y3 P4",
    f"WITH {_CUBE_D}, {_DEN_SQL} SELECT CAST(Grouping AS INTEGER) AS Grouping, Sex, DeathYear, CAST(age AS INTEGER) AS age, Pop FROM den",
)
def database_denominators(spark, sf):
    _, pop = cube_inputs(spark, sf)
    return rates.denominators(pop, "Death_Prov", "Popgroup", "Sex", "DeathYear", "age5", "Pop", list(range(2, 21)))


def _cube_sql():
    aggs = []
    for code, (n, d) in _AGG.items():
        aggs.append(
            f"SELECT Grouping, Sex, DeathYear, nbdcode, {code} AS age, coalesce(sum(Deaths) FILTER (age IN {in_list(n)}), 0) AS Deaths, coalesce(sum(Pop) FILTER (age IN {in_list(d)}), 0) AS Pop FROM x0 WHERE age IN {in_list(n)} GROUP BY ALL"
        )
    return f"""{_CUBE_D}, {_DEN_SQL}, wts AS (SELECT standard_age, pct / 100.0 AS f FROM {_W_SQL}),
    b AS (SELECT place AS Grouping, Sex, DeathYear, age, nbdcode, n FROM dd UNION ALL SELECT grp + 10, Sex, DeathYear, age, nbdcode, n FROM dd),
    z AS (SELECT Grouping, Sex, DeathYear, age, nbdcode, n FROM b UNION ALL SELECT DISTINCT Grouping, Sex, DeathYear, age, 140, 0.0 FROM b),
    s AS (SELECT Grouping, Sex, DeathYear, age, nbdcode, sum(n) AS Deaths FROM z GROUP BY ALL),
    x0 AS (SELECT s.*, coalesce(Pop, 0) AS Pop FROM s LEFT JOIN den USING (Grouping, Sex, DeathYear, age)),
    x1 AS (SELECT Grouping, Sex, DeathYear, nbdcode, age, Deaths, Pop FROM x0 UNION ALL {' UNION ALL '.join(aggs)}),
    x2 AS (SELECT * FROM x1 UNION ALL SELECT 10, Sex, DeathYear, nbdcode, age, sum(Deaths), sum(Pop) FROM x1 WHERE Grouping <= 5 GROUP BY ALL),
    x3 AS (SELECT * FROM x2 UNION ALL SELECT Grouping, 3, DeathYear, nbdcode, age, sum(Deaths), CASE WHEN nbdcode IN (42, 43) THEN sum(Pop) FILTER (Sex = 2) WHEN nbdcode = 46 THEN sum(Pop) FILTER (Sex = 1) ELSE sum(Pop) END FROM x2 GROUP BY Grouping, DeathYear, nbdcode, age),
    x4 AS (SELECT Grouping, Sex, DeathYear, nbdcode, age, Deaths, coalesce(Pop, 0) AS Pop FROM x3),
    st AS (SELECT Grouping, Sex, DeathYear, nbdcode, CASE WHEN age <= 2 THEN 1 ELSE age - 1 END AS standard_age, sum(Deaths) AS d, sum(CASE WHEN age > 0 THEN Pop ELSE 0 END) AS p FROM x4 WHERE age < 20 GROUP BY ALL),
    asr AS (SELECT Grouping, Sex, DeathYear, nbdcode, CAST(1e5 * sum(d / p * f) FILTER (p > 0) / sum(f) FILTER (p > 0) AS DOUBLE) AS ASR FROM st JOIN wts USING (standard_age) GROUP BY ALL)"""


@query(
    "final_cube", "Y7 Y6 A13 A10",
    f"""WITH {_cube_sql()} SELECT CAST(x4.Grouping AS INTEGER) AS Grouping, CAST(x4.Sex AS INTEGER) AS Sex, x4.DeathYear, x4.nbdcode, CAST(age AS INTEGER) AS Age, Deaths, 3 * Deaths AS YLL00, 2 * Deaths AS YLL03, 2.5 * Deaths AS YLL015, Pop, round(ASR, 6) AS ASR
    FROM x4 LEFT JOIN asr USING (Grouping, Sex, DeathYear, nbdcode)""",
)
def final_cube(spark, sf):
    return rounded(cube(spark, sf))


@query(
    "person_rows_with_sex_specific_denominators", "Y6",
    f"""WITH {_cube_sql()} SELECT CAST(Grouping AS INTEGER) AS Grouping, DeathYear, nbdcode, CAST(age AS INTEGER) AS Age, Deaths, Pop FROM x4 WHERE Sex = 3""",
)
def person_rows(spark, sf):
    return cube(spark, sf).filter("Sex = 3").select("Grouping", "DeathYear", "nbdcode", "Age", "Deaths", "Pop")


@query(
    "standardised_cube_contract", "Q8 V2 V3",
    f"""WITH {_cube_sql()} SELECT 'key' AS "check", CAST(0 AS BIGINT) AS failures, CAST(0 AS DOUBLE) AS worst, TRUE AS ok UNION ALL SELECT 'measures', CAST(count(*) FILTER (Deaths < 0) AS BIGINT), 0, TRUE FROM x4""",
)
def standardised_cube_contract(spark, sf):
    x = cube(spark, sf).filter(F.col("Age").between(0, 26) & F.col("Sex").isin(1, 2, 3))
    return validate.report(
        validate.unique_key(x, ["Grouping", "Sex", "nbdcode", "DeathYear", "Age"], "key").withColumn("worst", F.lit(0.0)),
        validate.non_negative(x, ["Deaths", "Pop"], name="measures"),
    )


@query(
    "filtered_cube_slice", "Q1 Q10",
    f"""WITH {_cube_sql()} SELECT CAST(Grouping AS INTEGER) AS Grouping, DeathYear, nbdcode, Deaths AS estimate FROM x4 WHERE Grouping IN (1, 2, 10) AND Sex = 3 AND age = 25 AND DeathYear BETWEEN 1997 AND 2000""",
)
def filtered_cube_slice(spark, sf):
    return views.slice_cube(cube(spark, sf), {"Grouping": [1, 2, 10], "Sex": 3, "Age": 25}, "Deaths", ("DeathYear", 1997, 2000), ["Grouping", "DeathYear", "nbdcode"])


@query(
    "broad_cause_age_profile", "Q10 J6",
    f"""WITH {_CELLS_SQL}, b AS (SELECT CASE WHEN ptype IN ('ECONOMY', 'SMALL', 'STANDARD') THEN 'basic' ELSE 'other' END AS broad, yr, age, sum(deaths) AS deaths FROM d WHERE yr IN (1996, 2000) GROUP BY ALL)
    SELECT g.broad, CAST(y.yr AS INTEGER) AS yr, CAST(a.age AS INTEGER) AS age, coalesce(b.deaths, 0) AS deaths FROM (VALUES ('basic'), ('other')) g(broad), (VALUES (1996), (2000)) y(yr), range(20) a(age) LEFT JOIN b ON b.broad = g.broad AND b.yr = y.yr AND b.age = a.age""",
)
def broad_cause_age_profile(spark, sf):
    groups = {"basic": ["ECONOMY", "SMALL", "STANDARD"], "other": ["LARGE", "MEDIUM", "PROMO"]}
    return views.profile_slice(deaths_and_population(spark, sf), [1996, 2000], groups, "ptype", "age", "yr", "deaths", AGES)


_SPEC_ROWS = [(c, a, 1, int(a in age_codes.age_spec([c])[1])) for c in (20, 24, 25) for a in age_codes.age_spec([c])[0]]


@query(
    "age_specification_expansion", "A28 A13",
    f"""WITH {_CELLS_SQL}, s AS (SELECT * FROM {values(_SPEC_ROWS, 'spec', 'age', 'n', 'd')}) SELECT CAST(spec AS INTEGER) AS spec, yr, sum(deaths) AS deaths, sum(pop) FILTER (s.d = 1) AS pop FROM cells JOIN s USING (age) GROUP BY ALL""",
)
def age_specification_expansion(spark, sf):
    specs = {c: age_codes.age_spec([c]) for c in (20, 24, 25)}
    out = rates.age_groups(deaths_and_population(spark, sf), ["yr"], "age", ["deaths"], ["pop"], specs)
    return out.filter("age >= 20").withColumnRenamed("age", "spec")


@query(
    "age_band_codes", "P5 P6 P7 P21",
    """SELECT p_partkey, CAST(CASE WHEN p_size < 1 THEN 2 WHEN p_size < 5 THEN 3 WHEN p_size < 85 THEN floor(p_size / 5.0) + 3 ELSE 20 END AS INTEGER) AS years_band,
      CAST(CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 2 THEN CASE WHEN p_size < 5 THEN 3 ELSE floor(p_size / 5.0) + 3 END WHEN 3 THEN 21 ELSE 2 END AS INTEGER) AS unit_band,
      CAST(CASE WHEN p_size = 1 THEN 3 WHEN p_size >= 5 THEN floor(p_size / 5.0) + 3 END AS INTEGER) AS table_band,
      CAST(CASE WHEN p_size < 5 THEN 3.0 ELSE (floor(p_size / 5.0)) * 5 + 2.5 END AS DOUBLE) AS midpoint FROM part""",
)
def age_band_codes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    unit = F.when(F.col("p_partkey") % 4 == 3, F.lit(None)).otherwise(F.col("p_partkey") % 4)
    return p.select(
        "p_partkey", band_of_years("p_size").alias("years_band"), band_of_unit_age("p_size", unit).alias("unit_band"),
        band_of_table_age("p_size").alias("table_band"), band_midpoint(band_of_years("p_size")).alias("midpoint"),
    )


# ---------------------------------------------------------------- model comparison

_TWO = """tw AS (SELECT 'price' AS model, c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS estimate FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL
  UNION ALL SELECT 'lines', s_nationkey, CAST(year(l_shipdate) AS INTEGER), CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"""


def two_models(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").cast("int").alias("yr"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    l = table(spark, sf, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("int").alias("yr"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    a = o.join(c, o.o_custkey == c.c_custkey).groupBy("nation", "yr").agg(F.sum("v").cast("double").alias("estimate")).withColumn("model", F.lit("price"))
    b = l.join(s, l.l_suppkey == s.s_suppkey).groupBy("nation", "yr").agg(F.sum("v").cast("double").alias("estimate")).withColumn("model", F.lit("lines"))
    return a.unionByName(b)


@query(
    "model_difference_metrics", "Q6 J3",
    f"""WITH {_TWO}, p AS (SELECT nation, yr, max(estimate) FILTER (model = 'price') AS a, max(estimate) FILTER (model = 'lines') AS b FROM tw GROUP BY ALL)
    SELECT nation, yr, round(a, 2) AS estimate_a, round(b, 2) AS estimate_b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'matched' WHEN a IS NOT NULL THEN 'price_only' ELSE 'lines_only' END AS coverage,
      round(b - a, 2) AS absolute_difference, round((b - a) / abs(a), 6) AS relative_difference, round(b / a, 6) AS ratio, round(200 * (b - a) / (abs(a) + abs(b)), 6) AS symmetric_percent_difference FROM p""",
)
def model_difference_metrics(spark, sf):
    d = views.model_differences(two_models(spark, sf), "model", ["nation", "yr"], "price", "lines")
    money = {c: F.round(c, 2) for c in ("estimate_a", "estimate_b", "absolute_difference")}
    rel = {c: F.round(c, 6) for c in ("relative_difference", "ratio", "symmetric_percent_difference")}
    return d.withColumns({**money, **rel})


@query(
    "percent_or_proportion_detection", "P25",
    """WITH x AS (SELECT l_returnflag AS flag, l_discount * CASE WHEN l_returnflag = 'A' THEN 100 ELSE 1 END AS v, l_orderkey, l_linenumber FROM lineitem),
    q AS (SELECT flag, quantile_cont(abs(v), 0.99) > 1.5 AS pct FROM x GROUP BY flag)
    SELECT flag, round(sum(CASE WHEN pct THEN v / 100 ELSE v END), 4) AS total, count(*) AS "rows" FROM x JOIN q USING (flag) GROUP BY flag""",
)
def percent_or_proportion_detection(spark, sf):
    l = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), (F.col("l_discount") * F.when(F.col("l_returnflag") == "A", 100).otherwise(1)).alias("v")
    )
    out = views.percent_to_proportion(l, ["flag"], "v")
    return rounded(out.groupBy("flag").agg(F.sum("v").alias("total"), F.count("*").alias("rows")), 4)


@query(
    "harmonised_external_series", "Q7 J9",
    """WITH s AS (SELECT DISTINCT CAST(floor(s_acctbal / 50) AS INTEGER) AS band FROM supplier), c AS (SELECT CAST(floor(c_acctbal / 50) AS INTEGER) AS band, c_nationkey, count(*) AS customers FROM customer GROUP BY ALL)
    SELECT c.band, n_name, customers, s.band IS NOT NULL AS mapped FROM c JOIN nation ON n_nationkey = c_nationkey LEFT JOIN s ON s.band = c.band""",
)
def harmonised_external_series(spark, sf):
    # customers by balance band and nation; bands are known where a supplier has one
    band = lambda name: F.floor(F.col(name) / 50).cast("int").alias("band")
    c = table(spark, sf, "customer").groupBy(band("c_acctbal"), "c_nationkey").agg(F.count("*").alias("customers"))
    bands = table(spark, sf, "supplier").select(band("s_acctbal")).distinct().withColumn("known", F.col("band"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    found = views.harmonise_external(c, {"band": bands, "c_nationkey": names})
    both = [df.select("band", "n_name", "customers", F.lit(flag).alias("mapped")) for df, flag in zip(found, (True, False))]
    return both[0].unionByName(both[1])


@query(
    "assembled_model_table", "Q15 O4 V2",
    f"""WITH {_TWO}, t AS (SELECT * FROM tw UNION ALL SELECT 'orders', c_nationkey, CAST(year(o_orderdate) AS INTEGER), CAST(count(*) AS DOUBLE) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
    SELECT model, nation, yr, 'estimate' AS measure, round(estimate, 2) AS estimate FROM t""",
)
def assembled_model_table(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").cast("int").alias("yr"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    n = o.join(c, o.o_custkey == c.c_custkey).groupBy("nation", "yr").agg(F.count("*").cast("double").alias("estimate")).withColumn("model", F.lit("orders"))
    return rounded(views.rates_long(two_models(spark, sf).unionByName(n), ["model", "nation", "yr"], ["estimate"]), 2)


_TOLERANCE = "1e-6 * greatest(1, max(abs(d)))"


@query(
    "report_check_suite", "V12 V6",
    f"""WITH {_cube_sql()}, sound AS (SELECT Grouping AS g, Sex AS s, DeathYear AS y, nbdcode AS c, age AS a, Deaths AS d, Pop AS p, CASE WHEN Pop > 0 THEN 1e5 * Deaths / Pop END AS rate FROM x4 WHERE Grouping <= 10),
    x AS (SELECT 'sound' AS run, * FROM sound UNION ALL SELECT 'broken', * REPLACE (CASE WHEN g = 3 AND s = 3 AND a = 7 THEN 1.1 * d + 1 ELSE d END AS d) FROM sound),
    bad AS (SELECT run, 'national_is_sum' AS "check" FROM x GROUP BY run, s, y, c, a HAVING abs(sum(CASE WHEN g = 10 THEN -d ELSE d END)) > {_TOLERANCE}
      UNION ALL SELECT run, 'person_is_sum' FROM x GROUP BY run, g, y, c, a HAVING abs(sum(CASE WHEN s = 3 THEN -d ELSE d END)) > {_TOLERANCE}
      UNION ALL SELECT run, 'rate_arithmetic' FROM x WHERE p > 0 AND abs(rate - 1e5 * d / p) > 1e-6 * greatest(1, abs(rate))
      UNION ALL SELECT run, 'additive_ages' FROM x, (VALUES (25, 0), (26, 5)) t(code, low) WHERE a = code OR a BETWEEN low AND 19 GROUP BY run, g, s, y, c, code
        HAVING abs(sum(CASE WHEN a = code THEN -d ELSE d END)) > 1e-6 * greatest(1, coalesce(sum(d) FILTER (a = code), 0)))
    SELECT r.run, k."check", CASE WHEN count(b.run) = 0 THEN 'pass' ELSE 'fail' END AS status, count(b.run) AS failures
    FROM (VALUES ('sound'), ('broken')) r(run) CROSS JOIN (VALUES ('national_is_sum'), ('person_is_sum'), ('rate_arithmetic'), ('additive_ages')) k("check") LEFT JOIN bad b ON b.run = r.run AND b."check" = k."check" GROUP BY ALL""",
)
def report_check_suite(spark, sf):
    """The checks on the cube, and on a twin in which one age of one province is wrong, so that each check has something to find."""
    sound = materialise(cube(spark, sf).filter("Grouping <= 10"), "cube").select(
        F.col("Grouping").alias("geography"), F.col("Sex").alias("sex"), F.col("DeathYear").alias("year"), F.col("nbdcode").alias("series"),
        F.col("Age").alias("age"), F.col("Deaths").alias("deaths"), F.col("Pop").alias("population"), rates.crude_rate("Deaths", "Pop").alias("crude_rate"),
    )
    wrong = (F.col("geography") == 3) & (F.col("sex") == 3) & (F.col("age") == 7)
    broken = sound.withColumn("deaths", F.when(wrong, 1.1 * F.col("deaths") + 1).otherwise(F.col("deaths")))
    out = None
    for run, x in (("sound", sound), ("broken", broken)):
        bad = views.additive_ages(x, ["geography", "sex", "year", "series"], "age", "deaths", {25: AGES, 26: list(range(5, 20))})
        extra = bad.agg(F.count("*").alias("failures")).select(
            F.lit("additive_ages").alias("check"), F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"), "failures"
        )
        checks = views.report_checks(x).unionByName(extra).withColumn("run", F.lit(run))
        out = checks if out is None else out.unionByName(checks)
    return out
