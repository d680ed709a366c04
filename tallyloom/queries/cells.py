"""Grids, reshapes, aggregates, joins, set operations and validation."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyloom.operators import aggregate, compose, grid, hierarchy, schema, validate
from tallyloom.queries.inputs import (
    LINES_PART, LINES_SUPPLIER, ORDERS_GEO, PRIORITIES, STATUSES, UNKNOWN_PRIORITY, YEARS,
    cells_sql, lines_part, lines_supplier, order_cells, orders_geo, table, values, year_of,
)
from tallyloom.queries.registry import query, rounded
from tallyloom.session import small_table

ALL_PRIORITIES = sorted([*PRIORITIES, UNKNOWN_PRIORITY])

# ---------------------------------------------------------------- aggregates


@query(
    "grouped_sum_line_quantity", "A1 S1",
    """SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS yr, sum(l_quantity) AS qty
    FROM lineitem GROUP BY ALL""",
)
def grouped_sum_line_quantity(spark, sf):
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", year_of("l_shipdate").alias("yr"), F.col("l_quantity").alias("qty"))
    return aggregate.observed_sum(l, ["l_returnflag", "l_linestatus", "yr"], "qty", Observation())


@query(
    "event_tally", "A2",
    """SELECT user_id, event_type, CAST(day(ts) AS INTEGER) AS dy, CAST(count(*) AS DOUBLE) AS num FROM events GROUP BY ALL""",
)
def event_tally(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.dayofmonth("ts").cast("int").alias("dy"))
    return aggregate.tally(e, ["user_id", "event_type", "dy"])


@query(
    "annual_with_interpolated_year", "A3 A4 O7",
    f"""WITH {cells_sql('nation', 'yr', 'priority')}, keep AS (SELECT * FROM cells WHERE NOT (priority = '{UNKNOWN_PRIORITY}' AND yr = 1998)),
    fix AS (SELECT nation, 1998 AS yr, priority, sum(CASE yr WHEN 1997 THEN 2.0 / 3 WHEN 2000 THEN 1.0 / 3 END * n) AS n
      FROM cells WHERE priority = '{UNKNOWN_PRIORITY}' AND yr IN (1997, 2000) GROUP BY nation, priority)
    SELECT nation, CAST(yr AS INTEGER) AS yr, priority, round(n, 6) AS n FROM (SELECT * FROM keep UNION ALL SELECT * FROM fix WHERE abs(n) > 1e-12)""",
)
def annual_with_interpolated_year(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "priority")
    out = aggregate.annual_with_correction(
        cells, ["nation", "priority"], "yr", "n", F.col("priority") == UNKNOWN_PRIORITY, 1998, {1997: 2 / 3, 2000: 1 / 3}
    )
    return rounded(out)


@query(
    "replace_corrected_keys", "O7 J4",
    f"""WITH {cells_sql('nation', 'yr')} SELECT nation, yr, CASE WHEN yr = 2001 THEN 2 * n ELSE n END AS n FROM cells""",
)
def replace_corrected_keys(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr")
    return aggregate.replace_keys(cells, cells.filter("yr = 2001").withColumn("n", F.col("n") * 2), ["nation", "yr"])


@query(
    "pivot_status_by_nation_year", "A5 A7",
    f"""WITH {cells_sql('nation', 'yr', 'status')} SELECT nation, yr, {', '.join(f"coalesce(sum(n) FILTER (status = '{s}'), 0) AS c{s}" for s in STATUSES)},
    CAST(0 AS DOUBLE) AS cX FROM cells GROUP BY ALL""",
)
def pivot_status_by_nation_year(spark, sf):
    wide = grid.pivot_codes(order_cells(spark, sf, "nation", "yr", "status"), ["nation", "yr"], "status", STATUSES, "n")
    return grid.ensure_columns(wide, ["cF", "cO", "cP", "cX"])


@query(
    "unpivot_status", "A6",
    f"WITH {cells_sql('nation', 'yr', 'status')} SELECT nation, yr, status, n FROM cells",
)
def unpivot_status(spark, sf):
    wide = grid.pivot_codes(order_cells(spark, sf, "nation", "yr", "status"), ["nation", "yr"], "status", STATUSES, "n")
    return grid.unpivot_codes(wide, ["nation", "yr"], ["cF", "cO", "cP"], "status", "n", code_type="string")


@query(
    "margins_region_status", "A10",
    f"""WITH {cells_sql('regionkey', 'status', 'yr', 'priority')} SELECT CAST(coalesce(regionkey, 10) AS INTEGER) AS regionkey,
      coalesce(status, 'all') AS status, yr, priority, sum(n) AS n FROM cells
    GROUP BY GROUPING SETS ((regionkey, status, yr, priority), (status, yr, priority), (regionkey, yr, priority), (yr, priority))""",
)
def margins_region_status(spark, sf):
    cells = order_cells(spark, sf, "regionkey", "status", "yr", "priority")
    return aggregate.margins(cells, ["regionkey", "status", "yr", "priority"], {"regionkey": 10, "status": "all"}, ["n"])


SERIES = {"all": ALL_PRIORITIES, "urgent_high": ["1-URGENT", "2-HIGH"], "unspecified": [UNKNOWN_PRIORITY], "1-URGENT": ["1-URGENT"]}
AGE_GROUPS = {"all_years": YEARS, "early": [1995, 1996, 1997], "late": [1999, 2000, 2001], "y1998": [1998]}


@query(
    "derived_series_by_period", "A11 A14",
    f"""WITH {cells_sql('nation', 'yr', 'priority')} SELECT nation, s.series, a.age_group, sum(n) AS n FROM cells
    JOIN {values([(g, c) for g, cs in SERIES.items() for c in cs], 'series', 'priority').replace('AS v', 'AS s')} USING (priority)
    JOIN {values([(g, c) for g, cs in AGE_GROUPS.items() for c in cs], 'age_group', 'yr').replace('AS v', 'AS a')} USING (yr) GROUP BY ALL""",
)
def derived_series_by_period(spark, sf):
    return aggregate.derived_series(order_cells(spark, sf, "nation", "yr", "priority"), ["nation"], "priority", "yr", "n", SERIES, AGE_GROUPS)


@query(
    "weighted_mean_with_fallback", "A15",
    """WITH x AS (SELECT l_suppkey, l_returnflag, CASE WHEN l_linestatus = 'F' THEN l_quantity END AS w, l_discount AS v FROM lineitem)
    SELECT l_suppkey, l_returnflag, round(coalesce(sum(w) FILTER (w > 0), 0), 6) AS w,
      round(coalesce(sum(w * v) FILTER (w > 0) / nullif(sum(w) FILTER (w > 0), 0), avg(v)), 6) AS v FROM x GROUP BY ALL""",
)
def weighted_mean_with_fallback(spark, sf):
    l = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("w"), F.col("l_discount").alias("v")
    )
    return rounded(aggregate.weighted_mean(l, ["l_suppkey", "l_returnflag"], "v", "w"))


@query(
    "component_cross_tab", "A16",
    f"""WITH {cells_sql('nation', 'yr', 'status', 'segment')} SELECT nation, yr,
      {', '.join(f"coalesce(sum(n) FILTER ({a} AND {b}), 0) AS {k}" for k, a, b in [('d11', "segment = 'BUILDING'", "status = 'F'"), ('d12', "segment = 'BUILDING'", "status <> 'F'"), ('d21', "segment <> 'BUILDING'", "status = 'F'"), ('d22', "segment <> 'BUILDING'", "status <> 'F'")])}
    FROM cells GROUP BY ALL""",
)
def component_cross_tab(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "status", "segment")
    return aggregate.component_table(cells, ["nation", "yr"], F.col("segment") == "BUILDING", F.col("status") == "F", "n")


@query(
    "null_aware_aggregates", "A17",
    """SELECT doc.lang, doc.source, sum(CAST(l.quality AS DOUBLE)) AS quality_sum, max(CAST(l.quality AS DOUBLE)) AS quality_max, count(*) AS docs
    FROM documents doc LEFT JOIN labels l USING (doc_id) GROUP BY ALL""",
)
def null_aware_aggregates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    l = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return d.join(l, "doc_id", "left").groupBy("lang", "source").agg(
        aggregate.sum_or_null("quality").alias("quality_sum"), aggregate.max_finite("quality").alias("quality_max"), F.count("*").alias("docs")
    )


@query(
    "merge_consistent_duplicates", "A18",
    """SELECT l_orderkey, count(*) AS "rows", max(o_totalprice) AS merged, max(o_totalprice) - min(o_totalprice) AS spread
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def merge_consistent_duplicates(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    x = l.join(o, l.l_orderkey == o.o_orderkey)
    return aggregate.duplicate_spread(x, ["l_orderkey"], "o_totalprice")


@query(
    "merged_order_price", "A18 O5",
    """SELECT l_orderkey, max(o_totalprice) AS o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def merged_order_price(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return aggregate.merge_consistent(l.join(o, l.l_orderkey == o.o_orderkey), ["l_orderkey"], ["o_totalprice"])


@query(
    "catalogue_of_series", "A23",
    f"""WITH {ORDERS_GEO} SELECT region, status, priority, count(*) AS "rows" FROM og GROUP BY ALL""",
)
def catalogue_of_series(spark, sf):
    return aggregate.catalogue(orders_geo(spark, sf), ["region", "status", "priority"])


@query(
    "coverage_by_region", "A24",
    f"""WITH {cells_sql('region', 'nation', 'yr', 'priority')} SELECT region, count(*) AS "rows", min(yr) AS first_year, max(yr) AS last_year,
      count(DISTINCT (nation, priority)) AS cells, string_agg(DISTINCT priority, ',' ORDER BY priority) AS labels FROM cells GROUP BY region""",
)
def coverage_by_region(spark, sf):
    return aggregate.coverage(order_cells(spark, sf, "region", "nation", "yr", "priority"), ["region"], "yr", ["nation", "priority"], "priority")


@query(
    "kish_effective_size", "A25",
    f"""WITH {LINES_SUPPLIER} SELECT nation, round(power(sum(qty), 2) / sum(qty * qty), 6) AS ess FROM ls WHERE qty > 0 GROUP BY nation""",
)
def kish_effective_size(spark, sf):
    return rounded(lines_supplier(spark, sf).groupBy("nation").agg(aggregate.kish("qty").alias("ess")))


@query(
    "top_nations_with_forced", "A26 O3",
    f"""WITH {cells_sql('nation')} SELECT nation, n FROM (SELECT * FROM cells ORDER BY n DESC, nation LIMIT 5)
    UNION SELECT nation, n FROM cells WHERE nation IN (0, 7)""",
)
def top_nations_with_forced(spark, sf):
    return aggregate.top_with_forced(order_cells(spark, sf, "nation"), "nation", "n", 5, [0, 7])


@query(
    "canonical_count_cells", "A27 P30",
    f"""WITH {cells_sql('nation', 'yr')} SELECT nation, yr, n AS deaths FROM cells""",
)
def canonical_count_cells(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "status")
    spec = schema.CellSchema(("nation", "yr"), "deaths", ("count", "n"))
    return schema.finalise_cells(spec.canonical(cells), spec)


# ---------------------------------------------------------------- grids and joins


@query(
    "complete_grid_supplied_levels", "J6 A5",
    f"""WITH {cells_sql('nation', 'yr', 'mon', 'status')} SELECT CAST(g.nation AS INTEGER) AS nation, CAST(g.yr AS INTEGER) AS yr, CAST(g.mon AS INTEGER) AS mon, g.status, coalesce(c.n, 0) AS n
    FROM (SELECT a.i AS nation, b.i AS yr, m.i AS mon, s.status FROM range(25) a(i), range(1995, 2002) b(i), range(1, 13) m(i),
      {values([(s,) for s in STATUSES], 'status').replace('AS v', 'AS s')}) g LEFT JOIN cells c USING (nation, yr, mon, status)""",
)
def complete_grid_supplied_levels(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "mon", "status")
    levels = {"nation": list(range(25)), "yr": YEARS, "mon": list(range(1, 13)), "status": STATUSES}
    return grid.complete_cells(cells, ["nation", "yr", "mon", "status"], ["n"], levels)


@query(
    "complete_grid_observed_levels", "J6",
    f"""WITH {LINES_PART}, cells AS (SELECT brand, psize, flag, CAST(count(*) AS DOUBLE) AS n FROM lp GROUP BY ALL)
    SELECT b.brand, p.psize, f.flag, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT brand FROM cells) b, (SELECT DISTINCT psize FROM cells) p,
    (SELECT DISTINCT flag FROM cells) f LEFT JOIN cells c ON c.brand = b.brand AND c.psize = p.psize AND c.flag = f.flag""",
)
def complete_grid_observed_levels(spark, sf):
    cells = aggregate.tally(lines_part(spark, sf), ["brand", "psize", "flag"], "n")
    return grid.complete_cells(cells, ["brand", "psize", "flag"], ["n"])


@query(
    "attach_bounded_levels", "J5",
    """SELECT n_nationkey, r_regionkey, CAST(count(*) OVER () AS BIGINT) AS cells FROM nation, region""",
)
def attach_bounded_levels(spark, sf):
    n, r = table(spark, sf, "nation").select("n_nationkey"), table(spark, sf, "region").select("r_regionkey")
    both = grid.attach_all(n, r)
    return both.withColumn("cells", both.agg(F.count("*")).scalar())


@query(
    "grid_of_many_levels", "J5 J6",
    """WITH k AS (SELECT DISTINCT l_orderkey FROM lineitem), f AS (SELECT DISTINCT l_returnflag FROM lineitem)
    SELECT l_returnflag, l_orderkey, coalesce(q, 0) AS l_quantity FROM f CROSS JOIN k LEFT JOIN (SELECT l_returnflag, l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY ALL) USING (l_returnflag, l_orderkey)""",
)
def grid_of_many_levels(spark, sf):
    """Every order with every flag: a dimension of more levels than an array value holds."""
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity")
    return grid.complete_cells(l, ["l_returnflag", "l_orderkey"], ["l_quantity"])


@query(
    "label_chunks_of_parts", "A24 A22",
    """WITH d AS (SELECT DISTINCT l_returnflag, CAST(l_orderkey AS VARCHAR) AS l FROM lineitem)
    SELECT l_returnflag, count(*) AS labels, min(l) AS first, max(l) AS last, CAST(sum(length(l)) AS BIGINT) AS chars, TRUE AS bounded FROM d GROUP BY ALL""",
)
def label_chunks_of_parts(spark, sf):
    """All order numbers under a flag, in chunks; told by what the chunks hold."""
    c = aggregate.label_chunks(table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey"), ["l_returnflag"], "l_orderkey")
    names = F.split("labels", ",")
    n = F.size(names)
    return c.groupBy("l_returnflag").agg(
        F.sum(n).alias("labels"), F.min("first").alias("first"), F.max(F.element_at(names, -1)).alias("last"),
        F.sum(F.char_length("labels") - n + 1).alias("chars"), (F.max(n) <= 1000).alias("bounded"),
    )


@query(
    "group_by_target_codes", "J7",
    f"""WITH {cells_sql('nation', 'mon', 'yr', 'priority')} SELECT g.nation, g.yr, g.mon, p.priority, coalesce(c.n, 0) AS n
    FROM (SELECT DISTINCT nation, yr, mon FROM cells) g, {values([(p,) for p in ALL_PRIORITIES], 'priority').replace('AS v', 'AS p')}
    LEFT JOIN cells c ON c.nation = g.nation AND c.yr = g.yr AND c.mon = g.mon AND c.priority = p.priority""",
)
def group_by_target_codes(spark, sf):
    return grid.complete_codes(order_cells(spark, sf, "nation", "yr", "mon", "priority"), ["nation", "yr", "mon"], "priority", ALL_PRIORITIES, "n")


_SEGMENTS = """o AS (SELECT nullif(c_mktsegment, 'BUILDING') AS seg, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(o_custkey % 70 AS INTEGER) AS code FROM orders JOIN customer ON o_custkey = c_custkey)"""


def segment_orders(spark, sf):
    """Orders by market segment, one of which counts as not known."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    seg = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return o.select(seg.alias("seg"), F.year("o_orderdate").alias("yr"), (F.col("o_custkey") % 70).cast("int").alias("code"))


@query(
    "complete_cells_with_missing_key", "J6",
    f"""WITH {_SEGMENTS}, c AS (SELECT seg, yr, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY ALL)
    SELECT s.seg, y.yr, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT seg FROM c WHERE seg IS NOT NULL) s CROSS JOIN (SELECT DISTINCT yr FROM c) y
    LEFT JOIN c ON c.seg = s.seg AND c.yr = y.yr UNION ALL SELECT seg, yr, n FROM c WHERE seg IS NULL""",
)
def complete_cells_with_missing_key(spark, sf):
    return grid.complete_cells(aggregate.tally(segment_orders(spark, sf), ["seg", "yr"], "n"), ["seg", "yr"], ["n"])


@query(
    "group_by_many_codes_with_missing_key", "J7",
    f"""WITH {_SEGMENTS}, c AS (SELECT seg, code, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY ALL)
    SELECT g.seg, CAST(t.i AS INTEGER) AS code, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT seg FROM c) g CROSS JOIN range(80) t(i)
    LEFT JOIN c ON c.seg IS NOT DISTINCT FROM g.seg AND c.code = t.i""",
)
def group_by_many_codes_with_missing_key(spark, sf):
    cells = aggregate.tally(segment_orders(spark, sf), ["seg", "code"], "n")
    return grid.complete_codes(cells, ["seg"], "code", list(range(80)), "n")


@query(
    "parts_without_lines", "J1 J4 O6",
    """SELECT p_brand, count(*) AS parts, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AS never_returned
    FROM part GROUP BY ALL""",
)
def parts_without_lines(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    marked = p.join(returned.withColumn("hit", F.lit(True)), "p_partkey", "left")
    return marked.groupBy("p_brand").agg(F.count("*").alias("parts"), F.count_if(F.col("hit").isNull()).alias("never_returned"))


@query(
    "full_outer_with_presence", "J3",
    """WITH c AS (SELECT c_nationkey AS nation, CAST(floor(c_acctbal / 1000) AS INTEGER) AS band, CAST(count(*) AS DOUBLE) AS customers FROM customer GROUP BY ALL),
    s AS (SELECT s_nationkey AS nation, CAST(floor(s_acctbal / 1000) AS INTEGER) AS band, CAST(count(*) AS DOUBLE) AS suppliers FROM supplier GROUP BY ALL)
    SELECT nation, band, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, customers IS NOT NULL AS in_customers, suppliers IS NOT NULL AS in_suppliers
    FROM c FULL JOIN s USING (nation, band)""",
)
def full_outer_with_presence(spark, sf):
    band = lambda name: F.floor(F.col(name) / 1000).cast("int").alias("band")
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation"), band("c_acctbal")).agg(F.count("*").cast("double").alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation"), band("s_acctbal")).agg(F.count("*").cast("double").alias("suppliers"))
    j = c.join(s, ["nation", "band"], "full_outer")
    return j.withColumns({"in_customers": F.col("customers").isNotNull(), "in_suppliers": F.col("suppliers").isNotNull()}).fillna(0.0, ["customers", "suppliers"])


@query(
    "code_domain_set_operations", "O6 V2",
    """WITH a AS (SELECT DISTINCT CAST(floor(c_acctbal / 50) AS INTEGER) AS band FROM customer), b AS (SELECT DISTINCT CAST(floor(s_acctbal / 50) AS INTEGER) AS band FROM supplier)
    SELECT band, 'left_only' AS side FROM a WHERE band NOT IN (SELECT band FROM b)
    UNION ALL SELECT band, 'right_only' FROM b WHERE band NOT IN (SELECT band FROM a)
    UNION ALL SELECT band, 'both' FROM a WHERE band IN (SELECT band FROM b)""",
)
def code_domain_set_operations(spark, sf):
    a = table(spark, sf, "customer").select(F.floor(F.col("c_acctbal") / 50).cast("int").alias("band"))
    b = table(spark, sf, "supplier").select(F.floor(F.col("s_acctbal") / 50).cast("int").alias("band"))
    return validate.same_domain(a, b, ["band"]).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


@query(
    "union_with_missing_columns", "O4",
    """SELECT c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier""",
)
def union_with_missing_columns(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query(
    "distinct_on_key", "O5 O1",
    """SELECT DISTINCT l_partkey, l_suppkey FROM lineitem ORDER BY ALL""",
)
def distinct_on_key(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates(["l_partkey", "l_suppkey"]).orderBy("l_partkey", "l_suppkey")


@query(
    "natural_key_rejoin", "W2 J1",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies, round(sum(l_quantity), 6) AS qty FROM lineitem GROUP BY ALL""",
)
def natural_key_rejoin(spark, sf):
    # a row is addressed by its natural key, never by a generated row number
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"))
    return rounded(l.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"), F.sum("qty").alias("qty")))


@query(
    "sort_order_of_new_series", "W6",
    f"""WITH {cells_sql('region', 'nation')} SELECT region, nation, n, CAST(dense_rank() OVER (PARTITION BY region ORDER BY n) + 100 AS INTEGER) AS sort_order FROM cells""",
)
def sort_order_of_new_series(spark, sf):
    out = compose.ordered_codes(order_cells(spark, sf, "region", "nation"), ["region"], "n", start=100)
    return out.withColumn("sort_order", F.col("sort_order").cast("int"))


@query(
    "close_to_one", "W8",
    f"""WITH {cells_sql('nation', 'yr', 'priority')}, f AS (SELECT nation, yr, priority, greatest(n / sum(n) OVER (PARTITION BY nation, yr), 0.05) AS f FROM cells)
    SELECT nation, yr, priority, round(f / sum(f) OVER (PARTITION BY nation, yr), 6) AS f FROM f""",
)
def close_to_one(spark, sf):
    x = compose.share(order_cells(spark, sf, "nation", "yr", "priority"), ["nation", "yr"], "n", "f").drop("n")
    return rounded(compose.close(x.withColumn("f", F.greatest("f", F.lit(0.05))), ["nation", "yr"], "f"))


@query(
    "weighted_quantile_of_quantity", "W7",
    f"""WITH {LINES_PART}, v AS (SELECT brand, psize AS x, sum(qty) AS w FROM lp GROUP BY ALL),
    c AS (SELECT brand, x, sum(w) OVER (PARTITION BY brand ORDER BY x) AS cw, sum(w) OVER (PARTITION BY brand) AS tw FROM v)
    SELECT brand, CAST(min(x) FILTER (cw >= 0.5 * tw) AS DOUBLE) AS q50, CAST(min(x) FILTER (cw >= 0.9 * tw) AS DOUBLE) AS q90 FROM c GROUP BY brand""",
)
def weighted_quantile_of_quantity(spark, sf):
    from tallyloom.operators.quantile import weighted_quantiles

    return weighted_quantiles(lines_part(spark, sf), ["brand"], "psize", "qty", {"q50": 0.5, "q90": 0.9})


# ---------------------------------------------------------------- hierarchy

REGION_LAYERS = [(n, 100 + n // 5, 1.0, "group") for n in range(25)] + [(n, 200, 1.0, "all") for n in range(25)] + [
    (n, n, 1.0, "detailed") for n in range(25)
] + [(n, 300, 0.5, "half") for n in range(0, 25, 2)]
_LAYERS_SQL = values(REGION_LAYERS, "nation", "target", "weight", "hierarchy")


def region_mapping(spark):
    return small_table(spark, REGION_LAYERS, "nation int, target int, weight double, hierarchy string")


@query(
    "hierarchy_roll_up", "A8 J2",
    f"""WITH {cells_sql('nation', 'yr', 'status')}, m AS (SELECT * FROM {_LAYERS_SQL})
    SELECT yr, status, CAST(target AS INTEGER) AS target, round(CAST(sum(n * weight) AS DOUBLE), 6) AS n FROM cells JOIN m USING (nation) GROUP BY ALL""",
)
def hierarchy_roll_up(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "status")
    targets = sorted({r[1] for r in REGION_LAYERS})
    return rounded(hierarchy.roll_up(cells, region_mapping(spark), ["yr", "status"], "nation", "target", "n", complete=targets))


@query(
    "hierarchy_layer_conservation", "A8 V7",
    f"""WITH {cells_sql('nation', 'yr')} SELECT yr, sum(n) AS before, sum(n) AS after, CAST(0 AS DOUBLE) AS error FROM cells GROUP BY yr""",
)
def hierarchy_layer_conservation(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr")
    m = region_mapping(spark)
    rolled = hierarchy.roll_up(cells, m, ["yr"], "nation", "target", "n")
    return rounded(hierarchy.layer_conservation(cells, rolled, m, ["yr"], "nation", "target", "n", "detailed"))


@query(
    "mapping_contract_check", "A9",
    f"""WITH m AS (SELECT * FROM {_LAYERS_SQL}), live AS (SELECT DISTINCT c_nationkey AS nation FROM customer), x AS (SELECT m.* FROM m JOIN live USING (nation)),
    s AS (SELECT hierarchy, nation, count(DISTINCT target) AS t, min(weight) AS lo, max(weight) AS hi FROM x GROUP BY ALL),
    a AS (SELECT hierarchy, count(*) AS sources, count(*) FILTER (t > 1) AS multi_target_sources, count(*) FILTER (lo <> 1 OR hi <> 1) AS non_unit_weights FROM s GROUP BY ALL),
    b AS (SELECT hierarchy, count(DISTINCT target) AS targets FROM x GROUP BY ALL)
    SELECT a.*, targets, hierarchy <> 'detailed' OR (multi_target_sources = 0 AND non_unit_weights = 0) AS ok FROM a JOIN b USING (hierarchy)""",
)
def mapping_contract_check(spark, sf):
    live = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).distinct()
    return hierarchy.mapping_contract(region_mapping(spark).join(live, "nation", "left_semi"), "nation", "target", "detailed")


@query(
    "unmapped_mass", "A8 V13 J4",
    """SELECT o_custkey AS account, CAST(sum(o_totalprice) AS DOUBLE) AS amount FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""",
)
def unmapped_mass(spark, sf):
    # account numbers are those of suppliers; orders of other accounts are not mapped
    mapping = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("account"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_totalprice").cast("double").alias("price"))
    return rounded(hierarchy.unmapped_mass(orders, mapping, "account", "price"), 2)


@query(
    "series_mapping_of_measures", "A21 O4",
    f"""WITH {cells_sql('nation', 'yr', 'status')}, m AS (SELECT * FROM {_LAYERS_SQL}), w AS (SELECT nation, yr,
      {', '.join(f"coalesce(sum(n) FILTER (status = '{s}'), 0) AS c{s}" for s in STATUSES)} FROM cells GROUP BY ALL)
    SELECT yr, CAST(target AS INTEGER) AS target, {', '.join(f'round(CAST(sum(c{s} * weight) AS DOUBLE), 6) AS c{s}' for s in STATUSES)} FROM w JOIN m USING (nation) GROUP BY ALL""",
)
def series_mapping_of_measures(spark, sf):
    wide = grid.pivot_codes(order_cells(spark, sf, "nation", "yr", "status"), ["nation", "yr"], "status", STATUSES, "n")
    return rounded(hierarchy.map_measures(wide, region_mapping(spark), ["yr"], "nation", "target", [f"c{s}" for s in STATUSES]))


@query(
    "supported_series_report", "A22 V16",
    f"""WITH m AS (SELECT * FROM {_LAYERS_SQL} UNION ALL SELECT 3, 400, 1.0, 'dup' UNION ALL SELECT 3, 400, 1.0, 'dup' UNION ALL SELECT 77, 401, 1.0, 'gap' UNION ALL SELECT 4, 401, 1.0, 'gap'),
    have AS (SELECT DISTINCT s_nationkey AS nation FROM supplier),
    s AS (SELECT target, nation, sum(weight) AS w FROM m GROUP BY ALL), f AS (SELECT s.*, h.nation IS NULL AS gone FROM s LEFT JOIN have h USING (nation))
    SELECT CAST(target AS INTEGER) AS target, count(*) AS components, count(*) FILTER (gone) AS missing, count(*) FILTER (w > 1 + 1e-12) AS overlapping,
      coalesce(string_agg(CAST(nation AS VARCHAR), ',' ORDER BY CAST(nation AS VARCHAR)) FILTER (gone), '') AS missing_codes,
      CASE WHEN count(*) FILTER (gone) > 0 THEN 'missing_component' WHEN count(*) FILTER (w > 1 + 1e-12) > 0 THEN 'overlapping_components' ELSE 'supported' END AS status
    FROM f GROUP BY target""",
)
def supported_series_report(spark, sf):
    extra = small_table(spark, [(3, 400, 1.0, "dup")] * 2 + [(77, 401, 1.0, "gap"), (4, 401, 1.0, "gap")], "nation int, target int, weight double, hierarchy string")
    have = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return hierarchy.supported_series(region_mapping(spark).unionByName(extra), have, "target", "nation")


@query(
    "series_membership_differences", "V16 A22",
    """WITH c AS (SELECT DISTINCT c_nationkey AS series, CAST(floor(c_acctbal / 500) AS INTEGER) AS band FROM customer),
    s AS (SELECT DISTINCT s_nationkey AS series, CAST(floor(s_acctbal / 500) AS INTEGER) AS band FROM supplier)
    SELECT series, band, 'configured_only' AS side FROM c WHERE (series, band) NOT IN (SELECT (series, band) FROM s)
    UNION ALL SELECT series, band, 'derived_only' FROM s WHERE (series, band) NOT IN (SELECT (series, band) FROM c)""",
)
def series_membership_differences(spark, sf):
    # balance bands that occur among a nation's customers and among its suppliers
    band = lambda name: F.floor(F.col(name) / 500).cast("int").alias("band")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("series"), band("c_acctbal"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("series"), band("s_acctbal"))
    return hierarchy.membership_differences(c, s, "series", "band")


@query(
    "semicolon_code_lists", "P24",
    """WITH x AS (SELECT r_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), '; ' ORDER BY n_nationkey) AS codes FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
    SELECT r_regionkey, codes, CAST(trim(u) AS INTEGER) AS member FROM (SELECT r_regionkey, codes, unnest(string_split(codes, ';')) AS u FROM x)""",
)
def semicolon_code_lists(spark, sf):
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda v: v.cast("string")), "; ").alias("codes")
    )
    return hierarchy.expand_list(n, "codes", "member")


@query(
    "label_attachment", "J9 P23",
    """SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def label_attachment(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    labels = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return hierarchy.attach_labels(c, labels, "c_nationkey", "n_name").select("c_custkey", "c_nationkey", "n_name")


@query(
    "alias_resolution", "P23 P24 Q7",
    """WITH a AS (SELECT DISTINCT trim(regexp_replace(lower(r_name), '[^a-z0-9]+', ' ', 'g')) AS k, r_regionkey FROM region)
    SELECT n_nationkey, n_regionkey, r_regionkey, regexp_replace(k, ' ', '_', 'g') AS slug FROM nation JOIN a ON r_regionkey = n_regionkey""",
)
def alias_resolution(spark, sf):
    from tallyloom.functions.columns import slug

    r = table(spark, sf, "region").select("r_name", "r_regionkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    raw = n.join(r.select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("  "), F.initcap("r_name"), F.lit(" ")).alias("label")), "n_regionkey")
    out = hierarchy.attach_by_alias(raw, "label", r, "r_name", "r_regionkey")
    return out.select("n_nationkey", "n_regionkey", "r_regionkey", slug("label").alias("slug"))


@query(
    "ambiguous_aliases", "P24 P23",
    """SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS p_name, count(DISTINCT p_brand) AS targets FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""",
)
def ambiguous_aliases(spark, sf):
    return hierarchy.ambiguous_aliases(table(spark, sf, "part").select("p_name", "p_brand"), "p_name", "p_brand")


# ---------------------------------------------------------------- validation


@query(
    "validation_report", "V1 V2 V3 V4 V5 V6",
    f"""WITH {cells_sql('nation', 'yr', 'priority')}
    SELECT 'unique_key' AS "check", CAST(0 AS BIGINT) AS failures, CAST(0 AS DOUBLE) AS worst, TRUE AS ok
    UNION ALL SELECT 'duplicate_lines', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)),
      CAST((SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS DOUBLE),
      (SELECT count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
    UNION ALL SELECT 'non_negative', (SELECT count(*) FROM customer WHERE c_acctbal < 0), (SELECT least(min(c_acctbal), 0) FROM customer), (SELECT count(*) = 0 FROM customer WHERE c_acctbal < 0)
    UNION ALL SELECT 'no_missing', CAST(0 AS BIGINT), 0, TRUE
    UNION ALL SELECT 'total_preserved', CAST(0 AS BIGINT), 0, TRUE""",
)
def validation_report(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "priority")
    validate.required_columns(cells, ["nation", "yr", "priority", "n"])
    rolled = aggregate.grouped_sum(cells, ["yr"], ["n"])
    checks = validate.report(
        validate.unique_key(cells, ["nation", "yr", "priority"]),
        validate.unique_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "duplicate_lines"),
        validate.non_negative(table(spark, sf, "customer"), ["c_acctbal"]),
        validate.no_missing(cells, ["nation", "yr", "priority", "n"]),
        validate.total_preserved(cells, rolled, "n"),
    )
    return rounded(validate.enforce(checks, validate.Policy.REPORT))


@query(
    "offending_rows_preview", "O2 V2",
    """SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY ALL LIMIT 10""",
)
def offending_rows_preview(spark, sf):
    return validate.examples(validate.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"])


@query(
    "table_error_two_measures", "V8 V14",
    """WITH l AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v FROM orders GROUP BY 1),
    r AS (SELECT o_custkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
    j AS (SELECT CAST(coalesce(l.v, 0) AS DOUBLE) AS a, CAST(coalesce(r.v, 0) AS DOUBLE) AS b FROM l FULL JOIN r USING (k))
    SELECT count(*) AS cells, round(max(abs(a - b)), 2) AS max_absolute, round(max(abs(a - b) / greatest(1.0, abs(a), abs(b))), 6) AS max_relative,
      count(*) FILTER (abs(a - b) > 1e-6 AND abs(a - b) / greatest(1.0, abs(a), abs(b)) > 2e-7) AS over_tolerance FROM j""",
)
def table_error_two_measures(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    l = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    left = o.groupBy("k").agg(F.sum("p").cast("double").alias("v"))
    right = o.join(l, o.o_orderkey == l.l_orderkey).groupBy("k").agg(F.sum("v").cast("double").alias("v"))
    out = validate.table_error(left, right, ["k"], "v")
    return out.withColumns({"max_absolute": F.round("max_absolute", 2), "max_relative": F.round("max_relative", 6)})


_DIFF_SQL = """WITH l AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY ALL),
    r AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, CAST(count(*) AS DOUBLE) AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 3 GROUP BY ALL),
    d AS (SELECT nation, segment, l.n AS n_left, r.n AS n_right, CASE WHEN l.n IS NULL THEN 'right_only' WHEN r.n IS NULL THEN 'left_only' ELSE 'both' END AS key_status
      FROM l FULL JOIN r USING (nation, segment)),
    e AS (SELECT *, abs(n_left - n_right) AS n_abs, CASE WHEN n_left = n_right THEN 0.0 ELSE abs(n_left - n_right) / greatest(abs(n_left), abs(n_right)) END AS n_rel FROM d),
    f AS (SELECT *, key_status = 'both' AND coalesce(n_abs <= 1e-6 OR n_rel <= 1e-7, FALSE) AS n_match FROM e)"""


def _versions(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    left = aggregate.tally(c, ["nation", "segment"], "n")
    right = aggregate.tally(c.filter("c_acctbal > 0 AND nation <> 3"), ["nation", "segment"], "n")
    return left, right


@query(
    "checkpoint_diff_rows", "V9 J3",
    f"""{_DIFF_SQL} SELECT nation, segment, n_left, n_right, key_status, round(n_abs, 6) AS n_abs, round(CAST(n_rel AS DOUBLE), 6) AS n_rel, n_match, n_match AS all_match FROM f""",
)
def checkpoint_diff_rows(spark, sf):
    return rounded(validate.checkpoint_diff(*_versions(spark, sf), ["nation", "segment"], ["n"]))


@query(
    "checkpoint_diff_summary", "V9",
    f"""{_DIFF_SQL} SELECT count(*) AS "rows", count(*) FILTER (key_status = 'both') AS both, count(*) FILTER (key_status = 'left_only') AS left_only,
      count(*) FILTER (key_status = 'right_only') AS right_only, count(*) FILTER (n_match) AS matching, count(*) FILTER (n_match) AS n_matching, max(n_abs) AS n_max_abs FROM f""",
)
def checkpoint_diff_summary(spark, sf):
    return validate.diff_summary(validate.checkpoint_diff(*_versions(spark, sf), ["nation", "segment"], ["n"]), ["n"])


@query(
    "exact_table_differences", "V10",
    """WITH a AS (SELECT l_partkey, l_suppkey, count(*) AS c FROM lineitem GROUP BY ALL), b AS (SELECT l_partkey, l_suppkey, count(*) AS c FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
    SELECT l_partkey, l_suppkey, a.c - coalesce(b.c, 0) AS surplus FROM a LEFT JOIN b USING (l_partkey, l_suppkey) WHERE a.c <> coalesce(b.c, 0)""",
)
def exact_table_differences(spark, sf):
    l = table(spark, sf, "lineitem")
    return validate.exact_differences(l.select("l_partkey", "l_suppkey"), l.filter("l_returnflag <> 'R'").select("l_partkey", "l_suppkey"))


@query(
    "composition_closure_check", "V11",
    f"""WITH {cells_sql('nation', 'yr', 'mon', 'priority')}, f AS (SELECT *, n / sum(n) OVER (PARTITION BY nation, yr, mon) AS f FROM cells),
    g AS (SELECT nation, yr, mon, count(*) AS c, abs(sum(f) - 1) AS gap FROM f GROUP BY ALL)
    SELECT 'composition_closure' AS "check", count(*) FILTER (c <> 5) AS failures, CAST(0 AS DOUBLE) AS worst, count(*) FILTER (c <> 5) = 0 AS ok FROM g""",
)
def composition_closure_check(spark, sf):
    x = compose.share(order_cells(spark, sf, "nation", "yr", "mon", "priority"), ["nation", "yr", "mon"], "n", "f")
    return rounded(validate.composition_closure(x, ["nation", "yr", "mon"], "priority", "f", ALL_PRIORITIES))


@query(
    "unmapped_records_with_examples", "V13",
    """WITH u AS (SELECT p_type, count(*) AS n FROM part WHERE p_type IN ('PROMO', 'ECONOMY') GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS codes, string_agg(p_type, ',' ORDER BY p_type) AS examples FROM u""",
)
def unmapped_records_with_examples(spark, sf):
    return validate.unmapped(table(spark, sf, "part"), F.col("p_type").isin("PROMO", "ECONOMY"), "p_type")


@query(
    "reconstruction_preflight", "V14 V8",
    f"""WITH {cells_sql('nation', 'yr')} SELECT 'orders_by_nation' AS pair, count(*) AS cells, CAST(0 AS DOUBLE) AS max_absolute, CAST(0 AS DOUBLE) AS max_relative, CAST(0 AS BIGINT) AS over_tolerance FROM cells
    UNION ALL SELECT 'orders_by_year', (SELECT count(DISTINCT yr) FROM cells), 0, 0, 0
    UNION ALL SELECT 'one_cell_off', count(*), 1, max(CASE WHEN nation = 3 AND yr = 1996 THEN round(1 / (n + 1), 9) ELSE 0 END), 1 FROM cells""",
)
def reconstruction_preflight(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "status")
    rebuilt = orders_geo(spark, sf).groupBy("nation", "yr").agg(F.count("*").cast("double").alias("n"))
    saved = aggregate.grouped_sum(cells, ["nation", "yr"], ["n"])
    a = validate.table_error(saved, rebuilt, ["nation", "yr"], "n").withColumn("pair", F.lit("orders_by_nation"))
    b = validate.table_error(aggregate.grouped_sum(saved, ["yr"], ["n"]), aggregate.grouped_sum(rebuilt, ["yr"], ["n"]), ["yr"], "n").withColumn("pair", F.lit("orders_by_year"))
    # a rebuilt table with one count too many shows that a difference is found
    wrong = rebuilt.withColumn("n", F.when((F.col("nation") == 3) & (F.col("yr") == 1996), F.col("n") + 1).otherwise(F.col("n")))
    c = validate.table_error(saved, wrong, ["nation", "yr"], "n").withColumn("pair", F.lit("one_cell_off"))
    return rounded(a.unionByName(b).unionByName(c), 9)
