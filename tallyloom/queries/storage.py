"""Sources and sinks: stage tables, partitioned stores, manifests and polymorphic ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.operators import compose, grid, schema
from tallyloom.plans import views
from tallyloom.queries.inputs import SEGMENTS, STATUSES, YEARS, cells_sql, order_cells, table, values
from tallyloom.queries.registry import query, rounded
from tallyloom.session import ensure_checkpoint_dir
from tallyloom.sources import inputs as contract
from tallyloom.sources import checked, stores, tabular, wide
from tallyloom.sources.stage import StageStore


def scratch(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/query-{uuid.uuid4().hex}"


_CELLS = f"WITH {cells_sql('nation', 'yr', 'status')} SELECT nation, yr, status, n FROM cells"


@query("stage_table_round_trip", "S3 S2 O1", _CELLS)
def stage_table_round_trip(spark, sf):
    store = StageStore(spark, scratch(spark))
    cells = order_cells(spark, sf, "nation", "yr", "status")
    return store.write(cells, "order_cells", sort_by=["nation", "yr", "status"])


@query("csv_round_trip", "S1 S2", _CELLS)
def csv_round_trip(spark, sf):
    path = f"{scratch(spark)}/cells.csv"
    tabular.write_table(order_cells(spark, sf, "nation", "yr", "status"), path)
    return tabular.read_table(spark, path, "nation int, yr int, status string, n double").select("nation", "yr", "status", "n")


@query("years_to_long", "S6 A6", f"WITH {cells_sql('nation', 'yr')} SELECT nation, CAST(y.i AS INTEGER) AS DeathYear, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT nation FROM cells) CROSS JOIN range(1995, 2002) y(i) LEFT JOIN cells c USING (nation) WHERE c.yr = y.i")
def years_to_long(spark, sf):
    w = grid.pivot_codes(order_cells(spark, sf, "nation", "yr"), ["nation"], "yr", YEARS, "n", prefix="y")
    return wide.years_to_long(w, ["nation"], "n").filter("n > 0")


@query("annual_blocks_to_long", "S5 S7 P7", f"WITH {cells_sql('nation', 'yr', 'status', 'mon')} SELECT status, mon, yr AS DeathYear, sum(n) AS n FROM cells GROUP BY ALL")
def annual_blocks_to_long(spark, sf):
    cells = order_cells(spark, sf, "yr", "status", "mon")
    blocks = {(s,): grid.pivot_codes(cells.filter(F.col("status") == s), ["mon"], "yr", YEARS, "n", prefix="") for s in STATUSES}
    return wide.blocks_to_long(blocks, ["status"], "mon", "n").filter("n > 0").select("status", "mon", "DeathYear", "n")


@query("tagged_union", "S7 O4", "SELECT c_mktsegment AS sheet, c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS extra FROM customer")
def tagged_union(spark, sf):
    c = table(spark, sf, "customer")
    parts = {
        s: c.filter(F.col("c_mktsegment") == s).select("c_custkey", "c_name", *([F.col("c_acctbal").alias("extra")] if s == "BUILDING" else [])) for s in SEGMENTS
    }
    return wide.union_tagged(parts, "sheet", drop=["C name"]).select("sheet", "c_custkey", "extra")


@query("wide_or_long_ingest", "S8", f"WITH {cells_sql('nation', 'yr', 'status')} SELECT yr, CAST(list_position({STATUSES}, status) AS INTEGER) AS place, nation, sum(n) AS n FROM cells GROUP BY ALL")
def wide_or_long_ingest(spark, sf):
    cells = order_cells(spark, sf, "nation", "yr", "status")
    place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")).cast("int")
    long = cells.withColumn("place", place).select("yr", "nation", "place", "n")
    w = grid.pivot_codes(long.filter("yr <= 1998"), ["yr", "nation"], "place", [1, 2, 3], "n", prefix="P")
    a = wide.long_or_wide(w, ["yr", "nation"], r"^P\d$", "place", "n").filter("n > 0")
    b = wide.long_or_wide(long.filter("yr > 1998"), ["yr", "nation"], r"^P\d$", "place", "n")
    return a.unionByName(b)


@query("two_keys_in_column_names", "S8", f"WITH {cells_sql('nation', 'mon', 'status')} SELECT nation, CAST(list_position({STATUSES}, status) AS INTEGER) AS sex, mon AS age, sum(n) AS n FROM cells GROUP BY ALL")
def two_keys_in_column_names(spark, sf):
    place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    cells = order_cells(spark, sf, "nation", "mon", "status").withColumn("k", F.concat(F.lit("A"), place.cast("string"), F.lit("_"), F.col("mon").cast("string")))
    names = [f"A{s}_{m}" for s in (1, 2, 3) for m in range(1, 13)]
    w = grid.pivot_codes(cells, ["nation"], "k", names, "n", prefix="")
    return wide.two_key_columns(w, ["nation"], r"^A(\d)_(\d+)$", "sex", "age", "n").filter("n > 0")


def interval_rows(spark, sf):
    cells = order_cells(spark, sf, "region", "nation", "yr", "status", "mon")
    x = cells.groupBy("region", "nation", "yr", "status", F.when(F.col("mon") <= 6, 1).otherwise(2).alias("age_id")).agg(F.sum("n").alias("deaths_point"))
    code = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")).cast("int")
    return x.select(
        F.when(F.col("region") == "ASIA", "asia").otherwise("other").alias("storage_scope"), code.alias("sex_code"), "age_id", "nation", "yr", "deaths_point",
        (F.col("deaths_point") * 0.9).alias("deaths_lower"), (F.col("deaths_point") * 1.1).alias("deaths_upper"), (F.col("nation") + 10).cast("double").alias("population"),
    )


_IV = f"""{cells_sql('region', 'nation', 'yr', 'status', 'mon')}, iv AS (SELECT CASE WHEN region = 'ASIA' THEN 'asia' ELSE 'other' END AS storage_scope, CAST(list_position({STATUSES}, status) AS INTEGER) AS sex_code,
  CASE WHEN mon <= 6 THEN 1 ELSE 2 END AS age_id, nation, yr, sum(n) AS p FROM cells GROUP BY ALL)"""


@query(
    "interval_store_slice", "S9 Q3",
    f"WITH {_IV} SELECT nation, yr, sex_code, round(1e5 * p / (nation + 10), 4) AS point, round(1e5 * p * 0.9 / (nation + 10), 4) AS lower, round(1e5 * p * 1.1 / (nation + 10), 4) AS upper FROM iv WHERE storage_scope = 'asia' AND age_id = 1 AND sex_code IN (1, 2)",
)
def interval_store_slice(spark, sf):
    path = f"{scratch(spark)}/intervals"
    stores.write_intervals(interval_rows(spark, sf), path)
    store = spark.read.parquet(path)
    out = views.interval_slice(store, {"storage_scope": ["asia"], "sex_code": [1, 2], "age_id": [1]}, "crude_rate", ["nation", "yr", "sex_code"])
    return rounded(out, 4)


@query(
    "domain_store_manifest", "S10 S12",
    """SELECT c_mktsegment AS domain, count(*) AS "rows", TRUE AS has_files, TRUE AS has_bytes FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
)
def domain_store_manifest(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("domain"))
    m = stores.write_domains(o.join(c, o.o_custkey == c.c_custkey), f"{scratch(spark)}/comparison")
    return m.select("domain", "rows", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


@query(
    "domain_store_slice", "S10 Q14",
    """SELECT o_custkey, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL""",
)
def domain_store_slice(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("domain"))
    path = f"{scratch(spark)}/comparison"
    stores.write_domains(o.join(c, o.o_custkey == c.c_custkey), path)
    return spark.read.parquet(path).filter("domain = 'BUILDING'").groupBy("o_custkey").agg(F.count("*").alias("orders"))


@query(
    "draw_store_completeness", "S11 S12 O6",
    """WITH d AS (SELECT DISTINCT CAST(floor(o_totalprice / 50) AS BIGINT) AS draw_id FROM orders) SELECT i AS draw_id, 'missing' AS status FROM range(1, 10001) t(i) WHERE i NOT IN (SELECT draw_id FROM d)
    UNION ALL SELECT draw_id, 'unexpected' FROM d WHERE draw_id NOT BETWEEN 1 AND 10000""",
)
def draw_store_completeness(spark, sf):
    path = f"{scratch(spark)}/draws"
    o = table(spark, sf, "orders").select(F.floor(F.col("o_totalprice") / 50).cast("int").alias("draw_id"), "o_orderkey")
    stores.write_draw_block(o, path, 0)
    return stores.draw_id_differences(spark.read.parquet(path), 10_000)


@query("pending_draw_blocks", "S11 D15", """WITH o AS (SELECT DISTINCT CAST(floor(o_totalprice / 50) AS BIGINT) AS i FROM orders), w AS (SELECT CAST(i AS BIGINT) AS i, CAST(floor((i - 1) / 7) AS INTEGER) AS b FROM range(1, 10001) t(i)) SELECT DISTINCT b AS draw_block FROM w WHERE i NOT IN (SELECT i FROM o)""")
def pending_draw_blocks(spark, sf):
    path = f"{scratch(spark)}/draws"
    ids = table(spark, sf, "orders").select(F.floor(F.col("o_totalprice") / 50).alias("draw_id")).distinct()
    ids.select("draw_id", F.floor((F.col("draw_id") - 1) / 7).cast("int").alias("draw_block")).write.parquet(path)
    return stores.pending_blocks(spark, path, 10_000, 7)


@query("csv_stack_with_file_names", "S14", "SELECT CAST(l_returnflag AS VARCHAR) AS flag, count(*) AS \"rows\", sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def csv_stack_with_file_names(spark, sf):
    path = f"{scratch(spark)}/stack"
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("qty"))
    l.write.option("header", True).csv(path)
    x = stores.read_csv_stack(spark, path, "flag string, qty double")
    return x.filter(F.col("file_name").endswith(".csv")).groupBy("flag").agg(F.count("*").alias("rows"), F.sum("qty").alias("qty"))


@query(
    "input_readiness", "S13 V1",
    f"""WITH n AS (SELECT count(*) AS line_rows FROM lineitem) SELECT v.*, n.line_rows FROM {values([('lines', True, ''), ('orders', False, "no column for 'missing_column'"), ('absent', False, 'not readable'), ('optional', True, 'absent (optional)')], 'key', 'ready', 'issue')}, n""",
)
def input_readiness(spark, sf):
    wanted = [
        contract.Input("lines", f"{sf}/lineitem.parquet", (schema.Field("l_orderkey"), schema.Field("L_Quantity"))),
        contract.Input("orders", f"{sf}/orders.parquet", (schema.Field("missing_column"),)),
        contract.Input("absent", f"{sf}/no_such_table.parquet"),
        contract.Input("optional", f"{sf}/no_such_table.parquet", required=False),
    ]
    n = table(spark, sf, "lineitem").agg(F.count("*").alias("line_rows"))
    return contract.readiness(spark, wanted).withColumn("line_rows", n.scalar())


@query(
    "trajectories_of_event_days", "W3 W4 J6 A2",
    f"""WITH c AS (SELECT event_type, CAST(day(ts) AS INTEGER) AS dy, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL), g AS (SELECT t.event_type, CAST(d.i AS INTEGER) AS dy, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT event_type FROM c) t CROSS JOIN range(1, 32) d(i) LEFT JOIN c ON c.event_type = t.event_type AND c.dy = d.i),
    w AS (SELECT * FROM {values([(i, j, w) for (i, j), w in sorted(compose.smoothing_weights(list(range(1, 32)), 7).items())], 'dy', 'src', 'w')})
    SELECT event_type, CAST(w.dy AS INTEGER) AS dy, round(CAST(sum(g.n * w.w) AS DOUBLE), 6) AS n FROM g JOIN w ON w.src = g.dy GROUP BY ALL""",
)
def trajectories_of_event_days(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", F.dayofmonth("ts").cast("int").alias("dy")).agg(F.count("*").cast("double").alias("n"))
    full = grid.complete_cells(e, ["event_type", "dy"], ["n"], {"dy": list(range(1, 32))})
    return rounded(compose.apply_weights(full, compose.smoothing_weights(list(range(1, 32)), 7), ["event_type"], "dy", "n"))


# the second version counts one more in some cells and lacks others
@query(
    "stored_table_differences", "V9 V10 V14 S3",
    f"""WITH {cells_sql('nation', 'yr', 'status')}, b AS (SELECT nation, yr, status, n + CASE WHEN nation % 7 = 3 AND yr = 1995 THEN 1 ELSE 0 END AS n FROM cells WHERE NOT (nation % 5 = 1 AND yr = 1998)),
      d AS (SELECT nation, yr, status, CAST(n AS DOUBLE) AS n, 1 AS s FROM cells UNION ALL SELECT nation, yr, status, CAST(n AS DOUBLE), -1 FROM b)
    SELECT nation, yr, status, n, CAST(sum(s) AS BIGINT) AS surplus FROM d GROUP BY ALL HAVING sum(s) <> 0""",
)
def stored_table_differences(spark, sf):
    keys = ["nation", "yr", "status"]
    cells = order_cells(spark, sf, *keys).select(*keys, "n")
    more = F.when((F.col("nation") % 7 == 3) & (F.col("yr") == 1995), 1.0).otherwise(0.0)
    other = cells.filter("NOT (nation % 5 = 1 AND yr = 1998)").withColumn("n", F.col("n") + more)
    left, right = scratch(spark), scratch(spark)
    checked.write_checked(cells, left, keys, 16)
    checked.write_checked(other, right, keys, 16)
    return checked.stored_differences(spark, left, right)


@query(
    "intervals_joined_in_place", "Q5 S9 J1",
    f"""WITH {cells_sql('nation', 'yr', 'status')}, i AS (SELECT nation, yr, status, n * 0.9 AS lower, n * 1.1 AS upper FROM cells WHERE n > 5)
    SELECT nation, yr, status, n, CASE WHEN i.lower IS NULL AND status = 'P' AND n = 0 THEN 0 ELSE round(i.lower, 4) END AS lower, round(i.upper, 4) AS upper, CASE WHEN i.lower IS NOT NULL THEN 20 END AS n_draws
    FROM cells LEFT JOIN i USING (nation, yr, status)""",
)
def intervals_joined_in_place(spark, sf):
    keys = ["nation", "yr", "status"]
    cells = order_cells(spark, sf, *keys).select(*keys, "n")
    limits = cells.filter("n > 5").select(*keys, (F.col("n") * 0.9).alias("lower"), (F.col("n") * 1.1).alias("upper"), F.lit(20).alias("n_draws"))
    points = checked.write_joinable(cells, scratch(spark), keys, 8)
    out = views.attach_intervals(points, checked.write_joinable(limits, scratch(spark), keys, 8), keys, F.col("status") == "P", "n")
    return rounded(out.select(*keys, "n", "lower", "upper", "n_draws"), 4)
