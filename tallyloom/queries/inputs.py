"""Star-schema tables as the record and cell inputs the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
UNKNOWN_PRIORITY = "4-NOT SPECIFIED"
STATUSES = ["F", "O", "P"]
YEARS = list(range(1995, 2002))
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def year_of(c: str):
    return F.year(c).cast("int")


def orders_geo(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the place and segment of their customer."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", year_of("o_orderdate").alias("yr"), F.month("o_orderdate").cast("int").alias("mon"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
    )
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("regionkey"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("regionkey"), F.col("r_name").alias("region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, "nation").join(r, "regionkey")


ORDERS_GEO = """og AS (
  SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon,
         o_orderpriority AS priority, o_orderstatus AS status, o_totalprice AS price, n_nationkey AS nation,
         n_regionkey AS regionkey, r_name AS region, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def order_cells(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    """Order counts as doubles per key."""
    return orders_geo(spark, sf).groupBy(*keys).agg(F.count("*").cast("double").alias("n"))


def cells_sql(*keys: str, name: str = "cells") -> str:
    k = ", ".join(keys)
    return f"{ORDERS_GEO}, {name} AS (SELECT {k}, CAST(count(*) AS DOUBLE) AS n FROM og GROUP BY {k})"


def lines_part(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the attributes of their part."""
    l = table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("linestatus"), year_of("l_shipdate").alias("yr"), F.month("l_shipdate").cast("int").alias("mon"),
    )
    p = table(spark, sf, "part").select(
        "p_partkey", F.col("p_type").alias("ptype"), F.col("p_brand").alias("brand"), F.col("p_size").alias("psize")
    )
    return l.join(p, l.l_partkey == p.p_partkey)


LINES_PART = """lp AS (
  SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity AS qty, l_returnflag AS flag, l_linestatus AS linestatus,
         CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(month(l_shipdate) AS INTEGER) AS mon,
         p_type AS ptype, p_brand AS brand, p_size AS psize
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def lines_supplier(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the nation of their supplier."""
    l = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("linestatus"), year_of("l_shipdate").alias("yr"),
    )
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return l.join(s, l.l_suppkey == s.s_suppkey)


LINES_SUPPLIER = """ls AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity AS qty, l_returnflag AS flag, l_linestatus AS linestatus,
         CAST(year(l_shipdate) AS INTEGER) AS yr, s_nationkey AS nation
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def values(rows, *names: str) -> str:
    """A VALUES relation for SQL text."""
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else ("NULL" if v is None else str(v))

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(names)})"


def in_list(vals) -> str:
    return "(" + ", ".join("'" + v + "'" if isinstance(v, str) else str(v) for v in vals) + ")"
