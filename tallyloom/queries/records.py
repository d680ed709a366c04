"""Schema standardisation, record-level rules and code mapping."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyloom.functions.columns import code_text, icd_category, text_between
from tallyloom.operators import aggregate, rules, schema
from tallyloom.plans import certificates
from tallyloom.queries.inputs import LINES_PART, in_list, lines_part, orders_geo, table, values
from tallyloom.queries.registry import query, rounded
from tallyloom.session import small_table

_ALIAS = [
    schema.Field("orderKey", ("O_ORDER-KEY", "o_orderkey"), "bigint"), schema.Field("status", ("O.OrderStatus",), "string"),
    schema.Field("total", ("price", "o_totalprice"), "double"), schema.Field("month", ("mm",), "int", required=False),
]


@query("alias_projection", "P1 S4", "SELECT o_orderkey AS orderKey, o_orderstatus AS status, o_totalprice AS total, CAST(NULL AS INTEGER) AS month FROM orders")
def alias_projection(spark, sf):
    return schema.standardise(table(spark, sf, "orders"), _ALIAS)


@query(
    "standardised_text_and_numbers", "P2 P1",
    """SELECT doc_id, CASE WHEN upper(trim(lang)) IN ('', '.', 'NA') THEN NULL ELSE upper(trim(lang)) END AS lang, CASE WHEN upper(trim(source)) IN ('', '.', 'NA') THEN NULL ELSE upper(trim(source)) END AS source,
      TRY_CAST(split_part(text, ' ', 1) AS DOUBLE) AS leading_number, n_chars FROM documents""",
)
def standardised_text_and_numbers(spark, sf):
    d = table(spark, sf, "documents")
    first = F.split_part("text", F.lit(" "), F.lit(1))
    return d.select("doc_id", code_text("lang").alias("lang"), code_text("source").alias("source"), first.try_cast("double").alias("leading_number"), "n_chars")


@query(
    "standardised_population", "P3 P4 A27",
    """WITH x AS (SELECT c_nationkey AS nation, c_mktsegment AS grp, round(sum(CAST(c_acctbal AS DECIMAL(18, 2))), 2) AS s FROM customer GROUP BY ALL) SELECT nation, grp, CAST(greatest(s, 0) AS DOUBLE) AS pop FROM x""",
)
def standardised_population(spark, sf):
    from tallyloom.plans.population import standardise_population

    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("Death_Prov"), F.col("c_mktsegment").alias("grp"), F.col("c_acctbal").alias("balance"))
    out = standardise_population(c, ["Death_Prov", "grp"], "Pop", ("balance",))
    return rounded(out.select(F.col("Death_Prov").alias("nation"), "grp", F.col("Pop").alias("pop")), 2)


@query(
    "prepared_population", "P4 V1 V2 V3",
    """WITH x AS (SELECT n_regionkey + 1 AS province, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(2 + month(o_orderdate) % 19 AS INTEGER) AS age5, CAST(count(*) AS DOUBLE) AS pop
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) SELECT CAST(province AS INTEGER) AS province, yr, age5, pop FROM x WHERE yr BETWEEN 1996 AND 2000""",
)
def prepared_population(spark, sf):
    from tallyloom.plans.population import prepare_population

    o = orders_geo(spark, sf).select((F.col("regionkey") + 1).cast("int").alias("province"), "yr", (F.col("mon") % 19 + 2).cast("int").alias("age5"), F.lit(1.0).alias("pop"))
    return prepare_population(o, ["province", "yr", "age5"], "pop", "yr", (1996, 2000), "age5", list(range(2, 21)))


@query(
    "dates_from_parts", "P8 P17",
    """SELECT o_orderkey, CAST(TRY_CAST(format('{:04d}-{:02d}-{:02d}', year(o_orderdate), month(o_orderdate), day(o_orderdate) + 2) AS DATE) AS VARCHAR) AS shifted,
      abs(CAST(TRY_CAST(format('{:04d}-{:02d}-{:02d}', year(o_orderdate), month(o_orderdate), day(o_orderdate) + 2) AS DATE) - DATE '1998-06-15' AS INTEGER)) AS days FROM orders""",
)
def dates_from_parts(spark, sf):
    from tallyloom.functions.columns import date_of

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    o = o.withColumns({"y": F.year("o_orderdate"), "m": F.month("o_orderdate"), "d": F.dayofmonth("o_orderdate") + 2, "by": F.lit(1998), "bm": F.lit(6), "bd": F.lit(15)})
    return o.select("o_orderkey", date_of("y", "m", "d").cast("string").alias("shifted"), rules.days_between(("y", "m", "d"), ("by", "bm", "bd")).cast("int").alias("days"))


@query(
    "under_five_classes", "P9 P8",
    """WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END AS t, CAST(year(o_orderdate) - 1995 AS INTEGER) AS a, abs(CAST(CAST(o_orderdate AS DATE) - DATE '1995-06-15' AS INTEGER)) AS dd FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN t = 1 AND a BETWEEN 1 AND 4 THEN 5 WHEN t = 1 AND a = 0 AND dd BETWEEN 29 AND 364 THEN 4 WHEN t = 1 AND a = 0 AND dd BETWEEN 7 AND 28 THEN 3
      WHEN t = 1 AND a = 0 AND dd BETWEEN 0 AND 6 THEN 2 WHEN t = 2 THEN 1 ELSE 9 END AS INTEGER) AS age_u5 FROM x""",
)
def under_five_classes(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", 2.0).otherwise(1.0).alias("DeathType"), (F.year("o_orderdate") - 1995).cast("double").alias("AgeYear"),
        F.abs(F.datediff("o_orderdate", F.lit("1995-06-15"))).alias("agecalc"), F.lit("A00").alias("cause"), F.lit(9).alias("age_u5"),
    )
    return rules.apply_rules(o, certificates.UNDER_FIVE).select("o_orderkey", "age_u5")


@query(
    "text_categories", "P10 P11",
    """WITH x AS (SELECT p_partkey, nullif(substr(regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g'), 1, 3), '') AS k FROM part) SELECT p_partkey, k AS category, coalesce(k BETWEEN 'BLU' AND 'RED', FALSE) AS in_range FROM x""",
)
def text_categories(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", icd_category("p_name").alias("category"))
    return x.withColumn("in_range", text_between("category", "BLU", "RED"))


_KEY = "substr(regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g'), 1, 3)"


@query(
    "lookup_with_age_overrides", "P12 P10",
    f"""WITH l AS (SELECT {_KEY} AS k, min(p_size) AS c FROM part GROUP BY 1), x AS (SELECT p_partkey, {_KEY} AS k, p_size AS age, CASE WHEN p_size < 10 THEN 4 ELSE 9 END AS u5 FROM part)
    SELECT p_partkey, CAST(CASE WHEN x.k = 'RED' AND age >= 30 THEN 901 WHEN x.k IN ('RED', 'BLU') AND u5 = 4 THEN 900 ELSE l.c END AS INTEGER) AS code FROM x LEFT JOIN l ON l.k = x.k""",
)
def lookup_with_age_overrides(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    lookup = p.groupBy(icd_category("p_name").alias("category")).agg(F.min("p_size").alias("code"))
    x = p.withColumn("u5", F.when(F.col("p_size") < 10, 4).otherwise(9))
    over = [rules.CodeOverride(("RED", "BLU"), "_u5 = 4", 900), rules.CodeOverride(("RED",), "_age >= 30", 901)]
    return rules.map_codes(x, "p_name", lookup, "code", over, 143, "p_size", "u5").select("p_partkey", "code")


PART_RULES = [
    rules.Rule.of("ptype = 'PROMO' AND psize < 10", code="'SMALL'"),
    rules.Rule.of("ptype = 'ECONOMY' AND flag = 'R'", age="999"),
    rules.Rule.of("age = 999 AND linestatus = 'F'", code="'UNKNOWN'", sex="2"),
    rules.Rule.of("code = 'SMALL' AND mon <= 6", sex="1", age="psize + 100"),
    rules.Rule.of("sex = 1 AND brand = 'Brand#1'", code="'MEDIUM'"),
    rules.Rule.of("code = 'MEDIUM'", age="0"),
]


@query(
    "ordered_record_rules", "P13 P15 A2",
    f"""WITH {LINES_PART}, s0 AS (SELECT *, ptype AS code, psize AS age, 8 AS sex FROM lp),
    s1 AS (SELECT * REPLACE (CASE WHEN ptype = 'PROMO' AND psize < 10 THEN 'SMALL' ELSE code END AS code, CASE WHEN ptype = 'ECONOMY' AND flag = 'R' THEN 999 ELSE age END AS age) FROM s0),
    s2 AS (SELECT * REPLACE (CASE WHEN age = 999 AND linestatus = 'F' THEN 'UNKNOWN' ELSE code END AS code, CASE WHEN age = 999 AND linestatus = 'F' THEN 2 ELSE sex END AS sex) FROM s1),
    s3 AS (SELECT * REPLACE (CASE WHEN code = 'SMALL' AND mon <= 6 THEN 1 ELSE sex END AS sex, CASE WHEN code = 'SMALL' AND mon <= 6 THEN psize + 100 ELSE age END AS age) FROM s2),
    s4 AS (SELECT * REPLACE (CASE WHEN sex = 1 AND brand = 'Brand#1' THEN 'MEDIUM' ELSE code END AS code) FROM s3),
    s5 AS (SELECT * REPLACE (CASE WHEN code = 'MEDIUM' THEN 0 ELSE age END AS age) FROM s4)
    SELECT code, CAST(sex AS INTEGER) AS sex, CAST(age AS INTEGER) AS age, CAST(count(*) AS DOUBLE) AS num FROM s5 GROUP BY ALL""",
)
def ordered_record_rules(spark, sf):
    x = lines_part(spark, sf).withColumns({"code": F.col("ptype"), "age": F.col("psize"), "sex": F.lit(8)})
    out = rules.apply_rules(x, PART_RULES)
    return aggregate.tally(out.select("code", "sex", F.col("age").cast("int").alias("age")), ["code", "sex", "age"])


@query(
    "remap_with_range_residual", "P14",
    """WITH x AS (SELECT p_partkey, upper(substr(p_type, 1, 3)) AS c, p_size FROM part)
    SELECT p_partkey, CASE WHEN p_size >= 10 THEN CASE WHEN c = 'ECO' THEN 'E46' WHEN c IN ('PRO', 'LAR') THEN 'J18' WHEN c BETWEEN 'SMA' AND 'STA' THEN 'R99' ELSE c END ELSE c END AS uc_recode FROM x""",
)
def remap_with_range_residual(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", "p_size", F.upper(F.substring("p_type", 1, 3)).alias("cause"))
    x = x.withColumn("uc_recode", F.col("cause"))
    return rules.apply_rules(x, rules.remap("cause", {"E46": "ECO", "J18": "PRO LAR"}, "SMA-STA", "R99", "p_size >= 10")).select("p_partkey", "uc_recode")


@query(
    "multiple_field_priority", "P16 P17",
    """WITH x AS (SELECT p_partkey, upper(substr(p_type, 1, 3)) AS a, upper(substr(p_name, 1, 3)) AS b, upper(substr(split_part(p_name, ' ', 2), 1, 3)) AS c, upper(substr(p_brand, 7, 2)) AS d FROM part)
    SELECT p_partkey, coalesce(CASE WHEN d BETWEEN '10' AND '19' THEN d END, CASE WHEN c BETWEEN '10' AND '19' THEN c END, CASE WHEN b BETWEEN '10' AND '19' THEN b END, CASE WHEN a BETWEEN '10' AND '19' THEN a END,
      CASE WHEN d BETWEEN 'BOL' AND 'RIN' THEN d END, CASE WHEN c BETWEEN 'BOL' AND 'RIN' THEN c END, CASE WHEN b BETWEEN 'BOL' AND 'RIN' THEN b END, CASE WHEN a BETWEEN 'BOL' AND 'RIN' THEN a END) AS picked,
      CAST((a BETWEEN 'A00' AND 'Y99')::INT + (b BETWEEN 'A00' AND 'Y99')::INT + (c BETWEEN 'A00' AND 'Y99')::INT + (d BETWEEN 'A00' AND 'Y99')::INT AS INTEGER) AS valid FROM x""",
)
def multiple_field_priority(spark, sf):
    up = lambda c: F.upper(F.substring(c, 1, 3))
    x = table(spark, sf, "part").select(
        "p_partkey", up("p_type").alias("a"), up("p_name").alias("b"), up(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("c"), F.upper(F.substring("p_brand", 7, 2)).alias("d")
    )
    f = ["a", "b", "c", "d"]
    return x.select("p_partkey", rules.last_field_by_priority(f, ["10-19", "BOL-RIN"]).alias("picked"), rules.count_valid(f, "A00", "Y99").alias("valid"))


@query(
    "analysis_exclusions_and_unknowns", "P18",
    """WITH x AS (SELECT CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS t, CAST(s_nationkey * 5 AS INTEGER) AS prov, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 9 ELSE 5 END AS grp, CASE WHEN l_linenumber <= 2 THEN l_linenumber WHEN l_linenumber = 3 THEN NULL ELSE 9 END AS sex, l_quantity AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
    SELECT prov AS Death_Prov, CAST(CASE WHEN grp = 9 THEN 8 ELSE grp END AS INTEGER) AS Popgroup, CAST(CASE WHEN sex IS NULL OR sex > 2 THEN 8 ELSE sex END AS INTEGER) AS Sex, CAST(count(*) AS DOUBLE) AS num FROM x WHERE t = 1 AND prov < 97 AND grp <> 5 GROUP BY ALL""",
)
def analysis_exclusions_and_unknowns(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_linestatus", "l_returnflag", "l_linenumber")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    x = l.join(s, F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("DeathType"), (F.col("s_nationkey") * 5).cast("int").alias("Death_Prov"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 9).otherwise(5).alias("Popgroup"),
        F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber")).when(F.col("l_linenumber") > 3, 9).alias("Sex"),
        F.lit(2000).alias("DeathYear"), F.lit(1).alias("DeathMonth"), F.lit(1).alias("nbdcode"), F.lit(30.0).alias("age_"), F.lit(9).alias("age_u5"),
    )
    g = aggregate.tally(x, certificates.GROUP_KEY, "num")
    return aggregate.grouped_sum(certificates.analysis_groups(g), ["Death_Prov", "Popgroup", "Sex"], ["num"])


@query(
    "split_by_code_set", "P19 P20 P21",
    f"""WITH {LINES_PART} SELECT yr, CASE WHEN ptype IN ('PROMO', 'LARGE') THEN 'injury' ELSE 'natural' END AS envelope, CASE WHEN ptype = 'PROMO' THEN 'transport' WHEN ptype = 'LARGE' THEN 'violence' END AS broad, count(*) AS n FROM lp GROUP BY ALL""",
)
def split_by_code_set(spark, sf):
    from tallyloom.plans.population import envelope, split_codes

    x = lines_part(spark, sf).select("yr", "ptype")
    injury, natural = split_codes(x, "ptype", ["PROMO", "LARGE"])
    both = injury.unionByName(natural).withColumn("envelope", envelope("ptype", {"injury": ["PROMO", "LARGE"]}, "natural"))
    broad = F.when(F.col("ptype") == "PROMO", "transport").when(F.col("ptype") == "LARGE", "violence")
    return both.groupBy("yr", "envelope", broad.alias("broad")).agg(F.count("*").alias("n"))


# cause codes of the certificates below, each with a class that rules look at
CERTIFICATE_CODES = [
    ("A15", 1), ("A33", 22), ("B20", 13), ("C15", 30), ("C34", 37), ("C50", 40), ("C53", 41), ("C61", 44), ("E11", 79), ("F10", 65), ("G30", 69), ("G80", 149), ("I10", 82), ("I21", 83), ("I64", 86),
    ("J18", 11), ("J42", 91), ("K70", 100), ("N40", 105), ("O15", 14), ("P23", 20), ("P36", 21), ("P95", 23), ("Q35", 62), ("M05", 108), ("R99", 143), ("V89", 200), ("X99", 172), ("  ", None), ("N17", 73),
]
_CERTIFICATE_SQL = f"""base AS (SELECT *, year(l_shipdate) AS yr, l_shipdate::DATE - CAST(l_partkey % 400 AS INTEGER) AS born FROM lineitem),
    cert AS (SELECT CAST(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS DOUBLE) AS DeathType, CAST(yr AS DOUBLE) AS DeathYear, CAST(month(l_shipdate) AS DOUBLE) AS DeathMonth, CAST(l_suppkey % 9 + 1 AS DOUBLE) AS Death_Prov,
      CAST(CASE WHEN l_linenumber % 4 = 3 THEN 8 ELSE l_linenumber % 4 + 1 END AS INTEGER) AS sex0, CAST(l_linenumber % 4 + 1 AS DOUBLE) AS Popgroup, l_linenumber = 5 AS pregnant,
      CAST(CASE WHEN l_linenumber = 7 THEN 999 WHEN l_quantity <= 12 THEN 0 WHEN l_quantity = 13 THEN NULL ELSE (l_quantity - 13) * 2.5 END AS DOUBLE) AS AgeYear, abs(date_diff('day', born, l_shipdate::DATE)) AS days,
      nullif(trim({{pick('l_partkey')}}), '') AS cause, nullif(trim({{pick('l_orderkey')}}), '') AS a, nullif(trim({{pick('l_suppkey')}}), '') AS b FROM base)"""


def _pick_sql(key: str) -> str:
    return f"({[c for c, _ in CERTIFICATE_CODES]})[CAST(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 4)) AS BIGINT) % {len(CERTIFICATE_CODES)} + 1]"


def _certificate_rules_sql() -> str:
    """The ordered rules one after another, each a statement over all records; the other way round than the decision table."""
    from tallyloom.operators.rules import in_ranges

    plain = lambda text: re.sub(r"(\d)D\b", r"\1", text)
    known = [(c, n) for c, n in CERTIFICATE_CODES if n is not None]
    cardio = " ".join(f"WHEN {in_ranges(f, r)} THEN {f}" for r in certificates.CARDIOVASCULAR for f in ("b", "a"))
    valid = " + ".join(f"CAST(coalesce({f} BETWEEN 'A00' AND 'Y99', false) AS INTEGER)" for f in ("a", "b"))
    steps = [_CERTIFICATE_SQL.replace("{pick('l_partkey')}", _pick_sql("l_partkey")).replace("{pick('l_orderkey')}", _pick_sql("l_orderkey")).replace("{pick('l_suppkey')}", _pick_sql("l_suppkey"))]
    steps.append(f"""lookup AS (SELECT * FROM {values(known, 'category', 'code')}),
    r0 AS (SELECT CASE WHEN DeathType = 1 AND cause = 'P95' THEN 2.0 ELSE DeathType END AS DeathType, Death_Prov, CASE WHEN pregnant AND sex0 >= 8 AND DeathType = 1 THEN 2 ELSE sex0 END AS sex_clean,
      DeathYear, DeathMonth, Popgroup, AgeYear, CASE WHEN AgeYear = 188 THEN NULL ELSE days END AS agecalc, cause, cause AS uc_recode, AgeYear AS age_clean, 9 AS age_u5, {valid} AS nrcauses, CASE {cardio} END AS cardio, 0 AS nbd_initial FROM cert)""")

    def step(rules, at):
        for r in rules:
            changes = ", ".join(f"CASE WHEN {plain(r.condition)} THEN {plain(v)} ELSE {c} END AS {c}" for c, v in r.assign)
            steps.append(f"r{at + 1} AS (SELECT * REPLACE ({changes}) FROM r{at})")
            at += 1
        return at

    def classed(source, cause, age, u5):
        whens = " ".join(f"WHEN {cause} IN {in_list(o.categories)} AND ({o.condition.replace('_age', f'coalesce({age}, 1e300)').replace('_u5', u5)}) THEN {o.value}" for o in reversed(certificates.OVERRIDES))
        return f"(SELECT s.*, CASE {whens} WHEN {cause} IS NULL THEN {certificates.BLANK_CAUSE} ELSE l.code END AS class FROM {source} s LEFT JOIN lookup l ON l.category = {cause})"

    at = step(certificates.UNDER_FIVE, 0)
    steps.append(f"r{at + 1} AS (SELECT * EXCLUDE (class) REPLACE (class AS nbd_initial) FROM {classed(f'r{at}', 'cause', 'age_clean', 'age_u5')})")
    at = step(certificates.verification_rules() + certificates.closing_rules(), at + 1)
    final = classed(f"r{at}", "uc_recode", "age_clean", "age_u5")
    return f"""WITH {', '.join(steps)} SELECT DeathType, Death_Prov, sex_clean AS Sex, DeathYear, DeathMonth, CAST(class AS INTEGER) AS nbdcode, age_clean AS age_, age_u5, Popgroup, CAST(count(*) AS DOUBLE) AS num FROM {final} GROUP BY ALL"""


@query("verified_certificate_groups", "P13 P9 P12 P14 P15 P16 P17 A2 P2", _certificate_rules_sql())
def verified_certificate_groups(spark, sf):
    """Line items dressed as certificates go through the full verification and collapse."""
    codes = F.lit("".join(c.ljust(3) for c, _ in CERTIFICATE_CODES))
    pick = lambda c: F.substring(codes, F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 4), 16, 10).cast("int") % len(CERTIFICATE_CODES) * 3 + 1, F.lit(3))
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.to_date("l_shipdate").alias("died"), "l_returnflag", "l_quantity")
    l = l.withColumn("born", F.date_sub("died", (F.col("l_partkey") % 400).cast("int")))
    parts = {f"{who}{name}": fn(day) for who, day in (("Death", "died"), ("Birth", "born")) for name, fn in (("Year", F.year), ("Month", F.month), ("Day", F.dayofmonth))}
    x = l.select(
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("DeathType"), *[c.alias(name) for name, c in parts.items()],
        F.when(n == 7, 999).when(q <= 12, 0).when(q != 13, (q - 13) * 2.5).alias("AgeYear"), F.when(n % 4 == 3, 8).otherwise(n % 4 + 1).alias("gender"),
        F.when(n == 5, 1).otherwise(0).alias("Pregnancy"), (n % 4 + 1).alias("population_group"), (F.col("l_suppkey") % 9 + 1).alias("province"),
        pick("l_partkey").alias("ucause"), pick("l_orderkey").alias("CauseA"), pick("l_suppkey").alias("CauseB"),
    )
    lookup = small_table(spark, [(c, n) for c, n in CERTIFICATE_CODES if n is not None], "category string, code int")
    return certificates.verified_groups(x, lookup)
