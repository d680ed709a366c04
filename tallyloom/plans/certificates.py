"""Certificate verification: record-level rules and the collapse to lossless groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.ages import band_of_years
from tallyloom.operators.aggregate import tally
from tallyloom.operators.rules import (
    CodeOverride, Rule, apply_rules, borders_of, count_valid, days_between, elementary, in_numbers, in_ranges, last_field_by_priority, map_codes, remap,
)
from tallyloom.operators.schema import Field, standardise
from tallyloom.session import generated_apart, materialise

CERTIFICATE = [
    Field("DeathType", ("death_type",)), Field("DeathYear", ("yd", "year_of_death")), Field("DeathMonth", (), required=False),
    Field("DeathDay", (), required=False), Field("BirthYear", (), required=False), Field("BirthMonth", (), required=False),
    Field("BirthDay", (), required=False), Field("AgeYear", ("age_years",)), Field("Sex", ("gender",)),
    Field("Pregnancy", (), required=False), Field("Popgroup", ("population_group",)), Field("Death_Prov", ("province", "DeathProv")),
    Field("UnderlyingCause", ("underlying", "ucause"), "string"), Field("CauseA", (), "string", False), Field("CauseB", (), "string", False),
    Field("CauseC", (), "string", False), Field("CauseD", (), "string", False),
]

GROUP_KEY = ["DeathType", "Death_Prov", "Sex", "DeathYear", "DeathMonth", "nbdcode", "age_", "age_u5", "Popgroup"]
FIELDS = ["CauseA", "CauseB", "CauseC", "CauseD"]

# Class of a blank cause, and classes that depend on age.
BLANK_CAUSE = 143
OVERRIDES = [
    CodeOverride(("A33", "A34", "A35"), "_u5 = 4 OR _age >= 1", 5),
    CodeOverride(("P23",), "_u5 BETWEEN 3 AND 5 OR _age >= 1", 11),
    CodeOverride(("P23",), "_u5 = 2", 20),
    CodeOverride(("A33", "A34", "A35", "A50", "A54"), "_u5 BETWEEN 2 AND 3", 22),
    CodeOverride(("G80",), "_age < 20", 149),
    CodeOverride(("G80",), "_age >= 20", 194),
]

# Perinatal codes and what they mean after the first month.
PERINATAL = {
    "E46": "P05", "J18": "P22 P23 P28", "J98": "P24 P25", "Q24": "P29", "B24": "P35", "A41": "P36", "A19": "P37",
    "I64": "P52", "D64": "P61", "E15": "P70", "K52": "P77", "A09": "P78",
}
PERINATAL_RESIDUAL = "P00-P04 P06-P15 P20 P21 P26 P27 P38 P39 P50 P51 P53-P60 P71 P72 P74 P76 P80 P81 P83 P90-P96"

# Initial classes with a code and an age (below the limit) that cannot be right.
IMPLAUSIBLE_AGE = """
28 | C00-C08 | 21
30 | C15 | 25
31 | C16 | 25
32 | C18-C21 | 25
33 | C22 | 10
35 | C25 | 25
37 | C33 C34 | 20
38 | C43 | 20
39 | C44 | 20
40 | C50 | 15
41 | C53 | 20
42 | C54 C55 | 20
43 | C56 | 20
44 | C61 | 26
45 | C62 | 10
46 | C67 | 10
50 51 | C81-C85 C96 | 10
52 | C88-C90 | 21
53 | C91-C95 | 1
"""

# Classes that determine sex.
SEX_OF_CAUSE = """
41 | C53 | 2
42 | C54 C55 | 2
43 | C56 | 2
44 | C61 | 1
45 | C62 | 1
105 | N40 | 1
"""

# Recodes in order, as initial classes, codes, age in [from, below) or under-five class, new code.
RECODES = """
61 62 | | u5 2-3 | P04
61 62 | | u5 4 | R99
61 62 | | age 1 10 | R99
69 | G30 | age 0 20 | R99
70 | G20 G21 | age 0 15 | R99
86 | | u5 2-3 | P52
91 | J40-J44 | age 0 10 | J84
100 | K70 | age 0 20 | R99
105 | N40 | age 0 30 | R99
114-120 | | newborn |
| Q03 Q05 | age 60 999 | R99
| Q35-Q45 Q86 | age 30 999 | R99
172 | | age 0 6 | R99
108 | M05 M06 | age 0 5 | R99
111 | M30 M32 | age 0 15 | R99
58-68 | F01-F99 | age 0 5 | Q86
| I00-I99 | u5 2-3 | R99
13 55 72 73 82 92 94 97 100 109 140 148 175 | | u5 2-3 | P96
73 74 76 77 78 | | u5 4-9 | R99
92 | | child 1 15 | R99
148 | | child 1 5 | R99
"""

# More specific causes that replace diabetes, by priority.
DIABETES = "E10-E14"
CARDIOVASCULAR = ["I20-I25", "I60-I69", "I11", "I12"]

# Perinatal codes of older infants in the early years.
EARLY_INFANT = {"A19": "P37", "D64": "P61", "E15": "P70", "J98": "P24 P25"}

NEWBORN = {"age_clean": "0D", "age_u5": "2"}


def _rows(text: str) -> list[list[str]]:
    return [[p.strip() for p in line.split("|")] for line in text.strip().splitlines()]


def _recode_rule(groups: str, codes: str, when: str, new: str) -> Rule:
    tests = ["DeathType = 1"]
    if groups:
        tests.append(in_numbers("nbd_initial", groups))
    if codes:
        tests.append(in_ranges("uc_recode", codes))
    kind, *rest = when.split()
    if kind == "newborn":
        return Rule.of(" AND ".join([*tests, "AgeYear = 999"]), **NEWBORN)
    if kind == "u5":
        tests.append(in_numbers("age_u5", rest[0]))
    elif kind == "age":
        tests.append(f"age_clean >= {rest[0]} AND age_clean < {rest[1]}")
    else:
        tests.append(f"(age_u5 = 4 OR (age_clean >= {rest[0]} AND age_clean < {rest[1]}))")
    return Rule.of(" AND ".join(tests), uc_recode=f"'{new}'")


def verification_rules() -> list[Rule]:
    """All record rules after the first classification, in the order they act."""
    rules = [
        Rule.of(f"DeathType = 1 AND {in_numbers('nbd_initial', '14-19')} AND ((age_clean >= 0 AND age_clean < 10) OR age_clean >= 55)", uc_recode="'R99'"),
        Rule.of(f"DeathType = 1 AND {in_numbers('nbd_initial', '14-19')}", sex_clean="2"),
        Rule.of(f"DeathType = 1 AND AgeYear = 999 AND {in_numbers('nbd_initial', '20-23')}", **NEWBORN),
        Rule.of(f"DeathType = 1 AND age_clean > 0 AND age_clean < 999 AND {in_numbers('nbd_initial', '20-23')}", uc_recode="'R99'"),
        *remap("cause", PERINATAL, PERINATAL_RESIDUAL, "R99", "DeathType = 1 AND (age_u5 = 4 OR age_clean >= 1)"),
        Rule.of("age_clean = 0 AND age_u5 = 9", age_u5="2"),
    ]
    implausible = " OR ".join(
        f"({in_numbers('nbd_initial', g)} AND {in_ranges('uc_recode', c)} AND age_clean >= 0 AND age_clean < {limit})" for g, c, limit in _rows(IMPLAUSIBLE_AGE)
    )
    rules.append(Rule.of(f"DeathType = 1 AND ({implausible})", age_clean="999D"))
    for g, c, sex in _rows(SEX_OF_CAUSE):
        rules.append(Rule.of(f"DeathType = 1 AND {in_numbers('nbd_initial', g)} AND {in_ranges('uc_recode', c)}", sex_clean=sex))
    rules.append(Rule.of("AgeYear < 5 AND age_clean = 999", age_u5="9"))
    rules += [_recode_rule(*r) for r in _rows(RECODES)]
    return rules


def closing_rules() -> list[Rule]:
    early = " ".join(f"WHEN {in_ranges('cause', src)} THEN '{dst}'" for dst, src in EARLY_INFANT.items())
    listed = in_ranges("cause", " ".join(EARLY_INFANT.values()))
    return [
        Rule.of(f"DeathType = 1 AND {in_ranges('cause', DIABETES)} AND cardio IS NOT NULL", uc_recode="cardio"),
        Rule.of("DeathType = 1 AND cause = 'I10'", uc_recode="CASE WHEN nrcauses <= 1 THEN 'I10' ELSE 'R99' END"),
        Rule.of(f"DeathType = 1 AND DeathYear <= 2005 AND age_u5 = 4 AND {listed}", uc_recode=f"CASE {early} END"),
    ]


UNDER_FIVE = [
    Rule.of("DeathType = 2", age_u5="1"),
    Rule.of("DeathType = 1 AND AgeYear = 0 AND agecalc BETWEEN 0 AND 6", age_u5="2"),
    Rule.of("DeathType = 1 AND AgeYear = 999 AND age_u5 = 9 AND substring(cause, 1, 1) IN ('P', 'Q')", age_u5="2"),
    Rule.of("DeathType = 1 AND AgeYear = 0 AND agecalc BETWEEN 7 AND 28", age_u5="3"),
    Rule.of("DeathType = 1 AND AgeYear = 0 AND agecalc BETWEEN 29 AND 364", age_u5="4"),
    Rule.of("DeathType = 1 AND AgeYear BETWEEN 1 AND 4", age_u5="5"),
]


#: What the rules can see of a record; the rest of a record follows its decision.
INPUTS = ["DeathType", "cause", "AgeYear", "agecalc", "early", "nrcauses", "has_cardio"]
#: Stands for the record's own circulatory cause in a decision.
OWN_CARDIO = "@"
#: Ages at which some rule or override changes its mind, and the under-five classes in days.
AGE_BORDERS = borders_of([*UNDER_FIVE, *verification_rules(), *closing_rules(), *(o.condition for o in OVERRIDES)], "AgeYear", "age_clean", "_age")
DAY_BORDERS = borders_of(UNDER_FIVE, "agecalc")


def prepare(records: DataFrame) -> DataFrame:
    """Certificates with what the rules need, brought down to what can make a difference.

    Contributory causes matter with diabetes (the circulatory cause among them) and with I10 (whether there are
    several); days of age by their elementary interval, and only in infants.
    """
    x = generated_apart(standardise(generated_apart(records), CERTIFICATE))
    x = x.withColumn("sex_clean", F.col("Sex").cast("int"))
    x = apply_rules(
        x,
        [
            Rule.of("Pregnancy = 1 AND Sex >= 8 AND DeathType = 1", sex_clean="2"),
            Rule.of("DeathType = 1 AND UnderlyingCause = 'P95'", DeathType="2D"),
        ],
    )
    days = days_between(("DeathYear", "DeathMonth", "DeathDay"), ("BirthYear", "BirthMonth", "BirthDay"), F.col("AgeYear") == 188)
    x = generated_apart(x.withColumns({"days": days, **{f"{f}3": F.substring(f, 1, 3) for f in FIELDS}}))
    return x.select(
        "DeathType", "Death_Prov", "sex_clean", "DeathYear", "DeathMonth", "Popgroup", "AgeYear", F.col("UnderlyingCause").alias("cause"),
        F.when((F.col("DeathType") == 1) & (F.col("AgeYear") == 0), elementary("days", DAY_BORDERS)).alias("agecalc"),
        (F.col("DeathYear") <= 2005).alias("early"),
        F.when(F.col("UnderlyingCause") == "I10", F.least(count_valid(FIELDS, "A00", "Y99"), F.lit(2))).alias("nrcauses"),
        F.when(F.expr(in_ranges("UnderlyingCause", DIABETES)), last_field_by_priority([f"{f}3" for f in FIELDS], CARDIOVASCULAR)).alias("cardio"),
    )


def _inputs(x: DataFrame) -> dict:
    return {"AgeYear": elementary("AgeYear", AGE_BORDERS), "has_cardio": F.col("cardio").isNotNull()}


def decide(inputs: DataFrame, lookup: DataFrame) -> DataFrame:
    """The ordered rules on distinct inputs: ``uc_recode``, ``age_u5``, and ``new_age``, ``new_sex`` where a rule sets them."""
    x = inputs.withColumns(
        {
            "uc_recode": F.col("cause"), "age_clean": F.col("AgeYear"), "age_u5": F.lit(9), "sex_clean": F.lit(None).cast("int"),
            "cardio": F.when(F.col("has_cardio"), F.lit(OWN_CARDIO)), "DeathYear": F.when(F.col("early"), 2005).when(~F.col("early"), 2006),
        }
    )
    x = apply_rules(x, UNDER_FIVE)
    x = map_codes(x, "cause", lookup, "nbd_initial", OVERRIDES, BLANK_CAUSE, "age_clean", "age_u5")
    x = apply_rules(x, verification_rules() + closing_rules())
    new_age = F.when(~F.col("age_clean").eqNullSafe(F.col("AgeYear")), F.col("age_clean"))
    return x.select(*INPUTS, "uc_recode", "age_u5", new_age.alias("new_age"), F.col("sex_clean").alias("new_sex"))


def _decided(x: DataFrame, lookup: DataFrame) -> DataFrame:
    """``prepare``'s rows with their decisions: the rules see each distinct input once, however many rows have it."""
    keyed = x.withColumns({f"_{c}": _inputs(x).get(c, F.col(c) if c in x.columns else None) for c in INPUTS})
    distinct = keyed.select(*[F.col(f"_{c}").alias(c) for c in INPUTS]).distinct()
    table = materialise(decide(distinct, lookup), "decisions").withColumnsRenamed({c: f"=_{c}" for c in INPUTS})
    same = reduce(lambda a, b: a & b, [keyed[f"_{c}"].eqNullSafe(table[f"=_{c}"]) for c in INPUTS])
    out = keyed.join(table, same)
    return out.withColumns(
        {
            "uc_recode": F.when(F.col("uc_recode") == OWN_CARDIO, F.col("cardio")).otherwise(F.col("uc_recode")),
            "Sex": F.coalesce("new_sex", "sex_clean"), "age_": F.coalesce("new_age", "AgeYear"),
        }
    )


def verify(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """Records with the recoded cause ``uc_recode``, ``Sex``, ``age_`` and ``age_u5`` after all rules.

    The rules are a decision table over the distinct inputs, joined back to the records; the class of the recoded
    cause is assigned to the collapsed groups.
    """
    x = _decided(materialise(prepare(records), "prepared"), lookup)
    return x.select("DeathType", "Death_Prov", "Sex", "DeathYear", "DeathMonth", "Popgroup", "cause", "uc_recode", "age_", "age_u5", "AgeYear", "nrcauses", "agecalc")


def verified_groups(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """Certificates to counts on the largest key later steps need.

    Records are collapsed to their distinct rule inputs and group fields before any rule (the only record-level
    shuffle; nothing is lost, since records that agree there get one decision). Rules, the second classification
    and the final sums work on those counts.
    """
    fields = ["DeathType", "Death_Prov", "sex_clean", "DeathYear", "DeathMonth", "Popgroup", "AgeYear", "cause", "agecalc", "early", "nrcauses", "cardio"]
    cells = materialise(tally(prepare(records), fields, "num"), "certificate-cells")
    x = _decided(cells, lookup)
    coded = map_codes(x, "uc_recode", lookup, "nbdcode", OVERRIDES, BLANK_CAUSE, "age_", "age_u5")
    return coded.groupBy(*GROUP_KEY).agg(F.sum("num").alias("num"))


def analysis_groups(groups: DataFrame) -> DataFrame:
    """Exclusions and unknown codes of the analysis: live births, known provinces, four groups."""
    x = groups.filter((F.col("DeathType") == 1) & (F.col("Death_Prov") < 97) & (F.coalesce(F.col("Popgroup"), F.lit(9.0)) != 5))
    age5 = (
        F.when(F.col("age_") == 999, 999).when(F.col("age_u5") <= 3, 1).when(F.col("age_u5") == 4, 2).otherwise(band_of_years("age_"))
    )
    x = x.withColumns(
        {
            "Popgroup": F.when(F.col("Popgroup").isNull() | (F.col("Popgroup") == 9), 8).otherwise(F.col("Popgroup")).cast("int"),
            "Sex": F.when(F.col("Sex").isNull() | (F.col("Sex") > 2), 8).otherwise(F.col("Sex")).cast("int"),
            "age5": age5.cast("int"),
            "nbdcode": F.when(F.col("nbdcode") == 215, 0).otherwise(F.col("nbdcode")).cast("int"),
            **{c: F.col(c).cast("int") for c in ("Death_Prov", "DeathYear", "DeathMonth")},
        }
    )
    return x.filter(F.col("nbdcode").isNotNull())
