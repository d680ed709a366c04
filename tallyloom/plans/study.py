"""Code sets and expert rules of the mortality study, as configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.operators.compose import CompositionTree
from tallyloom.operators.redistribute import ExclusionRule, codes_of, parse_rules

# Injury causes in four broad groups; the reference cause is 139.
INJURY_TREE = CompositionTree(
    {
        "transport": [124, 125],
        "other_unintentional": [127, 128, 129, 130, 131, 132, 135, 136, 137, 138, 139],
        "self_harm": [140],
        "violence": [141],
    },
    139,
)
INJURY_CODES = INJURY_TREE.codes
RAW_INJURY_CODES = list(codes_of("124:142 151 158:160 165 196:201 214"))
NATURAL_CODES = list(codes_of("1:123 150:214"))
ALL_CODES = list(range(1, 215))

# Redistribution in order, as rule | source codes | target codes | condition.
MOVE_RULES = parse_rules(
    """
r01 | 176 178 210 211 | 1 |
r02 | 152 | 3 |
r03 | 153 154 | 7 |
r04 | 193 209 212 | 8 |
r05 | 191 | 10 |
r06 | 175 | 11 |
r07 | 179 180 | 15 18 96 97 98 101 102 |
r08 | 149 | 20:23 | age5 = 1
r09 | 149 | 143 | age5 > 1
r10 | 192 | 24:27 |
r11 | 155 | 28 29 |
r12 | 156 | 30:35 |
r13 | 157 | 36 37 |
r14 | 162 | 57 |
r15 | 148 | 58:68 |
r16 | 194 | 75 |
r17 | 207 | 82 |
r18 | 195 | 86 |
r19 | 167 168 | 87 |
r20 | 169 | 89 90 |
r21 | 206 | 91:95 |
r22 | 184 | 31 32 96 |
r23 | 174 182 183 | 100 |
r24 | 170 181 | 103 |
r25 | 186 187 188 | 104 |
r26 | 208 | 83 86 88 89 |
r27 | 145 | 28:55 |
r28 | 147 | 82 83 86 88 104 |
r29 | 146 204 | 81:85 87 90 |
r30 | 173 205 | 81:85 87 114 | age5 < 6
r31 | 173 205 | 81:85 87 | age5 >= 6
r32 | 143 144 163 164 166 171 172 177 185 189 190 202 203 | 1:123 161 213 | age5 = 1
r33 | 143 144 163 164 166 171 172 177 185 189 190 202 203 | 1:19 24:123 161 213 | age5 > 1
"""
)
NATURAL_TARGETS = list(codes_of("1:123 161 213"))

# Causes that cannot occur, as codes | condition | reason.
_EXCLUSIONS = """
14:19 | Sex = 1 OR age5 < 5 OR age5 >= 14 | maternal age/sex exclusion
20:23 | age5 > 1 | perinatal age exclusion
28:54 | age5 = 1 | neonatal cancer exclusion
81:90 | age5 = 1 | neonatal circulatory exclusion
13 55 72 73 82 92 94 97 101 109 110 140 | age5 = 1 | additional neonatal exclusion
33 45 46 50 51 61 62 91 | age5 < 5 | under-10 exclusion
45 | Sex = 2 | female testis-cancer exclusion
40 70 | age5 < 6 | under-15 exclusion
30 31 32 35 44 | age5 < 8 | under-25 exclusion
44 | Sex = 2 | female prostate-cancer exclusion
28 37 38 39 41 42 43 52 | age5 < 7 | under-20 exclusion
41 42 43 | Sex = 1 | male female-cancer exclusion
53 | age5 < 3 | under-1 leukemia exclusion
58:68 | age5 < 4 | under-5 mental-disorder exclusion
108 | age5 < 4 | under-5 rheumatoid-arthritis exclusion
92 | age5 > 1 AND age5 < 6 | pneumoconiosis age exclusion
105 | Sex = 2 OR age5 < 9 | BPH age/sex exclusion
113 115 117 | age5 >= 9 | congenital age exclusion
112 | age5 >= 15 | neural-tube-defect age exclusion
73 74 76 77 78 | true | not retained as an underlying cause of death
"""
EXCLUSIONS = [
    ExclusionRule(codes_of(c), cond, reason) for c, cond, reason in ([p.strip() for p in line.split("|")] for line in _EXCLUSIONS.strip().splitlines())
]

# Modelled cause groups and where what remains of them goes.
HIV_GROUPS = {
    215: codes_of("1 176 178 210 211"), 216: codes_of("3 152"), 217: codes_of("4"), 218: codes_of("5"), 219: codes_of("8 193 209 212"),
    220: codes_of("161"), 221: codes_of("10 191"), 222: codes_of("11 175"), 223: codes_of("172"), 224: codes_of("26"), 225: codes_of("27"),
    226: codes_of("57 162"), 227: codes_of("94"), 228: codes_of("95"), 229: codes_of("103 170 181"), 230: codes_of("75"),
    231: codes_of("143 144 163 164 166 171 177 183 185 189 190 202 203"), 234: codes_of("24"),
}
HIV_DESTINATION = {
    215: 1, 216: 3, 217: 4, 218: 5, 219: 8, 220: 161, 221: 10, 222: 11, 223: 172, 224: 26, 225: 27, 226: 57, 227: 94, 228: 95, 229: 103,
    230: 75, 231: 143, 234: 24,
}
HIV_DIRECT = [0, 2]
HIV_CODE = 2
HIV_UNMODELLED = [234]

# How much of the background trend applies at each age band.
HIV_AGE_WEIGHT = {2: 0.0, 3: 0.25, 4: 0.5, 5: 0.75, 6: 1.0, 7: 1.0, 8: 1.0, 9: 1.0, 10: 1.0, 11: 1.0, 12: 0.75, 13: 0.5, 14: 0.25}


def hiv_age_weight(age: str = "age5") -> Column:
    out = F.lit(0.0)
    for band, w in HIV_AGE_WEIGHT.items():
        out = F.when(F.col(age) == band, w).otherwise(out)
    return out


@dataclass
class Study:
    """Dimensions and settings of one run."""

    provinces: list[int] = field(default_factory=lambda: list(range(1, 10)))
    groups: list[int] = field(default_factory=lambda: [1, 2, 3, 4])
    ages: list[int] = field(default_factory=lambda: list(range(1, 21)))
    years: tuple[int, int] = (1997, 2019)
    anchors: list[int] = field(default_factory=lambda: [2000, 2009, 2017])
    envelope_anchors: list[int] = field(default_factory=lambda: [2009, 2017])
    reference_years: tuple[int, ...] = (1999, 2000)
    early_max: int = 1998
    freeze_year: int = 2011
    register_start: int = 2017
    register_calibration: tuple[int, ...] = (2015, 2016)
    smoothing_window: int = 5
    national: int = 10
    # one year of one ill-defined age group is rebuilt from two anchors: (year, {anchor: weight})
    interpolated: tuple[int, dict[int, float]] | None = (2004, {2003: 2 / 3, 2006: 1 / 3})

    @property
    def year_list(self) -> list[int]:
        return list(range(self.years[0], self.years[1] + 1))


KEY = ["Death_Prov", "Sex", "DeathYear", "nbdcode", "age5", "Popgroup"]
CELL = ["Death_Prov", "Sex", "DeathYear", "age5", "Popgroup"]
STRATA = ["Death_Prov", "Sex", "Popgroup", "age5"]
FALLBACK_LEVELS = {
    "province_sex_year_age": ["Death_Prov", "Sex", "DeathYear", "age5"],
    "national_sex_year_age": ["Sex", "DeathYear", "age5"],
    "province_sex_age": ["Death_Prov", "Sex", "age5"],
    "national_sex_age": ["Sex", "age5"],
}
DONOR_LEVELS = {
    "province_sex_age": ["Death_Prov", "Sex", "age5"], "national_sex_age": ["Sex", "age5"], "national_age": ["age5"], "national": [],
}
