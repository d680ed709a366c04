"""Numeric and text column expressions shared by the operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The representable exponent range of a double.
LOG_MIN = math.log(2.2250738585072014e-308)
LOG_MAX = math.log(1.7976931348623157e308)

# Standard normal quantiles at 2.5 % and 97.5 %.
Z_LOWER = -1.959963984540054
Z_UPPER = 1.959963984540054


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add_all(columns) -> Column:
    """Sum of several columns; an empty list is zero."""
    return reduce(lambda a, b: a + b, [col(c) for c in columns], F.lit(0.0))


def finite(c: str | Column) -> Column:
    """True for a present, ordinary number; never NULL."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def safe_ratio(num, den, default: float | None = 0.0, multiplier: float = 1.0) -> Column:
    """``num / den`` where the denominator is finite and non-zero, else ``default``.

    Pipeline steps use the zero default, report views pass ``None`` so that an
    undefined ratio stays NULL.
    """
    num, den = col(num).cast("double"), col(den).cast("double")
    value = F.try_divide(num * F.lit(float(multiplier)), den)
    usable = finite(num) & finite(den) & (den != 0)
    return F.when(usable, value).otherwise(F.lit(default).cast("double"))


def safe_exp(c) -> Column:
    """``exp`` with its argument held inside the range a double can represent."""
    return F.exp(F.least(F.greatest(col(c), F.lit(LOG_MIN)), F.lit(LOG_MAX)))


def logistic(c) -> Column:
    """Overflow-free ``1 / (1 + exp(-x))``."""
    x = col(c)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def log_ratio(num, den) -> Column:
    """``log(num) - log(den)``; both must be positive, otherwise the job fails."""
    num, den = col(num), col(den)
    return F.when((num > 0) & (den > 0), F.log(num) - F.log(den)).otherwise(
        F.raise_error(F.lit("log ratio needs finite positive inputs")).cast("double")
    )


def clamp_residue(c, tolerance: float = 1e-12) -> Column:
    """Rounding residue within ``tolerance`` of zero becomes exactly zero."""
    return F.when(F.abs(col(c)) <= tolerance, F.lit(0.0)).otherwise(col(c))


def number(c) -> Column:
    """Numeric coercion where an unreadable value becomes NULL."""
    return col(c).try_cast("double")


# Text tokens that mean "nothing recorded".
BLANK_TOKENS = ["", ".", "NA"]


def code_text(c) -> Column:
    """Upper-cased, trimmed code with blank tokens as NULL."""
    t = F.upper(F.trim(col(c).cast("string")))
    return F.when(~t.isin(BLANK_TOKENS), t)


def icd_category(c) -> Column:
    """Three-character classification category; blank becomes NULL."""
    t = F.substring(F.regexp_replace(F.upper(col(c).cast("string")), "[^A-Z0-9]", ""), 1, 3)
    return F.when(t != "", t)


def text_between(c, lo: str, hi: str) -> Column:
    """String range test with NULL counted as outside."""
    return F.coalesce(col(c).between(lo, hi), F.lit(False))


def top_missing(c) -> Column:
    """Missing compares above every number, as some source systems define it."""
    return F.coalesce(col(c).cast("double"), F.lit(float("inf")))


def plain_label(c) -> Column:
    """Matching key of a label: accents folded, lower case, single spaces."""
    t = F.translate(
        col(c),
        "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑáàâäãéèêëíìîïóòôöõúùûüçñ",
        "AAAAAEEEEIIIIOOOOOUUUUCNaaaaaeeeeiiiiooooouuuucn",
    )
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def slug(c) -> Column:
    return F.regexp_replace(plain_label(c), " ", "_")


def date_of(year, month, day) -> Column:
    """Calendar date from parts; an impossible date is NULL."""
    y, m, d = (number(p).try_cast("int") for p in (year, month, day))
    first = F.make_date(y, m, F.lit(1))
    # a day beyond the end of its month would land in the next one
    fits = m.between(1, 12) & y.between(1, 9999) & d.between(1, 31)
    return F.when(fits, F.when(d <= F.dayofmonth(F.last_day(first)), F.date_add(first, d - 1)))
