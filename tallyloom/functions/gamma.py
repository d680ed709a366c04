"""Gamma variates as column expressions: acceptance sampling on hash-addressed uniforms.

Marsaglia and Tsang's method. Every attempt's numbers are hashes of (key, attempt), so a variate is
the same after a retry, in any partitioning and in any engine that has the hash. About one attempt in
twenty is rejected at worst; a variate for which none of ``ATTEMPTS`` is accepted fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.hashing import normal, uniform

ATTEMPTS = 16
#: Half a step of the hash uniforms, which keeps them above zero.
HALF_STEP = 0.5 / 4294967296.0
#: Smallest normal double.
TINY = 2.2250738585072014e-308


def log_gamma_draw(key: Column, shape: Column) -> Column:
    """Log of a Gamma(shape, 1) variate addressed by a text key, stable for small shapes.

    A shape below one uses Gamma(shape + 1) times U**(1/shape) on the log scale.
    """
    d = F.when(shape < 1, shape + 1.0).otherwise(shape) - F.lit(1.0 / 3.0)
    c = 1.0 / F.sqrt(9.0 * d)
    numbers = F.transform(
        F.sequence(F.lit(1), F.lit(ATTEMPTS)),
        lambda j: F.struct(normal(key, j).alias("x"), (uniform(key, j, "u") + F.lit(HALF_STEP)).alias("u")),
    )

    def attempt(s: Column) -> Column:
        x, v = s["x"], F.pow(1.0 + c * s["x"], F.lit(3.0))
        accepted = F.log(s["u"]) < 0.5 * x * x + d - d * v + d * F.log(v)
        return F.when((v > 0) & accepted, F.log(d * v))

    first = F.get(F.filter(F.transform(numbers, attempt), lambda y: y.isNotNull()), F.lit(0))
    g = F.coalesce(first, F.raise_error(F.lit("no Gamma variate was accepted")).cast("double"))
    boost = F.log(uniform(key, "boost") + F.lit(HALF_STEP)) / shape
    return F.when(shape < 1, g + boost).otherwise(g)


def gamma_mean_one(key: Column, shape: Column) -> Column:
    """Gamma(shape, rate=shape) variate; underflows become the smallest normal double."""
    return F.greatest(F.exp(log_gamma_draw(key, shape)) / shape, F.lit(TINY))
