"""Counter-based random numbers: a draw depends on its key, never on partitioning.

``rand()`` and ``randn()`` change with the physical plan, so a lost executor
would resample.  Every number here is a pure function of (seed, draw, component,
key, slot), recomputable anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.columns import col

SEED_MODULUS = 2147483647  # Fixed value
SEED_STRIDE = 10007  # Fixed value
#: Offsets of the seeded components; fixed values.
SEED_OFFSETS = {"completeness": 101, "injury_envelope": 173, "injury": 211, "hiv_model": 307, "redistribution": 401, "draw": 509}


def component_seed(base, draw, offset) -> Column:
    """Seed of one component of one draw, in 1 .. modulus-1 (never zero)."""
    raw = (
        F.lit(base).cast("bigint")
        + F.lit(SEED_STRIDE).cast("bigint") * col(draw).cast("bigint")
        + F.lit(offset).cast("bigint")
    ) % F.lit(SEED_MODULUS).cast("bigint")
    return F.greatest(raw, F.lit(1).cast("bigint"))


def seed_of(base: int, component: str) -> Column:
    """Seed of a component in rows that carry ``draw_id``."""
    return component_seed(base, "draw_id", SEED_OFFSETS[component])


def _joined(parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def uniform(*parts) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of an md5 of the parts."""
    return F.conv(F.substring(F.md5(_joined(parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts) -> Column:
    """Standard normal by Box-Muller from two independent uniforms of the same key."""
    u1 = uniform(*parts, "a") + F.lit(0.5 / 4294967296.0)
    u2 = uniform(*parts, "b")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
