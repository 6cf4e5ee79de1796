"""Column expressions for densities, deterministic draws and smooth functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_pdf(z: Column) -> Column:
    """Standard normal density."""
    return F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, within 7.5e-8."""
    t = 1.0 / (1.0 + ERF_P * F.abs(z) / math.sqrt(2))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    tail = 0.5 * poly * F.exp(-z * z / 2.0)
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def _digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"/{seed}")))


def _share(digits: Column) -> Column:
    """13 hexadecimal digits as a number in [0, 1)."""
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def hash_uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on key and seed alone, not on partitioning. Null for a null key."""
    return _share(F.substring(_digest(key, seed), 1, 13))


def hash_normal(key: Column, seed: int = 0) -> Column:
    """A standard normal draw from two uniform draws of key and seed (Box-Muller)."""
    digest = _digest(key, seed)
    u, v = _share(F.substring(digest, 1, 13)), _share(F.substring(digest, 14, 13))
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2 * math.pi * v)


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
