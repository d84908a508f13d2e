"""Deterministic per-row pseudo-random numbers as column expressions.

Randomness in this engine (missingness injection, splits, bootstrap counts) is a pure
function of the row key, so results do not depend on partitioning, task retries or the
order in which rows arrive.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_hash01(terms: list[tuple[Column, int]], modulus: int) -> Column:
    """u = ((sum c_i * k_i) mod m) / m for non-negative integer columns; portable to SQL."""
    acc = reduce(lambda a, b: a + b, [c.cast("bigint") * F.lit(k) for c, k in terms])
    return (acc % F.lit(modulus)) / F.lit(float(modulus))


def xxhash01(*cols: Column) -> Column:
    """u in [0, 1) from xxhash64 of the given columns (any types)."""
    h = F.xxhash64(*cols)
    # keep 53 bits so the quotient is exact in a double
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def poisson_cdf(mean: float = 1.0) -> list[float]:
    """CDF values P(X <= k), k = 0, 1, ..., of Poisson(mean), up to where a double no longer grows
    (or 1 is reached).  A count is the number of these values not above u."""
    out, term, acc = [], math.exp(-mean), 0.0
    k = 0
    while acc + term > acc and acc < 1.0:
        acc += term
        out.append(acc)
        k += 1
        term = term * mean / k
    return out


def poisson_count(u: Column, cdf: list[float]) -> Column:
    """Number of CDF values <= u: an inverse-CDF Poisson draw from a uniform column."""
    return reduce(lambda a, b: a + b, [F.when(u >= F.lit(c), 1).otherwise(0) for c in cdf])
