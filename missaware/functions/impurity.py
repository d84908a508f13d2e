"""Impurity and split-score column expressions.

Scores are "higher is better".  For Gini with class weights ``L_k`` / ``R_k`` on the two sides
(``WL``, ``WR`` their sums, ``W = WL + WR``) we use

    s = (sum_k L_k^2 / WL + sum_k R_k^2 / WR) / W - 1

which equals ``-(WL * gini(L) + WR * gini(R)) / W``.  Entropy uses base-2 logarithms with
``0 * log 0 = 0``.  The missingness penalty ``alpha * missing_weight / W`` is subtracted
separately (it is constant per node and feature).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CRITERIA = ("gini", "info_gain")

# Digits kept when ranking candidates: float noise below them must not decide ties.
RANK_DIGITS = {"gini": 12, "info_gain": 9}


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def gini_score(left: list[Column], right: list[Column], wl: Column, wr: Column) -> Column:
    """Weighted child Gini as a score (higher is better); callers guarantee wl > 0, wr > 0."""
    sq_l = _sum([c * c for c in left])
    sq_r = _sum([c * c for c in right])
    return (sq_l / wl + sq_r / wr) / (wl + wr) - F.lit(1.0)


def entropy(counts: list[Column], total: Column) -> Column:
    terms = [
        F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(F.lit(0.0)) for c in counts
    ]
    return _sum(terms)


def info_gain_score(left: list[Column], right: list[Column], wl: Column, wr: Column) -> Column:
    return -(wl * entropy(left, wl) + wr * entropy(right, wr)) / (wl + wr)


def split_score(criterion: str, left, right, wl, wr) -> Column:
    if criterion == "gini":
        return gini_score(left, right, wl, wr)
    if criterion == "info_gain":
        return info_gain_score(left, right, wl, wr)
    raise ValueError(f"criterion must be one of {CRITERIA}, got {criterion!r}")
