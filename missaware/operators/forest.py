"""Bagging without copies: a Poisson(1) count per (row, tree) used as a row weight."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missaware.functions.hashing import poisson_cdf, poisson_count, xxhash01


def bootstrap_counts(
    df: DataFrame,
    n_trees: int,
    u: Callable[[Column], Column] | None = None,
    key: list[str] | None = None,
    seed: int = 0,
    keep_zero: bool = False,
) -> DataFrame:
    """Rows x trees with ``_t`` and ``_count`` (rows with count 0 dropped unless asked).

    The uniform draw is ``u(tree_col)``, by default a hash of ``key``, the tree and ``seed``;
    the count is its inverse Poisson(1) CDF.
    """
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("_t"))
    draw = u(F.col("_t")) if u is not None else xxhash01(*[F.col(k) for k in key], F.col("_t"), F.lit(seed))
    # the draw is a column of its own, so it is worked out once and not per value of the table
    out = rows.withColumn("_draw", draw).withColumn("_count", poisson_count(F.col("_draw"), poisson_cdf())).drop("_draw")
    return out if keep_zero else out.filter(F.col("_count") > 0)
