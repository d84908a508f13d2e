"""Histogram binning of feature values before the split search.

Cut points per feature are exact quantiles of the training values, from running counts over the
distributed (feature, value, count) histogram; ``percentile_approx`` only on request.  A value is replaced by
its bin's upper edge, the smallest cut point at or above it, so ``x <= cut`` and
``bin(x) <= cut`` agree and the fitted thresholds (the cut points) apply to raw values.
Values above the last cut fall into an open last bin that is never a threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missaware.operators import splits


def fractions(n_bins: int) -> list[float]:
    return [i / n_bins for i in range(1, n_bins)]


def padded_size(n_bins: int) -> int:
    """Smallest power of two above the number of cut points (room for one +inf pad)."""
    size = 1
    while size <= n_bins - 1:
        size *= 2
    return size


def quantile_cuts(long_df: DataFrame, n_bins: int, exact: bool = True, accuracy: int | None = None, n_rows: int | None = None) -> DataFrame:
    """(``_f``, ``_cuts``): sorted distinct cut points per feature from the long form, padded with
    +inf to a power-of-two length.  Cut points are values of the table at ranks ``i / n_bins``.

    Exact at any size, unless ``exact`` is off: then a sketch gives them with a rank error of
    ``n / accuracy``, by default ``max(1000, 32 * n_bins)`` (small enough for very many features).
    ``n_rows``: rows of the table, where known; a feature has no more values, so few rows need no look
    for features with very many.
    """
    accuracy = accuracy if accuracy is not None else max(1000, 32 * n_bins)
    v = F.col("_v")
    size = padded_size(n_bins)
    cuts = F.array_sort(F.array_distinct("_cuts"))
    pad = F.array_repeat(F.lit(float("inf")), F.lit(size) - F.size(cuts))
    long_df = long_df.filter(v.isNotNull())
    if exact:
        hist = long_df.groupBy("_f", "_v").agg(F.count(F.lit(1)).alias("_cnt"))
        hot = n_rows is None or n_rows > splits.DEFAULT_MAX_WINDOW_BINS
        cum = splits.cumulative(hist.withColumns({"_wt": F.lit(0.0), "_mw": F.lit(0.0)}), [], 0, hot_groups=hot)
        # ranks reached at a value; the first value that reaches a rank is its cut point
        reached = F.least(F.lit(n_bins - 1), F.expr(f"(_nl * {n_bins}) div _tot_n"))
        first = cum.withColumn("_i", reached).filter("_i > 0").groupBy("_f", "_i").agg(F.min("_v").alias("_v"))
        found = first.groupBy("_f").agg(F.collect_list("_v").alias("_cuts"))
    else:
        found = long_df.groupBy("_f").agg(F.percentile_approx(v, fractions(n_bins), accuracy).alias("_cuts"))
    return found.select("_f", F.concat(cuts, pad).alias("_cuts"))


def bin_array(values, cuts: dict[int, list[float]], n_features: int, n_bins: int):
    """Bin upper edges of an array column: a binary search per element over one literal array of all
    padded cut points (features x bins, the size of the model)."""
    size = padded_size(n_bins)
    flat = [c for i in range(n_features) for c in cuts.get(i, [float("inf")] * size)]
    text = ",".join("Infinity" if c == float("inf") else repr(float(c)) for c in flat)
    table = F.split(F.lit(text), ",").cast("array<double>")
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())]) if size > 1 else F.array().cast("array<int>")

    def edge(x, i):
        past = F.aggregate(steps, F.lit(0), lambda pos, step: F.when(F.get(table, i * size + pos + step - 1) < x, pos + step).otherwise(pos))
        return F.when(x.isNotNull(), F.get(table, i * size + past))

    return F.transform(values.cast("array<double>"), edge)


def bin_column(value, cuts: list[float]):
    """Bin upper edge of a column from literal cut points: a ``CASE`` ladder (one compare
    per cut, inside generated code); +inf above the last cut, null stays null."""
    real = sorted({c for c in cuts if c != float("inf")})
    if not real:
        return F.when(value.isNull(), F.lit(None).cast("double")).otherwise(F.lit(float("inf")))
    out = F.when(value.isNull(), F.lit(None).cast("double"))
    for c in real:
        out = out.when(value <= F.lit(c), F.lit(c))
    return out.otherwise(F.lit(float("inf")))
