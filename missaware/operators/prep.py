"""Table preparation for missing data: masks, imputation, injection, splits, assembly.

All of it is one ``select`` per step over every feature at once (never a ``withColumn``
loop with one action per feature), so each step is a single narrow projection, or one
global aggregate for the means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missaware.functions.hashing import linear_hash01, xxhash01

MASK_PREFIX = "missing_"


def mask_name(feature: str, prefix: str = MASK_PREFIX) -> str:
    return f"{prefix}{feature}"


def discover_features(df: DataFrame, label: str, weight: str = "sample_weight", prefix: str = MASK_PREFIX, exclude: list[str] | None = None) -> list[str]:
    """Every column except the label, the weight, mask columns and ``exclude``."""
    skip = {label, weight, *(exclude or [])}
    return [c for c in df.columns if c not in skip and not c.startswith(prefix)]


def with_missing_mask(df: DataFrame, features: list[str], prefix: str = MASK_PREFIX) -> DataFrame:
    """Append ``missing_<f>`` = 1 when ``f`` is null else 0 (INT), for all features at once."""
    return df.select("*", *[F.col(f).isNull().cast("int").alias(mask_name(f, prefix)) for f in features])


def impute_constant(df: DataFrame, features: list[str], value: float = 0.0) -> DataFrame:
    fill = {f: F.coalesce(F.col(f).cast("double"), F.lit(float(value))) for f in features}
    return df.withColumns(fill)


def column_means(df: DataFrame, features: list[str]) -> dict[str, float | None]:
    """Means of all features in one aggregate job."""
    row = df.agg(*[F.avg(F.col(f)).alias(f) for f in features]).first()
    return {f: row[f] for f in features}


def impute_mean(df: DataFrame, features: list[str], means: dict[str, float | None] | None = None) -> DataFrame:
    """Replace nulls by the column mean (computed once for all features unless given)."""
    means = means if means is not None else column_means(df, features)
    fill = {
        f: F.coalesce(F.col(f).cast("double"), F.lit(means[f]).cast("double")) for f in features
    }
    return df.withColumns(fill)


def prepare(df: DataFrame, features: list[str], impute: str = "zero", prefix: str = MASK_PREFIX) -> DataFrame:
    """Mask first (from the raw nulls), then impute: the penalty needs the pre-imputation mask."""
    masked = with_missing_mask(df, features, prefix)
    if impute == "zero":
        return impute_constant(masked, features, 0.0)
    if impute == "mean":
        return impute_mean(masked, features)
    if impute == "none":
        return masked
    raise ValueError(f"impute must be 'zero', 'mean' or 'none', got {impute!r}")


def inject_missing(
    df: DataFrame,
    features: list[str],
    rates: dict[str, float],
    u: dict[str, Column] | None = None,
    key: list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """MCAR injection: set ``f`` to null where a per-row uniform ``u_f`` is below ``rates[f]``.

    ``u`` gives the uniform column per feature; by default it is a hash of ``key``, the
    feature name and ``seed``, so the result is a pure function of the row.
    """
    cols = {}
    for f in features:
        uf = u[f] if u is not None else xxhash01(*[F.col(k) for k in key], F.lit(f), F.lit(seed))
        cols[f] = F.when(uf < F.lit(float(rates[f])), F.lit(None).cast("double")).otherwise(F.col(f).cast("double"))
    return df.withColumns(cols)


def feature_rates(features: list[str], low: float, high: float, seed: int, modulus: int = 1_000_003) -> dict[str, float]:
    """Per-feature missing rate in [low, high) from a seeded integer rule (no RNG state)."""
    out = {}
    for i, f in enumerate(features):
        h = ((i + 1) * 48271 + seed * 69621) % modulus
        out[f] = low + (high - low) * h / modulus
    return out


def encode_label(df: DataFrame, column: str, positive, out: str | None = None) -> DataFrame:
    """Text label -> 1 for ``positive`` else 0."""
    return df.withColumn(out or column, F.when(F.col(column) == F.lit(positive), 1).otherwise(0))


def fraction_side(u: Column, test_fraction: float) -> Column:
    """'test' where the per-row uniform is below the fraction, else 'train'."""
    return F.when(u < F.lit(float(test_fraction)), F.lit("test")).otherwise(F.lit("train"))


def split_side(feature: str, threshold: float) -> Column:
    """'left' for ``f <= t``, 'right' for ``f > t``, null for a null value."""
    c = F.col(feature)
    return F.when(c <= F.lit(threshold), F.lit("left")).when(c > F.lit(threshold), F.lit("right"))


def exact_boundary(df: DataFrame, u: Column, n_test: int, key: list[str], accuracy: int = 1_000_000):
    """The ``n_test``-th smallest ``(u, key)`` tuple, found without a global sort.

    Approximate quantiles bracket the boundary; one aggregate counts the rows below the
    bracket; only rows inside the bracket (about ``4 n / accuracy``) are ordered to pick
    the exact tuple.  Returns None when ``n_test`` is 0 and the largest tuple when it
    covers every row.  Keys must tell rows apart: a null key, or a key that repeats on the
    boundary, is refused.
    """
    if n_test <= 0:
        return None
    ranked = df.select(u.alias("_u"), *[F.col(k) for k in key])
    null_key = F.greatest(F.lit(False), *[F.col(k).isNull() for k in key])
    n, n_null = ranked.agg(F.count(F.lit(1)), F.count(F.when(null_key, 1))).first()
    if n_null:
        raise ValueError(f"{n_null} rows have a null in the split key {key}")
    tup = F.struct(F.col("_u"), *[F.col(k) for k in key])
    if n_test >= n:
        return ranked.agg(F.max(tup)).first()[0]
    p = n_test / n
    eps = 2.0 / accuracy
    lo_p, hi_p = max(p - eps, 0.0), min(p + eps, 1.0)
    while True:
        lo, hi = ranked.agg(F.percentile_approx("_u", [lo_p, hi_p], accuracy)).first()[0]
        c = ranked.agg(
            F.count(F.when(F.col("_u") < lo, 1)).alias("below"),
            F.count(F.when(F.col("_u") <= hi, 1)).alias("upto"),
        ).first()
        below, upto = int(c["below"]), int(c["upto"])
        if lo_p == 0.0:
            below, lo = 0, None
        if hi_p == 1.0:
            upto, hi = n, None
        if below < n_test <= upto:
            break
        lo_p, hi_p = max(lo_p - 4 * eps, 0.0) if below >= n_test else lo_p, min(hi_p + 4 * eps, 1.0) if upto < n_test else hi_p
        eps *= 4
    band = ranked
    if lo is not None:
        band = band.filter(F.col("_u") >= lo)
    if hi is not None:
        band = band.filter(F.col("_u") <= hi)
    # the boundary row and the one after it: equal tuples cannot be told apart
    edge = band.orderBy("_u", *key).limit(n_test - below + 1).orderBy(F.desc("_u"), *[F.desc(k) for k in key]).limit(2).collect()
    edge = edge[-1:] if n_test == n else edge
    if len(edge) == 2 and edge[0] == edge[1]:
        raise ValueError(f"the split key {key} repeats on the boundary")
    return edge[-1]


def split_exact_side(df: DataFrame, u: Column, n_test: int, key: list[str], accuracy: int = 1_000_000) -> DataFrame:
    """Append ``side`` = 'test' for exactly ``n_test`` rows (smallest ``(u, key)``), else 'train'."""
    b = exact_boundary(df, u, n_test, key, accuracy)
    if b is None:
        return df.withColumn("side", F.lit("train"))
    tup = F.struct(u.alias("_u"), *[F.col(k) for k in key])
    types = {f.name: f.dataType for f in df.schema.fields}
    bound = F.struct(
        F.lit(b[0]).cast("double").alias("_u"),
        *[F.lit(b[i + 1]).cast(types[k]).alias(k) for i, k in enumerate(key)],
    )
    tup = F.struct(u.cast("double").alias("_u"), *[F.col(k) for k in key])
    return df.withColumn("side", F.when(tup <= bound, F.lit("test")).otherwise(F.lit("train")))


def split_exact(df: DataFrame, u: Column, n_test: int, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Train / test with exactly ``n_test`` test rows; both sides are filters of ``df``."""
    sided = split_exact_side(df, u, n_test, key)
    return (
        sided.filter(F.col("side") == "train").drop("side"),
        sided.filter(F.col("side") == "test").drop("side"),
    )


def split_rows(df: DataFrame, feature: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows of a node going left (``f <= t``) and right (``f > t``); nulls go to neither."""
    c = F.col(feature)
    return df.filter(c <= F.lit(threshold)), df.filter(c > F.lit(threshold))


def assemble(df: DataFrame, features: list[str], out: str = "features", mask_out: str | None = "missing", prefix: str = MASK_PREFIX) -> DataFrame:
    """Pack feature columns (and their masks) into ``ARRAY<DOUBLE>`` / ``ARRAY<INT>``."""
    cols = [F.array(*[F.col(f).cast("double") for f in features]).alias(out)]
    if mask_out:
        present = set(df.columns)
        masks = [F.col(mask_name(f, prefix)).cast("int") if mask_name(f, prefix) in present else F.lit(0) for f in features]
        cols.append(F.array(*masks).alias(mask_out))
    return df.select("*", *cols)


def linear_u(terms: list[tuple[str, int]], modulus: int) -> Column:
    return linear_hash01([(F.col(c), k) for c, k in terms], modulus)
