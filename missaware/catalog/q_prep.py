"""Queries: table preparation (masks, imputation, injection, validation, splits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from missaware.catalog import fixtures as fx
from missaware.catalog.registry import query
from missaware.catalog.sqlsplit import lit
from missaware.operators import prep, splits, stats
from missaware.session import table

A_KEYS = ", ".join(fx.FX_A_KEYS)
RAW_A = f"WITH raw AS ({fx.FX_A_SQL})"
MASKS_A = ", ".join(f"CAST({f} IS NULL AS INTEGER) AS missing_{f}" for f in fx.FX_A_FEATURES)


@query("missing_mask", oracle=f"{RAW_A} SELECT {A_KEYS}, {', '.join(fx.FX_A_FEATURES)}, {MASKS_A}, label FROM raw")
def missing_mask(spark, sf_dir):
    return prep.with_missing_mask(fx.fx_a(spark, sf_dir), fx.FX_A_FEATURES)


@query("impute_zero", oracle=fx.FX_A_PREP_SQL)
def impute_zero(spark, sf_dir):
    return fx.fx_a_prepared(spark, sf_dir)


_B_MEAN_SQL = (
    f"WITH raw AS ({fx.FX_B_SQL}) SELECT o_orderkey, "
    + ", ".join(f"round(COALESCE({f}, (SELECT avg({f}) FROM raw)), 6) AS {f}" for f in fx.FX_B_FEATURES)
    + ", "
    + ", ".join(f"CAST({f} IS NULL AS INTEGER) AS missing_{f}" for f in fx.FX_B_FEATURES)
    + ", label FROM raw"
)


@query("impute_mean", oracle=_B_MEAN_SQL)
def impute_mean(spark, sf_dir):
    """Mask, then mean imputation with all means from one aggregate."""
    df = prep.prepare(fx.fx_b(spark, sf_dir), fx.FX_B_FEATURES, impute="mean")
    return df.withColumns({f: F.round(F.col(f), 6) for f in fx.FX_B_FEATURES})


@query(
    "encode_label",
    oracle="SELECT event_id, CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS label FROM events",
)
def encode_label(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    return prep.encode_label(ev, "event_type", "purchase", out="label").select("event_id", "label")


# fixed values: MCAR injection on orders (features, per-feature multipliers, seed, rate range)
INJECT_FEATURES = ["o_totalprice", "o_custkey"]
INJECT_MULTS = [(48271, 16807), (69621, 40692)]
INJECT_SEED = 7
INJECT_MODULUS = 1_000_003
INJECT_RATES = prep.feature_rates(INJECT_FEATURES, 0.05, 0.4, INJECT_SEED)


def _inject_u(i: int):
    a, b = INJECT_MULTS[i]
    return prep.linear_u([("o_orderkey", a), ("o_custkey", b)], INJECT_MODULUS)


def _inject_u_sql(i: int) -> str:
    a, b = INJECT_MULTS[i]
    return f"((o_orderkey*{a} + o_custkey*{b}) % {INJECT_MODULUS}) / {float(INJECT_MODULUS)!r}"


_INJECT_SQL = (
    "SELECT o_orderkey, "
    + ", ".join(
        f"CASE WHEN {_inject_u_sql(i)} < {lit(INJECT_RATES[f])} THEN NULL ELSE CAST({f} AS DOUBLE) END AS {f}"
        for i, f in enumerate(INJECT_FEATURES)
    )
    + ", "
    + ", ".join(
        f"CAST({_inject_u_sql(i)} < {lit(INJECT_RATES[f])} AS INTEGER) AS missing_{f}"
        for i, f in enumerate(INJECT_FEATURES)
    )
    + " FROM orders"
)


@query("inject_missing", oracle=_INJECT_SQL)
def inject_missing(spark, sf_dir):
    """Per-feature MCAR rates from a seeded rule; cells masked by an integer hash of the key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", *INJECT_FEATURES)
    u = {f: _inject_u(i) for i, f in enumerate(INJECT_FEATURES)}
    masked = prep.inject_missing(o, INJECT_FEATURES, INJECT_RATES, u=u)
    return prep.with_missing_mask(masked, INJECT_FEATURES).select(
        "o_orderkey", *INJECT_FEATURES, *[f"missing_{f}" for f in INJECT_FEATURES]
    )


def _profile_sql() -> str:
    parts = [
        f"SELECT '{f}' AS feature, count({f}) AS n, count(*) FILTER (WHERE {f} IS NULL) AS nulls, "
        f"count(DISTINCT {f}) AS n_distinct, min({f}) AS min, max({f}) AS max FROM raw"
        for f in fx.FX_A_FEATURES
    ]
    return f"{RAW_A} " + " UNION ALL ".join(parts)


@query("feature_profile", oracle=_profile_sql())
def feature_profile(spark, sf_dir):
    """Per feature: values, nulls, distinct values, min, max (one job over the long form)."""
    raw = fx.fx_a(spark, sf_dir)
    long_df = splits.unpivot(raw, fx.FX_A_FEATURES, [None] * len(fx.FX_A_FEATURES), [])
    return stats.feature_profile(long_df, fx.FX_A_FEATURES)


@query(
    "validate_labels",
    oracle=(
        f"WITH raw AS ({fx.FX_B_SQL}) SELECT min(label) AS min_label, max(label) AS max_label, "
        "count(DISTINCT label) AS n_classes, min(label) = 0 AND max(label) = count(DISTINCT label) - 1 AS valid FROM raw"
    ),
)
def validate_labels(spark, sf_dir):
    return stats.label_summary(fx.fx_b(spark, sf_dir))


_MASK_CHECK_FEATURES = fx.FX_A_FEATURES + ["l_extendedprice"]


def _mask_check_sql() -> str:
    parts = []
    for f in _MASK_CHECK_FEATURES:
        if f in fx.FX_A_FEATURES:
            parts.append(
                f"SELECT '{f}' AS feature, true AS has_mask, count(*) AS n, count(missing_{f}) AS n_mask, "
                f"CAST(coalesce(sum(missing_{f}), 0) AS BIGINT) AS n_missing, count(*) = count(missing_{f}) AS complete FROM prep"
            )
        else:
            parts.append(
                f"SELECT '{f}' AS feature, false AS has_mask, count(*) AS n, CAST(0 AS BIGINT) AS n_mask, "
                "CAST(0 AS BIGINT) AS n_missing, false AS complete FROM prep"
            )
    return f"WITH prep AS ({fx.FX_A_PREP_SQL}) " + " UNION ALL ".join(parts)


@query("validate_mask", oracle=_mask_check_sql())
def validate_mask(spark, sf_dir):
    """Mask present and complete per feature; a feature without one is flagged."""
    df = fx.fx_a_prepared(spark, sf_dir)
    return stats.mask_summary(df, _MASK_CHECK_FEATURES)


# fixed values: the split hash over the FX_A key
SPLIT_TERMS = [("l_orderkey", 48271), ("l_linenumber", 69621), ("l_partkey", 16807), ("l_suppkey", 40692)]
SPLIT_MODULUS = 2147483
N_TEST = 1000


def _split_u():
    return prep.linear_u(SPLIT_TERMS, SPLIT_MODULUS)


_SPLIT_U_SQL = "((" + " + ".join(f"{c}*{k}" for c, k in SPLIT_TERMS) + f") % {SPLIT_MODULUS}) / {float(SPLIT_MODULUS)!r}"


@query(
    "split_exact",
    oracle=(
        f"WITH prep AS ({fx.FX_A_PREP_SQL}), u AS (SELECT {A_KEYS}, {_SPLIT_U_SQL} AS u FROM prep) "
        f"SELECT {A_KEYS}, CASE WHEN row_number() OVER (ORDER BY u, {A_KEYS}) <= {N_TEST} THEN 'test' ELSE 'train' END AS side FROM u"
    ),
)
def split_exact(spark, sf_dir):
    """Exactly N_TEST test rows: the smallest (hash, key) tuples, without a global sort."""
    df = fx.fx_a_prepared(spark, sf_dir).select(*fx.FX_A_KEYS)
    return prep.split_exact_side(df, _split_u(), N_TEST, fx.FX_A_KEYS)


@query(
    "split_fraction",
    oracle=(
        f"WITH prep AS ({fx.FX_A_PREP_SQL}) SELECT CASE WHEN {_SPLIT_U_SQL} < {lit(0.2)} THEN 'test' ELSE 'train' END AS side, "
        "count(*) AS n FROM prep GROUP BY 1"
    ),
)
def split_fraction(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    sided = df.select(prep.fraction_side(_split_u(), 0.2).alias("side"))
    return sided.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_rows",
    oracle=(
        f"WITH prep AS ({fx.FX_C_PREP_SQL}) SELECT CASE WHEN hour_num <= {lit(11.5)} THEN 'left' ELSE 'right' END AS side, "
        "count(*) AS n, sum(sample_weight) AS weight FROM prep GROUP BY 1"
    ),
)
def split_rows(spark, sf_dir):
    """Rows of a node split at ``hour_num <= 11.5``: count and weight per side."""
    df = fx.fx_c_prepared(spark, sf_dir)
    sided = df.select(prep.split_side("hour_num", 11.5).alias("side"), "sample_weight").filter(F.col("side").isNotNull())
    return sided.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_weight").alias("weight"))


def _assemble_sql() -> str:
    parts = [
        f"SELECT {A_KEYS}, CAST({i} AS INTEGER) AS pos, {f} AS value, missing_{f} AS missing, label FROM prep"
        for i, f in enumerate(fx.FX_A_FEATURES)
    ]
    return f"WITH prep AS ({fx.FX_A_PREP_SQL}) " + " UNION ALL ".join(parts)


@query("assemble_arrays", oracle=_assemble_sql())
def assemble_arrays(spark, sf_dir):
    """Features and masks packed into ARRAY<DOUBLE> / ARRAY<INT> columns (shown exploded)."""
    df = fx.fx_a_prepared(spark, sf_dir)
    packed = prep.assemble(df, fx.FX_A_FEATURES).select(*fx.FX_A_KEYS, "features", "missing", "label")
    zipped = F.arrays_zip(F.col("features").alias("value"), F.col("missing").alias("missing"))
    return packed.select(*fx.FX_A_KEYS, F.posexplode(zipped).alias("pos", "z"), "label").select(
        *fx.FX_A_KEYS, "pos", "z.value", "z.missing", "label"
    )
