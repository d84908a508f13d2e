"""Queries: scoring with a fixed tree / forest over FX_A (prediction, paths, reliance)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from missaware.catalog import fixtures as fx
from missaware.catalog import fxmodel as fm
from missaware.catalog.registry import query
from missaware.catalog.sqlsplit import argmax_sql
from missaware.operators import scoring
from missaware.plans.tree import FitParams

KEYS = fx.FX_A_KEYS
KEYS_SQL = ", ".join(KEYS)
PREP = f"WITH prep AS ({fx.FX_A_PREP_SQL})"
M = fm.fx_m()
MF = fm.fx_mf()


def _keys():
    return [F.col(k) for k in KEYS]


@query("predict_tree", oracle=f"{PREP} SELECT {KEYS_SQL}, {fm.predict_sql(M)} AS prediction FROM prep")
def predict_tree(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    return scoring.transform(df, M).select(*_keys(), F.col("prediction").cast("bigint").alias("prediction"))


@query(
    "predict_proba",
    oracle=f"{PREP} SELECT {KEYS_SQL}, {fm.proba_sql(M, 0)} AS p0, {fm.proba_sql(M, 1)} AS p1 FROM prep",
)
def predict_proba(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    scored = scoring.transform(df, M, prediction=None, probability="_p")
    return scored.select(*_keys(), F.col("_p")[0].alias("p0"), F.col("_p")[1].alias("p1"))


@query(
    "predict_argmax",
    oracle=(
        f"{PREP} SELECT {KEYS_SQL}, CAST({argmax_sql([fm.proba_sql(M, 0), fm.proba_sql(M, 1)])} AS BIGINT) AS prediction FROM prep"
    ),
)
def predict_argmax(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    scored = scoring.transform(df, M, prediction=None, probability="_p")
    return scored.select(*_keys(), scoring.argmax_col(F.col("_p")).cast("bigint").alias("prediction"))


@query("leaf_assign", oracle=f"{PREP} SELECT {KEYS_SQL}, {fm.leaf_sql(M)} AS leaf FROM prep")
def leaf_assign(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    return scoring.transform(df, M, prediction=None, leaf="leaf").select(*_keys(), "leaf")


def _path_table_sql(model) -> str:
    rows = []
    for leaf in model.leaves():
        for step, a in enumerate(model.path(leaf.node)):
            an = model.nodes[a]
            rows.append(f"({leaf.node}, {step}, {an.depth}, '{model.features[an.feature_idx]}', '{model.masks[an.feature_idx]}')")
    return f"(VALUES {', '.join(rows)}) AS pth(leaf, step, depth, feature, mask)"


_MASK_OF = "CASE pth.feature " + " ".join(f"WHEN '{f}' THEN s.missing_{f}" for f in fx.FX_A_FEATURES) + " END"


@query(
    "decision_path",
    oracle=(
        f"{PREP}, scored AS (SELECT *, {fm.leaf_sql(M)} AS leaf FROM prep) "
        f"SELECT {', '.join('s.' + k for k in KEYS)}, CAST(pth.step AS BIGINT) AS step, pth.feature AS feature "
        f"FROM scored s JOIN {_path_table_sql(M)} ON s.leaf = pth.leaf"
    ),
)
def decision_path(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    return scoring.decision_path(df, M, KEYS).withColumn("step", F.col("step").cast("bigint"))


@query(
    "reliance_matrix",
    oracle=(
        f"{PREP}, scored AS (SELECT *, {fm.leaf_sql(M)} AS leaf FROM prep) "
        f"SELECT {', '.join('s.' + k for k in KEYS)}, pth.feature AS feature, {_MASK_OF} AS missing "
        f"FROM scored s JOIN {_path_table_sql(M)} ON s.leaf = pth.leaf"
    ),
)
def reliance_matrix(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    return scoring.reliance_matrix(df, M, KEYS)


def _rho_sql(where: str = "", max_depth=None, src: str = "prep", masked: str | None = None) -> str:
    r = fm.reliance_sql(M, max_depth)
    if masked:
        r = f"CASE WHEN {masked} THEN {r} ELSE 0 END"
    return f"SELECT round(coalesce(avg(CAST({r} AS DOUBLE)), 0.0), 6) AS rho FROM {src} {where}"


def _rho(df, **kw):
    return scoring.reliance(df, M, **kw).select(F.round("rho", 6).alias("rho"))


@query("rho_tree", oracle=f"{PREP} {_rho_sql()}")
def rho_tree(spark, sf_dir):
    return _rho(fx.fx_a_prepared(spark, sf_dir))


@query("rho_rows", oracle=f"{PREP} SELECT {KEYS_SQL}, {fm.reliance_sql(M)} AS rho FROM prep")
def rho_rows(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    return scoring.transform(df, M, prediction=None, rho="rho").select(*_keys(), "rho")


@query(
    "rho_depth",
    oracle=f"{PREP} " + " UNION ALL ".join(
        f"SELECT CAST({d} AS BIGINT) AS max_depth, rho FROM ({_rho_sql(max_depth=d)}) q{d}" for d in (0, 1, 2)
    ),
)
def rho_depth(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    one = scoring.reliance_by_depth(df, M, [0, 1, 2])
    stack = F.array(*[F.struct(F.lit(d).cast("bigint").alias("max_depth"), F.round(f"rho{d}", 6).alias("rho")) for d in (0, 1, 2)])
    return one.select(F.inline(stack))


@query("rho_masked", oracle=f"{PREP} {_rho_sql(masked='l_linenumber % 2 = 0')}")
def rho_masked(spark, sf_dir):
    """Rows outside the sample mask count as 0 but stay in the denominator."""
    return _rho(fx.fx_a_prepared(spark, sf_dir), sample_mask=F.col("l_linenumber") % 2 == 0)


_RAW_MASKED = (
    f"WITH prep AS (SELECT *, "
    + ", ".join(f"CAST({f} IS NULL AS INTEGER) AS missing_{f}" for f in fx.FX_A_FEATURES)
    + f" FROM ({fx.FX_A_SQL}) q)"
)


@query("rho_nulls", oracle=f"{_RAW_MASKED} {_rho_sql()}")
def rho_nulls(spark, sf_dir):
    """No imputation: a null tested value adds its node's flag and stops the walk."""
    from missaware.operators import prep

    df = prep.prepare(fx.fx_a(spark, sf_dir), fx.FX_A_FEATURES, impute="none")
    return _rho(df)


@query("rho_empty", oracle=f"{PREP} {_rho_sql(where='WHERE label > 1')}")
def rho_empty(spark, sf_dir):
    """No rows: reliance is 0.0, not null."""
    return _rho(fx.fx_a_prepared(spark, sf_dir).filter(F.col("label") > 1))


@query(
    "accuracy",
    oracle=f"{PREP} SELECT round(avg(CAST({fm.predict_sql(M)} = label AS DOUBLE)), 6) AS accuracy FROM prep",
)
def accuracy(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    df = scoring.transform(df, M)
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return df.agg(F.round(F.avg(hit), 6).alias("accuracy"))


# ---- checks --------------------------------------------------------------------------------


@query(
    "scoring_columns",
    oracle=f"{PREP} SELECT 'none' AS dropped, 0 AS refused, count(*) AS n_scored FROM prep UNION ALL "
    f"SELECT unnest([{', '.join(repr(f) for f in fx.FX_A_FEATURES)}]), 1, 0",
)
def scoring_columns(spark, sf_dir):
    """A model scores every row of a table with all its features; a table that lacks one is refused when the
    query is built."""
    df = fx.fx_a_prepared(spark, sf_dir)
    out = scoring.transform(df, M).agg(F.lit("none").alias("dropped"), F.lit(0).alias("refused"), F.count("prediction").alias("n_scored"))
    for f in fx.FX_A_FEATURES:
        lacking, refused = df.drop(f), 0
        try:
            lacking = scoring.transform(lacking, M)
        except AnalysisException:
            refused = 1
        n = F.count(F.when(F.lit(refused == 0), 1))
        out = out.unionByName(lacking.agg(F.lit(f).alias("dropped"), F.lit(refused).alias("refused"), n.alias("n_scored")))
    return out


@query(
    "param_checks",
    oracle=(
        "WITH v AS (SELECT DISTINCT CAST(round(l_discount * 100) AS INTEGER) - 5 AS v FROM lineitem) "
        "SELECT v, (v >= 0)::INTEGER AS alpha_ok, (v >= 1)::INTEGER AS depth_ok, (v >= 2)::INTEGER AS bins_ok FROM v"
    ),
)
def param_checks(spark, sf_dir):
    """Which of the table's values (discounts in percent less 5) the fit takes as alpha, depth and bins."""
    def ok(**kw):
        try:
            FitParams(**kw).validate()
        except ValueError:
            return 0
        return 1

    values = range(-5, 96)
    checks = {"alpha_ok": lambda v: ok(alpha=float(v)), "depth_ok": lambda v: ok(max_depth=v), "bins_ok": lambda v: ok(bins=v)}
    found = fx.table(spark, sf_dir, "lineitem").select((F.round(F.col("l_discount") * 100).cast("int") - 5).alias("v")).distinct()
    return found.select("v", *[F.get(scoring.node_values([check(v) for v in values], "int"), F.col("v") + 5).alias(name) for name, check in checks.items()])


# ---- forest ------------------------------------------------------------------------------

def _vote_sql() -> str:
    votes = [fm.predict_sql(t) for t in MF.trees]
    c0 = " + ".join(f"CASE WHEN {v} = 0 THEN 1 ELSE 0 END" for v in votes)
    c1 = " + ".join(f"CASE WHEN {v} = 1 THEN 1 ELSE 0 END" for v in votes)
    return f"CAST(CASE WHEN ({c0}) >= ({c1}) THEN 0 ELSE 1 END AS BIGINT)"


@query("forest_vote", oracle=f"{PREP} SELECT {KEYS_SQL}, {_vote_sql()} AS vote FROM prep")
def forest_vote(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    return scoring.forest_transform(df, MF).select(*_keys(), F.col("prediction").cast("bigint").alias("vote"))


def _forest_rho_sql() -> str:
    per = [f"avg(CAST({fm.reliance_sql(t)} AS DOUBLE))" for t in MF.trees]
    cols = [f"round({p}, 6) AS rho_t{i}" for i, p in enumerate(per)]
    mean = f"round(({' + '.join(per)}) / {float(len(per))!r}, 6) AS rho_mean"
    return f"{PREP} SELECT {', '.join(cols)}, {mean} FROM prep"


@query("forest_rho", oracle=_forest_rho_sql())
def forest_rho(spark, sf_dir):
    """Reliance of each tree and their mean, in one pass over the table."""
    df = fx.fx_a_prepared(spark, sf_dir)
    per = [F.col(f"rho_t{i}") for i in range(len(MF.trees))]
    mean = F.round(scoring.mean_of(per), 6).alias("rho_mean")
    return scoring.forest_reliance_by_tree(df, MF).select(*[F.round(p, 6).alias(f"rho_t{i}") for i, p in enumerate(per)], mean)


def _forest_rho_mean_sql() -> str:
    per = [f"avg(CAST({fm.reliance_sql(t)} AS DOUBLE))" for t in MF.trees]
    return f"{PREP} SELECT round(({' + '.join(per)}) / {float(len(per))!r}, 6) AS rho FROM prep"


@query("forest_rho_join", oracle=_forest_rho_mean_sql())
def forest_rho_join(spark, sf_dir):
    """Forest reliance as the mean of each row's share of reliant trees."""
    df = fx.fx_a_prepared(spark, sf_dir)
    return scoring.forest_reliance(df, MF).select(F.round("rho", 6).alias("rho"))


_VOTE_KEY = KEYS + fx.FX_A_FEATURES  # the FX_A key alone repeats once at sf0.001


@query(
    "forest_vote_join",
    oracle=f"{PREP} SELECT DISTINCT {', '.join(_VOTE_KEY)}, CAST({_vote_sql()} AS INTEGER) AS prediction FROM prep",
)
def forest_vote_join(spark, sf_dir):
    """Majority vote per distinct row."""
    df = fx.fx_a_prepared(spark, sf_dir)
    return scoring.forest_transform(df, MF).select(*_VOTE_KEY, "prediction").distinct()


@query(
    "forest_vote_any_key",
    oracle=(
        f"{PREP}, k AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_linenumber END AS k, {_vote_sql()} AS vote FROM prep) "
        "SELECT CAST(k AS BIGINT) AS k, vote, count(*) AS n FROM k GROUP BY ALL"
    ),
)
def forest_vote_any_key(spark, sf_dir):
    """Majority vote of rows whose key is null or repeats: scoring needs no key, every row keeps its vote."""
    df = fx.fx_a_prepared(spark, sf_dir)
    k = F.when(F.col("l_linenumber") % 2 != 0, F.col("l_linenumber")).cast("bigint")
    scored = scoring.forest_transform(df, MF).select(k.alias("k"), F.col("prediction").cast("bigint").alias("vote"))
    return scored.groupBy("k", "vote").agg(F.count(F.lit(1)).alias("n"))


# ---- leaf report ---------------------------------------------------------------------------

def _leaf_report_sql() -> str:
    rules = "CASE leaf " + " ".join(f"WHEN {n} THEN '{rule}'" for n, rule in fm.FX_M_RULES.items()) + " END"
    return (
        f"{PREP}, scored AS (SELECT *, {fm.leaf_sql(M)} AS leaf, {fm.reliance_sql(M)} AS r FROM prep) "
        f"SELECT leaf, {rules} AS rule, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS positives, "
        f"round(avg(CAST(label AS DOUBLE)), 6) AS positive_share, round(avg(CAST(r AS DOUBLE)), 6) AS rho "
        f"FROM scored GROUP BY leaf"
    )


@query("leaf_report", oracle=_leaf_report_sql())
def leaf_report(spark, sf_dir):
    """Per leaf: rule, support, class mix and the share of rows relying on missing values."""
    df = fx.fx_a_prepared(spark, sf_dir)
    return scoring.leaf_report(df, M).select(
        "leaf", "rule", "n", "positives", "positive_share", "rho"
    )

