"""Queries: sources and sinks (CSV parts, run records, saved models) and streaming scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from missaware.catalog import fixtures as fx
from missaware.catalog import fxmodel as fm
from missaware.catalog import sqlsplit as sq
from missaware.catalog.q_fit import ALPHA, ALPHA_SWEEP_GRID, N_TREES, _grid_sql, _trees_sql, _value_of, node_output
from missaware.catalog.registry import query
from missaware.plans import experiment
from missaware.plans.tree import FeatureSpec, FitParams, fit_forest
from missaware.session import scratch_path, table
from missaware.sources import csv as csv_io
from missaware.sources import models as model_io
from missaware.sources import results as results_io
from missaware.streaming import scoring as stream_scoring


@query("csv_roundtrip", oracle=fx.FX_A_PREP_SQL)
def csv_roundtrip(spark, sf_dir):
    """Prepared FX_A written as 8 header CSV parts, read back with its schema."""
    df = fx.fx_a_prepared(spark, sf_dir)
    path = scratch_path(spark, "csv")
    csv_io.write_csv_parts(df, path, 8)
    return csv_io.read_csv(spark, path, df.schema)


N_FOLDS = 2
RUN_ALIAS = "missaware_stump"


def _runs_sql() -> str:
    left = sq.argmax_sql(["w.l0", "w.l1"])
    right = sq.argmax_sql(["w.r0", "w.r1"])
    masks = "CASE w.fname " + " ".join(f"WHEN '{f}' THEN p.missing_{f}" for f in fx.FX_A_FEATURES) + " END"
    return (
        f"WITH fd AS (SELECT *, CAST(l_orderkey % {N_FOLDS} AS INTEGER) AS fold FROM ({fx.FX_A_PREP_SQL}) q), "
        f"tr AS (SELECT p.*, CAST(r.t AS INTEGER) AS t FROM fd p, range({N_FOLDS}) r(t) WHERE p.fold <> r.t),\n"
        + sq.chain("tr", fx.FX_A_FEATURES, 2, 0.0, per_feature=True, tree="t")
        + ", ranked AS (SELECT b.*, g.alpha, row_number() OVER (PARTITION BY b.t, g.alpha ORDER BY round(b.s - g.alpha * b.share, 12) DESC, "
        + "b.f ASC, b.thr ASC) AS rk2 FROM best b, " + _grid_sql(ALPHA_SWEEP_GRID) + "), "
        "win AS (SELECT * FROM ranked WHERE rk2 = 1), "
        f"ev AS (SELECT w.t, w.alpha, w.nl + w.nr AS n_train, CAST(CASE WHEN {_value_of(fx.FX_A_FEATURES)} <= w.thr THEN {left} ELSE {right} END = p.label AS DOUBLE) AS hit, "
        f"CAST({masks} AS DOUBLE) AS miss FROM fd p JOIN win w ON p.fold = w.t) "
        f"SELECT '{RUN_ALIAS}' AS estimator_alias, CAST(n_train AS DOUBLE) AS n_train, CAST(count(*) AS DOUBLE) AS n_test, "
        f"CAST({len(fx.FX_A_FEATURES)} AS DOUBLE) AS n_features, CAST(1 AS DOUBLE) AS max_depth, alpha, CAST(t AS DOUBLE) AS seed, "
        "round(avg(hit), 6) AS accuracy, round(avg(miss), 6) AS rho FROM ev GROUP BY t, alpha, n_train"
    )


@query("collect_results", oracle=_runs_sql())
def collect_results(spark, sf_dir):
    """Stumps for 2 parity folds x the alpha grid written as one key,value CSV per run,
    then read back as one typed row per file (training time left out: it is a clock)."""
    df = fx.fx_a_prepared(spark, sf_dir)
    fold = (F.col("l_orderkey") % N_FOLDS).cast("int")
    per = experiment.fold_alpha_sweep(df, fx.FX_A_FEATURES, fold, N_FOLDS, ALPHA_SWEEP_GRID)
    runs = per.select(
        F.lit(RUN_ALIAS).alias("estimator_alias"),
        "n_train",
        "n_test",
        F.lit(len(fx.FX_A_FEATURES)).alias("n_features"),
        F.lit(1).alias("max_depth"),
        "alpha",
        F.col("_fold").alias("seed"),
        F.lit(0.0).alias("training_time"),
        F.round("accuracy", 6).alias("accuracy"),
        F.round("rho", 6).alias("rho"),
        F.concat_ws("_", F.col("_fold"), F.col("alpha")).alias("run"),
    )
    path = scratch_path(spark, "results")
    results_io.write_runs(runs, path)
    got = results_io.collect_results(spark, path)
    return got.drop("training_time")


def _record_sql() -> str:
    from missaware.catalog.q_fit import _evaluate_sql

    return (
        f"SELECT '{RUN_ALIAS}' AS estimator_alias, CAST(n_train AS DOUBLE) AS n_train, CAST(n_test AS DOUBLE) AS n_test, CAST({len(fx.FX_A_FEATURES)} AS DOUBLE) AS n_features, "
        f"CAST(1 AS DOUBLE) AS max_depth, {sq.lit(ALPHA)} AS alpha, CAST(7 AS DOUBLE) AS seed, accuracy, rho FROM ({_evaluate_sql()}) q"
    )


@query("evaluate_record", oracle=_record_sql())
def evaluate_record(spark, sf_dir):
    """One evaluation written as a key,value record of the ten result keys and read back (the
    training time left out: it is a clock)."""
    df = fx.fx_a_prepared(spark, sf_dir)
    train, test = df.filter(F.col("l_orderkey") % 2 == 0), df.filter(F.col("l_orderkey") % 2 == 1)
    path = scratch_path(spark, "record")
    results_io.write_result(experiment.run_record(RUN_ALIAS, train, test, fx.FX_A_FEATURES, FitParams(max_depth=1, alpha=ALPHA), seed=7), path)
    got = results_io.collect_results(spark, path).filter("training_time > 0").drop("training_time")
    return got.withColumns({c: F.round(c, 6) for c in ("accuracy", "rho")})


def _fit_a(spark, sf_dir, depth=2):
    df = fx.fx_a_prepared(spark, sf_dir)
    return fit_forest(df, FeatureSpec.columns(df, fx.FX_A_FEATURES), "label", FitParams(max_depth=depth, alpha=ALPHA))


@query("model_roundtrip", oracle=sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 2))
def model_roundtrip(spark, sf_dir):
    """Fitted tree saved (node table + metadata) and loaded back: the fitted node table."""
    model = _fit_a(spark, sf_dir)[0]
    path = scratch_path(spark, "model")
    model_io.save_tree(spark, model, path)
    model_io.save_nested_json(spark, model, path + "-nested")
    return node_output(spark, [model_io.load_tree(spark, path)])


@query(
    "forest_roundtrip",
    oracle=sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 2, trees_sql=_trees_sql(N_TREES)),
)
def forest_roundtrip(spark, sf_dir):
    """Three bootstrap trees saved as one node table and loaded back."""
    df = fx.fx_a_prepared(spark, sf_dir)
    trees = fit_forest(
        df, FeatureSpec.columns(df, fx.FX_A_FEATURES), "label", FitParams(max_depth=2, alpha=ALPHA),
        n_trees=N_TREES, bootstrap=True, key_cols=fx.FX_A_KEYS, bootstrap_u=fx.fx_f_u,
    )
    from missaware.plans.model import ForestModel

    path = scratch_path(spark, "forest")
    model_io.save_forest(spark, ForestModel(trees), path)
    return node_output(spark, model_io.load_forest(spark, path).trees)


_NODE_TABLE_SQL = (
    "SELECT CAST(tree AS INTEGER) AS tree, node, CASE WHEN node > 1 THEN node // 2 END AS parent, "
    "CASE WHEN node > 1 THEN node % 2 = 0 END AS is_left, CAST(depth AS INTEGER) AS depth, feature, threshold, n, "
    "weight, weight_0, weight_1, CAST(prediction AS INTEGER) AS prediction, is_leaf "
    f"FROM ({sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 2, class_weights=True)}) q"
)


@query("node_table", oracle=_NODE_TABLE_SQL)
def node_table(spark, sf_dir):
    """Fitted tree as rows: node, parent, side, split, weight and class weights."""
    model = _fit_a(spark, sf_dir)[0]
    nt = model.node_table(spark)
    return nt.select(
        "tree", "node",
        F.when(F.col("node") > 1, F.shiftright("node", 1)).alias("parent"),
        F.when(F.col("node") > 1, F.col("node") % 2 == 0).alias("is_left"),
        "depth", "feature", "threshold", "n", "weight",
        F.col("class_weights")[0].alias("weight_0"), F.col("class_weights")[1].alias("weight_1"),
        "prediction", "is_leaf",
    )


# ---- streaming -------------------------------------------------------------------------------

def _lineitem_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "lineitem").schema
    src = stream_scoring.read_parquet_stream(spark, sf_dir, "lineitem.parquet", schema)
    from missaware.operators import prep

    return prep.prepare(fx.fx_a_from(src), fx.FX_A_FEATURES, impute="zero")


@query(
    "stream_rho",
    oracle=(
        f"WITH prep AS ({fx.FX_A_PREP_SQL}) SELECT count(*) AS n, CAST(sum({fm.reliance_sql(fm.fx_m())}) AS BIGINT) AS n_reliant, "
        f"round(avg(CAST({fm.reliance_sql(fm.fx_m())} AS DOUBLE)), 6) AS rho FROM prep"
    ),
)
def stream_rho(spark, sf_dir):
    """FX_M reliance over lineitem read as a stream: a running aggregate, complete mode."""
    agg = stream_scoring.reliance_stream(_lineitem_stream(spark, sf_dir), fm.fx_m())
    out = stream_scoring.run_available(spark, agg, f"stream_rho_{uuid.uuid4().hex[:8]}", "complete")
    return out.select("n", "n_reliant", F.round("rho", 6).alias("rho"))


@query(
    "stream_predict",
    oracle=(
        f"WITH prep AS ({fx.FX_A_PREP_SQL}) SELECT {', '.join(fx.FX_A_KEYS)}, CAST({fm.predict_sql(fm.fx_m())} AS INTEGER) AS prediction, "
        f"{fm.reliance_sql(fm.fx_m())} AS rho FROM prep"
    ),
)
def stream_predict(spark, sf_dir):
    """FX_M scores appended per micro-batch (stateless projection)."""
    scored = stream_scoring.score_stream(_lineitem_stream(spark, sf_dir), fm.fx_m(), fx.FX_A_KEYS)
    return stream_scoring.run_available(spark, scored, f"stream_predict_{uuid.uuid4().hex[:8]}", "append")



# ---- local frames and experiment grids ---------------------------------------------------------

_CLASS_SUMMARY_SQL = (
    f"WITH prep AS ({fx.FX_A_PREP_SQL}) SELECT label, count(*) AS n, "
    + ", ".join(f"round(avg({f}), 6) AS mean_{f}, CAST(sum(missing_{f}) AS BIGINT) AS missing_{f}" for f in fx.FX_A_FEATURES)
    + " FROM prep GROUP BY label"
)


@query("fixture_rows", oracle=_CLASS_SUMMARY_SQL)
def fixture_rows(spark, sf_dir):
    """A local (pandas) frame turned into a DataFrame through Arrow: the per-class summary of
    FX_A, aggregated by Spark (one row per class), taken to pandas and back."""
    df = fx.fx_a_prepared(spark, sf_dir)
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in fx.FX_A_FEATURES:
        aggs += [F.round(F.avg(f), 6).alias(f"mean_{f}"), F.sum(f"missing_{f}").cast("bigint").alias(f"missing_{f}")]
    local = df.groupBy("label").agg(*aggs).toPandas()  # bounded: one row per class
    return spark.createDataFrame(local)


_GRID_FOLDS = 5


def _grid_sql() -> str:
    grid = ", ".join(f"({sq.lit(a)})" for a in ALPHA_SWEEP_GRID)
    return (
        f"WITH fd AS (SELECT (l_orderkey*7 + l_linenumber) % {_GRID_FOLDS} AS fold FROM ({fx.FX_A_PREP_SQL}) q), "
        "tr AS (SELECT r.t AS seed, count(*) AS n_train FROM fd, range(" + str(_GRID_FOLDS) + ") r(t) WHERE fd.fold <> r.t GROUP BY r.t) "
        f"SELECT '{RUN_ALIAS}' AS estimator_alias, CAST(n_train AS DOUBLE) AS n_train, CAST(20 AS DOUBLE) AS n_features, "
        f"CAST(1 AS DOUBLE) AS max_depth, g.alpha AS alpha, CAST(seed AS DOUBLE) AS seed FROM tr, (VALUES {grid}) AS g(alpha)"
    )


@query("param_grid", oracle=_grid_sql())
def param_grid(spark, sf_dir):
    """The fold x alpha experiment grid of the sweep written as ``k=v`` text lines (no
    ``n_features``: the reader's default 20 applies) and parsed back with typed columns."""
    df = fx.fx_a_prepared(spark, sf_dir)
    fold = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % _GRID_FOLDS
    per_fold = df.select(fold.alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # five rows
    runs = per_fold.select(F.col("fold").alias("seed"), (total - F.col("n")).alias("n_train"))
    runs = runs.select("*", F.explode(F.array(*[F.lit(float(a)) for a in ALPHA_SWEEP_GRID])).alias("alpha"))
    line = F.format_string(
        f"estimator_alias={RUN_ALIAS} n_train=%d max_depth=1 alpha=%s seed=%d",
        F.col("n_train"), F.col("alpha").cast("string"), F.col("seed"),
    )
    path = scratch_path(spark, "grid")
    runs.select(line.alias("value")).write.text(path)
    grid = results_io.read_param_grid(spark, path)
    p = F.col("params")
    return grid.select(
        p["estimator_alias"].alias("estimator_alias"),
        *[p[k].cast("double").alias(k) for k in ("n_train", "n_features", "max_depth", "alpha", "seed")],
    )
