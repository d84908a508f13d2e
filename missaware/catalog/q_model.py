"""Queries: the Estimators themselves (fit, transform) and feature discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from missaware.catalog import fixtures as fx
from missaware.catalog import sqlsplit as sq
from missaware.catalog.q_fit import ALPHA, N_TREES, _trees_sql
from missaware.catalog.registry import query
from missaware.operators import prep
from missaware.plans.estimators import MissAwareForestClassifier, MissAwareTreeClassifier

def _tree_sql() -> str:
    fit = sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 2, class_weights=True)
    return (
        f"WITH {sq.walk_sql(fx.FX_A_PREP_SQL, fit, fx.FX_A_FEATURES, 2)} SELECT l_orderkey, l_linenumber, l_partkey, CAST(t.prediction AS DOUBLE) AS prediction, "
        "round(t.weight_1 / t.weight, 6) AS p1, r.miss AS rho FROM at2 r JOIN nodes t ON r.tree = t.tree AND r.leaf = t.node"
    )


@query("estimator_tree", oracle=_tree_sql())
def estimator_tree(spark, sf_dir):
    """The tree Estimator: fit, then prediction, probability and reliance of every row."""
    df = fx.fx_a_prepared(spark, sf_dir)
    model = MissAwareTreeClassifier(featureCols=fx.FX_A_FEATURES, maxDepth=2, alpha=ALPHA).fit(df)
    return model.transform(df).select("l_orderkey", "l_linenumber", "l_partkey", "prediction", F.round(F.col("probability")[1], 6).alias("p1"), "rho")


@query("estimator_array", oracle=_tree_sql())
def estimator_array(spark, sf_dir):
    """The same tree from one array of features and one of flags."""
    df = prep.assemble(fx.fx_a_prepared(spark, sf_dir), fx.FX_A_FEATURES)
    model = MissAwareTreeClassifier(featuresCol="features", missingnessCol="missing", maxDepth=2, alpha=ALPHA).fit(df)
    return model.transform(df).select("l_orderkey", "l_linenumber", "l_partkey", "prediction", F.round(F.col("probability")[1], 6).alias("p1"), "rho")


def _forest_sql() -> str:
    fit = sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 2, trees_sql=_trees_sql(N_TREES))
    key = "l_orderkey, l_linenumber, l_partkey, " + ", ".join(fx.FX_A_FEATURES)
    return (
        f"WITH {sq.walk_sql(fx.FX_A_PREP_SQL, fit, fx.FX_A_FEATURES, 2)}, votes AS (SELECT r.*, t.prediction FROM at2 r JOIN nodes t ON r.tree = t.tree AND r.leaf = t.node) "
        f"SELECT CAST(CASE WHEN avg(prediction) > 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS prediction, round(avg(prediction), 6) AS p1, round(avg(miss), 6) AS rho, {key} "
        f"FROM votes GROUP BY {key}"
    )


@query("estimator_forest", oracle=_forest_sql())
def estimator_forest(spark, sf_dir):
    """The forest Estimator: majority vote, share of votes and share of reliant trees."""
    df = fx.fx_a_prepared(spark, sf_dir)
    clf = MissAwareForestClassifier(numTrees=N_TREES, maxDepth=2, alpha=ALPHA, keyCols=fx.FX_A_KEYS, featureCols=fx.FX_A_FEATURES)
    model = clf._fit(df, bootstrap_u=fx.fx_f_u)
    key = ["l_orderkey", "l_linenumber", "l_partkey", *fx.FX_A_FEATURES]
    return model.transform(df).select("prediction", F.round(F.col("probability")[1], 6).alias("p1"), F.round("rho", 6).alias("rho"), *key).distinct()


_DISCOVERED = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate([*fx.FX_A_KEYS, *fx.FX_A_FEATURES])) + ") AS d(position, feature)"


@query(
    "discover_features",
    oracle=f"SELECT CAST(d.position AS BIGINT) AS position, d.feature, (SELECT count(*) FROM ({fx.FX_A_PREP_SQL}) q) AS n FROM ({_DISCOVERED}) d",
)
def discover_features(spark, sf_dir):
    """Every column but label, weight and masks, with the rows it holds."""
    df = fx.fx_a_prepared(spark, sf_dir)
    names = prep.discover_features(df, "label")
    pairs = F.array(*[F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(f).alias("feature"), F.count(F.lit(1)).alias("n")) for i, f in enumerate(names)])
    return df.agg(pairs.alias("p")).select(F.inline("p"))
