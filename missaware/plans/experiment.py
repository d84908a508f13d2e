"""Experiments as Spark jobs: evaluate a configuration, sweep alpha, summarise over seeds.

The alpha sweep exploits that the penalty is constant per (node, feature): the best cut
of each feature does not depend on alpha, so the histogram job runs once and the alpha
grid is applied to the small per-feature table (one row per fold x feature x alpha).
Folds play the role of trees: rows are routed to every fold they train, all folds share
one histogram job, and the winners (folds x grid rows) are joined back to the test rows
as a broadcast of known, bounded size.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missaware.functions.impurity import RANK_DIGITS
from missaware.operators import scoring, splits
from missaware.plans.model import TreeModel
from missaware.plans.tree import FeatureSpec, FitParams, fit_forest

RESULT_KEYS = [
    "estimator_alias",
    "n_train",
    "n_test",
    "n_features",
    "max_depth",
    "alpha",
    "seed",
    "training_time",
    "accuracy",
    "rho",
]


def evaluate(train: DataFrame, test: DataFrame, features: list[str], params: FitParams, label: str = "label", weight: str | None = None) -> tuple[TreeModel, DataFrame]:
    """Fit on ``train``; one-row DataFrame with accuracy and reliance on ``test``."""
    model = fit_forest(train, FeatureSpec.columns(train, features), label, params, weight=weight)[0]
    scored = scoring.transform(test, model, prediction="_p", rho="_r")
    out = scored.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg((F.col("_p") == F.col(label)).cast("double")).alias("accuracy"),
        F.coalesce(F.avg(F.col("_r").cast("double")), F.lit(0.0)).alias("rho"),
    )
    return model, out


def run_record(alias: str, train: DataFrame, test: DataFrame, features: list[str], params: FitParams, seed: int = 0, label: str = "label") -> DataFrame:
    """One evaluation as a row of the ten result keys; the training time is measured."""
    began = time.perf_counter()
    model, out = evaluate(train, test, features, params, label)
    seconds = time.perf_counter() - began
    fixed = {"estimator_alias": alias, "n_train": model.root.n, "n_features": len(features), "max_depth": params.max_depth, "alpha": float(params.alpha), "seed": seed, "training_time": seconds}
    return out.select(*[(F.lit(fixed[k]) if k in fixed else F.col(k)).alias(k) for k in RESULT_KEYS])


def per_feature_best(rows: DataFrame, spec: FeatureSpec, n_classes: int, criterion: str = "gini", keys=("_t", "_n")) -> DataFrame:
    """Best unpenalised cut per (keys, feature) of a routed row table (``_y``, ``_w``, keys)."""
    keys = list(keys)
    long_df = spec.unpivot(rows, keys + ["_y", "_w"])
    hist = splits.histogram(long_df, keys, n_classes)
    cum = splits.cumulative(hist, keys, n_classes)
    pc = splits.penalised(splits.candidates(cum, keys, n_classes, criterion), 0.0)
    return splits.best_per_feature(pc, keys, criterion, n_classes)


def apply_alpha_grid(best: DataFrame, alphas: list[float], criterion: str = "gini", keys=("_t", "_n")) -> DataFrame:
    """Winner per (keys, alpha) from per-feature bests; the grid is a literal array."""
    keys = list(keys)
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    g = best.select("*", grid).withColumn("_ps", F.col("_s") - F.col("alpha") * F.col("_share"))
    rank = F.struct(
        F.round("_ps", RANK_DIGITS[criterion]).alias("_rank"),
        (-F.col("_f")).alias("_neg_f"),
        (-F.col("_thr")).alias("_neg_thr"),
        *[c for c in best.columns if c not in keys and c not in ("_ps",)],
        "_ps",
    )
    won = g.groupBy(*keys, "alpha").agg(F.max(rank).alias("_b"))
    return won.select(*keys, "alpha", "_b.*").drop("_rank", "_neg_f", "_neg_thr")


def _argmax(cols: list[Column]) -> Column:
    return scoring.argmax_col(F.array(*cols))


def stump_columns(spec: FeatureSpec, n_classes: int) -> tuple[Column, Column]:
    """(prediction, reliance) of a joined stump row (``_f``, ``_thr``, ``_l*``, ``_r*``)."""
    values = F.array(*[F.col(f).cast("double") for f in spec.features])
    masks = F.array(*[F.col(m).cast("int") if m else F.lit(0) for m in spec.masks])
    x = F.element_at(values, F.col("_f") + 1)
    left = _argmax([F.col(f"_l{k}") for k in range(n_classes)])
    right = _argmax([F.col(f"_r{k}") for k in range(n_classes)])
    pred = F.when(x <= F.col("_thr"), left).otherwise(right)
    # a stump's path is its root: the row relies on missing data iff the root feature is missing
    rho = F.element_at(masks, F.col("_f") + 1)
    return pred, rho


def fold_alpha_sweep(
    df: DataFrame,
    features: list[str],
    fold: Column,
    n_folds: int,
    alphas: list[float],
    label: str = "label",
    n_classes: int = 2,
    criterion: str = "gini",
) -> DataFrame:
    """Root stumps for every (fold, alpha) in one histogram job, scored on the held-out
    fold.  Returns (fold, alpha, feature index, threshold, accuracy, rho)."""
    spec = FeatureSpec.columns(df, features)
    base = df.select(*spec.base_cols(), F.col(label).cast("int").alias("_y"), fold.alias("_fold"))
    rows = (
        base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("_t"))
        .filter(F.col("_t") != F.col("_fold"))
        .select("*", F.lit(1).cast("bigint").alias("_n"), F.lit(1.0).alias("_w"))
    )
    best = per_feature_best(rows, spec, n_classes, criterion)
    winners = apply_alpha_grid(best, alphas, criterion)
    winners = winners.withColumnRenamed("_t", "_fold")
    # folds x grid rows, known before the job
    small = F.broadcast(winners) if n_folds * len(alphas) <= splits.BROADCAST_ROW_LIMIT else winners
    joined = base.join(small, "_fold")
    pred, rho = stump_columns(spec, n_classes)
    n_train = (F.col("_nl") + F.col("_nr")).cast("bigint").alias("n_train")
    scored = joined.select(
        "_fold", "alpha", "_f", "_thr", n_train,
        (pred == F.col("_y")).cast("double").alias("_hit"), rho.cast("double").alias("_rho"),
    )
    return scored.groupBy("_fold", "alpha", "_f", "_thr", "n_train").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg("_hit").alias("accuracy"), F.avg("_rho").alias("rho")
    )


def sweep_summary(per_fold: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample standard deviation of accuracy and reliance over seeds / folds."""
    return per_fold.groupBy(*by).agg(
        F.avg("accuracy").alias("accuracy_mean"),
        F.stddev_samp("accuracy").alias("accuracy_std"),
        F.avg("rho").alias("rho_mean"),
        F.stddev_samp("rho").alias("rho_std"),
        F.count(F.lit(1)).alias("n_runs"),
    )


def fold_alpha_trees(
    df: DataFrame,
    features: list[str],
    fold: str,
    n_folds: int,
    alphas: list[float],
    max_depth: int,
    label: str = "label",
    criterion: str = "gini",
    partitions: int | None = None,
) -> DataFrame:
    """Full trees for every (fold, alpha), grown together as one forest, scored on each
    fold's held-out rows.  Tree ``t`` trains on folds other than ``t // len(alphas)`` with
    alpha ``alphas[t % len(alphas)]``; each test row walks only its own fold's trees.
    Returns (fold, alpha, n_test, accuracy, rho)."""
    from missaware.operators.scoring import walk_forest
    from missaware.plans.model import ForestModel

    g = len(alphas)
    spec = FeatureSpec.columns(df, features)
    params = FitParams(max_depth=max_depth, criterion=criterion, partitions=partitions, alphas=tuple(a for _ in range(n_folds) for a in alphas))
    held_out = lambda t: F.when(F.col(fold) == (t / F.lit(g)).cast("int"), F.lit(0)).otherwise(F.lit(1))
    trees = fit_forest(df, spec, label, params, key_cols=[fold], tree_weight=held_out, same_rows=lambda t: t // g)
    keep = list(features) + [m for m in spec.masks if m]
    test = df.select(*keep, F.col(label).cast("int").alias("_y"), F.col(fold).cast("int").alias("_fold"))
    trees_of_fold = F.sequence(F.col("_fold") * g, F.col("_fold") * g + (g - 1)).cast("array<int>")
    test = test.select("*", F.explode(trees_of_fold).alias("_t"))
    walked = walk_forest(test, ForestModel(trees))
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    per = walked.groupBy("_t").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg((F.col("_p") == F.col("_y")).cast("double")).alias("accuracy"),
        F.avg(F.col("_r").cast("double")).alias("rho"),
    )
    return per.select(
        (F.col("_t") / F.lit(g)).cast("int").alias("fold"),
        F.element_at(grid, F.col("_t") % F.lit(g) + 1).alias("alpha"),
        "n_test", "accuracy", "rho",
    )
