"""Shared and subtracted histograms of the level-wise fit: same trees, fewer rows."""

import pytest
from pyspark.sql import functions as F

from missaware.catalog import fixtures as fx
from missaware.operators import splits
from missaware.plans import tree as T
from missaware.plans.tree import FeatureSpec, FitParams, fit_forest

from conftest import SF_SMALL

FEATS = fx.FX_A_FEATURES


@pytest.fixture(scope="module")
def fxa(spark):
    return fx.fx_a_prepared(spark, SF_SMALL).withColumn("fold", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 3).cast("int")).cache()


def _shape(models):
    return [sorted((k, n.feature_idx, n.threshold, n.score, n.n, n.weight, tuple(n.class_weights)) for k, n in m.nodes.items()) for m in models]


def _fit(df, weight=None, n_trees=1, **kw):
    more = {k: kw.pop(k) for k in ("bootstrap", "key_cols", "tree_weight", "same_rows") if k in kw}
    return fit_forest(df, FeatureSpec.columns(df, FEATS), "label", FitParams(**kw), weight=weight, n_trees=n_trees, **more)


def _counting(monkeypatch):
    """Rows unpivoted per call of the histogram (one per level)."""
    seen, made = [], splits.histogram
    monkeypatch.setattr(T.splits, "histogram", lambda long_df, *a: seen.append(long_df.count()) or made(long_df, *a))
    return seen


held_out = lambda t: F.when(F.col("fold") == (t / F.lit(3)).cast("int"), F.lit(0)).otherwise(F.lit(1))
CASES = {
    "exact": dict(max_depth=4, alpha=0.1),
    "binned": dict(max_depth=5, alpha=1.0, bins=8),
    "entropy": dict(max_depth=3, alpha=0.1, criterion="info_gain"),
    "bootstrap": dict(max_depth=3, alpha=0.1, bins=16, n_trees=4, bootstrap=True, key_cols=fx.FX_A_KEYS),
    "grid": dict(max_depth=4, alphas=(0.0, 0.01, 0.1, 1.0), bins=16),
    "folds": dict(max_depth=3, alphas=(0.0, 0.1, 1.0) * 3, key_cols=["fold"], tree_weight=held_out, same_rows=lambda t: t // 3),
}


@pytest.mark.parametrize("case", CASES)
def test_subtracted_histograms_give_the_same_trees(fxa, monkeypatch, case):
    monkeypatch.setattr(T, "SPARSE", 0.0)  # never
    plain = _shape(_fit(fxa, **CASES[case]))
    monkeypatch.setattr(T, "SPARSE", 1e9)  # always
    assert _shape(_fit(fxa, **CASES[case])) == plain


def test_at_most_half_of_the_open_rows_are_unpivoted(fxa, monkeypatch):
    monkeypatch.setattr(T, "SPARSE", 1e9)
    seen = _counting(monkeypatch)
    m = _fit(fxa, max_depth=6, alpha=0.1, bins=16)[0]
    split = {d: [n for n in m.nodes.values() if n.depth == d and not n.is_leaf] for d in range(6)}
    assert len(seen) == 6 and seen[0] == m.root.n * len(FEATS)
    for d in range(1, 6):
        children = sum(m.nodes[2 * n.node + k].n for n in split[d - 1] for k in (0, 1))
        assert seen[d] == sum(min(m.nodes[2 * n.node + k].n for k in (0, 1)) for n in split[d - 1] if any(m.nodes[2 * n.node + k] in split[d] for k in (0, 1))) * len(FEATS)
        assert seen[d] <= children * len(FEATS) / 2


def test_fractional_weights_are_never_subtracted(fxa, monkeypatch):
    monkeypatch.setattr(T, "SPARSE", 1e9)
    df = fxa.withColumn("w", F.lit(0.1) + (F.col("l_linenumber") % 3) / 7)
    seen = _counting(monkeypatch)
    m = _fit(df, weight="w", max_depth=3, alpha=0.1, bins=8)[0]
    for d in range(1, 3):
        assert seen[d] == sum(n.n for n in m.nodes.values() if n.depth == d and not n.is_leaf) * len(FEATS)


def test_trees_of_an_alpha_grid_share_rows_until_they_part(fxa, monkeypatch):
    monkeypatch.setattr(T, "SPARSE", 0.0)
    seen = _counting(monkeypatch)
    models = _fit(fxa, max_depth=4, alphas=(0.0, 1e-9, 0.1, 1.0), bins=16)
    assert seen[0] == fxa.count() * len(FEATS)  # one root for four trees
    for d in range(1, 4):
        distinct = {}
        for m in models:
            for n in m.nodes.values():
                if n.depth == d and not n.is_leaf:
                    path = tuple((m.nodes[a].feature_idx, m.nodes[a].threshold) for a in m.path(n.node))
                    distinct[n.node, path] = n.n
        assert seen[d] == sum(distinct.values()) * len(FEATS)
    separate = [_fit(fxa, max_depth=4, alpha=a, bins=16)[0] for a in (0.0, 1e-9, 0.1, 1.0)]
    assert _shape(models) == _shape(separate)
