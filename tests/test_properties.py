"""Metamorphic properties of the fit on FX_A (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from missaware.catalog import fixtures as fx
from missaware.operators import scoring, splits
from missaware.plans.tree import FeatureSpec, FitParams, fit_forest, fit_tree

from conftest import SF_SMALL

FEATS = fx.FX_A_FEATURES


@pytest.fixture(scope="module")
def fxa(spark):
    return fx.fx_a_prepared(spark, SF_SMALL).cache()


def _fit(df, **kw):
    weight = kw.pop("weight", None)
    return fit_tree(df, FeatureSpec.columns(df, FEATS), "label", FitParams(**kw), weight=weight)


def _shape(m):
    return sorted((k, n.feature_idx, n.threshold, n.n, n.weight, tuple(n.class_weights)) for k, n in m.nodes.items())


def test_huge_alpha_picks_least_missing(fxa):
    shares = fxa.agg(*[F.avg(f"missing_{f}").alias(f) for f in FEATS]).first().asDict()
    m = _fit(fxa, max_depth=1, alpha=100.0)
    assert m.features[m.root.feature_idx] == min(shares, key=shares.get)


def test_partitioning_does_not_matter(fxa):
    a = _fit(fxa.repartition(3), max_depth=3, alpha=0.1)
    b = _fit(fxa.repartition(11).orderBy(F.rand(7)), max_depth=3, alpha=0.1)
    assert _shape(a) == _shape(b)


def test_weight_two_equals_duplicate(fxa):
    dup = fxa.filter(F.col("l_linenumber") == 1)
    doubled = fxa.unionByName(dup)
    weighted = fxa.withColumn("w", F.when(F.col("l_linenumber") == 1, 2.0).otherwise(1.0))
    a = _fit(doubled, max_depth=2, alpha=0.1)
    b = _fit(weighted, max_depth=2, alpha=0.1, weight="w")
    sa = [(k, x[1], x[2], x[4], x[5]) for k, *x in [(s[0], *s) for s in _shape(a)]]
    sb = [(k, x[1], x[2], x[4], x[5]) for k, *x in [(s[0], *s) for s in _shape(b)]]
    assert sa == sb


def test_level_wise_equals_recursion(fxa):
    """Depth-first recursion with one filter per node gives the same tree."""
    m = _fit(fxa, max_depth=3, alpha=0.1)

    def grow(df, node, depth):
        if depth == 3:
            return
        best = splits.search(df, FEATS, 2, alpha=0.1).collect()
        if not best:
            assert m.nodes[node].is_leaf
            return
        b = best[0]
        n = m.nodes[node]
        assert (n.feature_idx, n.threshold) == (b["_f"], b["_thr"])
        col = F.col(FEATS[b["_f"]])
        for child, part in ((2 * node, df.filter(col <= b["_thr"])), (2 * node + 1, df.filter(col > b["_thr"]))):
            cw = part.groupBy("label").count().collect()
            if len(cw) > 1:
                grow(part, child, depth + 1)
            else:
                assert m.nodes[child].is_leaf

    grow(fxa, 1, 0)


def test_alpha_zero_is_plain_cart(fxa):
    """With alpha 0 masks do not matter: dropping them gives the same tree."""
    a = _fit(fxa, max_depth=2, alpha=0.0)
    b = _fit(fxa.drop(*[f"missing_{f}" for f in FEATS]), max_depth=2, alpha=0.0)
    assert [(k, x[1], x[2]) for k, *x in [(s[0], *s) for s in _shape(a)]] == [
        (k, x[1], x[2]) for k, *x in [(s[0], *s) for s in _shape(b)]
    ]


def test_value_ranges_path_equals_window(fxa):
    """Forcing the two-phase range scan (hot groups) gives the same running sums."""
    long_df = splits.long_form(fxa, FEATS)
    hist = splits.histogram(long_df, ["_t", "_n"], 2).cache()
    cols = ["_f", "_v", "_next", "_nl", "_wl", "_l0", "_l1", "_tot_n", "_tot_w", "_tot_c0", "_tot_mw"]
    plain = splits.cumulative(hist, ["_t", "_n"], 2, hot_groups=False).select(*cols).collect()
    ranged = splits.cumulative(hist, ["_t", "_n"], 2, max_window_bins=5, hot_groups=True).select(*cols).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, ranged))


def test_binned_equals_exact_when_few_values(fxa):
    """With more bins than distinct values binning changes thresholds only within gaps:
    the training rows land in the same leaves."""
    few = ["discount", "tax"]
    spec = FeatureSpec.columns(fxa, few)
    exact = fit_forest(fxa, spec, "label", FitParams(max_depth=2, alpha=0.1))[0]
    binned = fit_forest(fxa, spec, "label", FitParams(max_depth=2, alpha=0.1, bins=64, exact_bins=True))[0]
    assert [n.feature_idx for _, n in sorted(exact.nodes.items())] == [n.feature_idx for _, n in sorted(binned.nodes.items())]
    same = fxa.agg(F.min((scoring.leaf_col(exact) == scoring.leaf_col(binned)).cast("int"))).first()[0]
    assert same == 1


def test_forest_trees_differ_and_vote(fxa):
    from missaware.operators.scoring import forest_predict_col
    from missaware.plans.model import ForestModel

    trees = fit_forest(fxa, FeatureSpec.columns(fxa, FEATS), "label", FitParams(max_depth=2, alpha=0.1),
                       n_trees=4, bootstrap=True, key_cols=fx.FX_A_KEYS, seed=3)
    assert len({t.root.weight for t in trees}) > 1
    acc = fxa.agg(F.avg((forest_predict_col(ForestModel(trees)) == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.7


def test_entropy_and_multiclass(spark):
    df = fx.fx_b_prepared(spark, SF_SMALL)
    m = fit_tree(df, FeatureSpec.columns(df, fx.FX_B_FEATURES), "label", FitParams(max_depth=2, alpha=0.1, criterion="info_gain"))
    assert m.n_classes == 3 and not m.root.is_leaf


def test_array_features_binned(spark):
    df = fx.fx_d(spark, SF_SMALL)
    spec = FeatureSpec.array(df, "embedding", "missing")
    m = fit_tree(df, spec, "label", FitParams(max_depth=2, alpha=0.1, bins=8))
    assert m.n_classes == 10 and m.array_col == "embedding"
    # the array model scores the same table
    assert df.select(scoring.predict_col(m).alias("p")).filter(F.col("p").isNull()).count() == 0


def _descend(model, row, available=True):
    """Plain walk of one row: (leaf, reliance)."""
    nid, reliant, stop = 1, 0, False
    while not model.nodes[nid].is_leaf:
        n = model.nodes[nid]
        f = model.features[n.feature_idx]
        if not stop:
            reliant = max(reliant, row[f"missing_{f}"])
        stop = stop or row[f] is None
        nid = 2 * nid + (0 if row[f] is not None and row[f] <= n.threshold else 1)
    return nid, reliant


def test_forest_scoring_equals_plain_descent(spark, fxa):
    """Votes, vote shares and reliance of a forest, with nulls in the features and no key."""
    from missaware.operators import prep, scoring
    from missaware.plans.model import ForestModel

    trees = fit_forest(fxa, FeatureSpec.columns(fxa, FEATS), "label", FitParams(max_depth=3, alpha=0.1),
                       n_trees=4, bootstrap=True, key_cols=fx.FX_A_KEYS, seed=9)
    forest = ForestModel(trees)
    raw = prep.prepare(fx.fx_a(spark, SF_SMALL).limit(400), FEATS, impute="none").cache()
    got = raw.select("*", scoring.forest_predict_col(forest).alias("p"), scoring.vote_shares_col(forest).alias("s"),
                     scoring.forest_reliance_col(forest).alias("r")).collect()
    total = 0.0
    for row in got:
        ends = [_descend(t, row) for t in trees]
        votes = [t.nodes[n].prediction for t, (n, _) in zip(trees, ends, strict=True)]
        assert row["p"] == max((0, 1), key=lambda k: (votes.count(k), -k))
        assert row["s"] == [votes.count(k) / 4 for k in (0, 1)]
        assert abs(row["r"] - sum(r for _, r in ends) / 4) < 1e-12
        total += row["r"]
    assert abs(scoring.forest_reliance(raw, forest).first()["rho"] - total / len(got)) < 1e-12


def test_large_forest_scores_quickly(spark, fxa):
    """A hundred trees of depth 10: one projection, whatever the number of nodes."""
    import random
    import time

    from missaware.operators import scoring
    from missaware.plans.model import ForestModel, TreeModel

    rng = random.Random(1)
    trees = []
    for t in range(100):
        splits_ = {n: (rng.choice(FEATS), rng.uniform(0, 50)) for n in range(1, 1024)}
        leaves = {n: rng.choice(([0.9, 0.1], [0.2, 0.8])) for n in range(1024, 2048)}
        trees.append(TreeModel.literal(FEATS, splits_, leaves, tree=t))
    forest = ForestModel(trees)
    rows = fxa.limit(300).cache()
    began = time.time()
    got = rows.select("*", scoring.forest_predict_col(forest).alias("p")).collect()
    assert time.time() - began < 60
    for row in got[:20]:
        votes = [t.nodes[_descend(t, row)[0]].prediction for t in trees]
        assert row["p"] == max((0, 1), key=lambda k: (votes.count(k), -k))


def test_thresholds_agree_with_routing(spark):
    """Adjacent doubles, NaN, infinities and values whose sum overflows: the fitted row counts are those
    that routing gives."""
    import math

    from missaware.operators import scoring

    a = 1.0
    b = math.nextafter(a, 2.0)
    for x, y in [(a, b), (1.0, float("nan")), (1.0, float("inf")), (-float("inf"), 1.0), (1.0e308, 1.7e308), (-float("inf"), float("inf"))]:
        df = spark.createDataFrame([(x, 0)] * 3 + [(y, 1)] * 3, "f double, label int")
        m = fit_tree(df, FeatureSpec.columns(df, ["f"]), "label", FitParams(max_depth=1, alpha=0.0))
        n = {r["l"]: r["n"] for r in df.groupBy(scoring.leaf_col(m).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
        assert n == {2: m.nodes[2].n, 3: m.nodes[3].n} == {2: 3, 3: 3}, (x, y)


def test_rejected_inputs(spark, fx_t):
    def fit(df, features=("a", "b"), **kw):
        fit_forest(df, FeatureSpec.columns(df, list(features)), "label", FitParams(max_depth=1), **kw)

    for label in (F.col("label") + 0.4, F.when(F.col("k") > 1, F.col("label"))):
        with pytest.raises(ValueError, match="labels"):
            fit(fx_t.withColumn("label", label))
    for flag in (F.lit(2), F.lit(None).cast("int")):
        with pytest.raises(ValueError, match="flags"):
            fit(fx_t.withColumn("missing_a", flag))
    for w in (F.lit(-1.0), F.when(F.col("k") > 1, F.lit(1.0))):
        with pytest.raises(ValueError, match="weights"):
            fit(fx_t.withColumn("w", w), weight="w")
    with pytest.raises(ValueError, match="key"):
        fit(fx_t, n_trees=2, bootstrap=True)
    arrays = fx_t.select("label", F.when(F.col("k") > 1, F.array("a", "b")).otherwise(F.array("a")).alias("v"))
    with pytest.raises(ValueError, match="length"):
        fit_forest(arrays, FeatureSpec.array(arrays, "v"), "label", FitParams(max_depth=1))
    whole = fx_t.select("label", F.array("a", "b").alias("v"))
    m = fit_forest(whole, FeatureSpec.array(whole, "v"), "label", FitParams(max_depth=1))[0]
    from missaware.operators import scoring

    with pytest.raises(Exception, match="must hold 2 features"):
        arrays.select(scoring.predict_col(m)).collect()


def test_zero_weights_stay_in_the_counts(fx_t):
    m = fit_forest(fx_t.withColumn("w", (F.col("k") > 2).cast("double")), FeatureSpec.columns(fx_t, ["a", "b"]), "label", FitParams(max_depth=1), weight="w")[0]
    assert m.root.n == 8 and m.root.weight == 6.0


def test_rare_class_survives_the_bootstrap(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("x"), F.when(F.col("id") == 7, 2).otherwise((F.col("id") % 2).cast("int")).alias("label"))
    for seed in range(4):
        trees = fit_forest(df, FeatureSpec.columns(df, ["x"]), "label", FitParams(max_depth=1), n_trees=2, bootstrap=True, key_cols=["k"], seed=seed)
        assert {t.n_classes for t in trees} == {3}


def test_equal_rows_draw_by_key(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("label"))
    trees = fit_forest(df, FeatureSpec.columns(df, ["x"]), "label", FitParams(max_depth=1), n_trees=4, bootstrap=True, key_cols=["k"])
    assert all(800 < t.root.weight < 1200 for t in trees)


def test_poisson_table_is_complete():
    from missaware.functions.hashing import poisson_cdf

    cdf = poisson_cdf()
    assert cdf == sorted(cdf) and 1.0 - cdf[-1] < 1e-15 and len(cdf) > 15


def test_exact_split_refuses_keys_that_do_not_tell_rows_apart(spark):
    from missaware.operators import prep

    u = F.lit(0.5)
    nulls = spark.createDataFrame([(None,), (1,), (2,)], "k long")
    with pytest.raises(ValueError, match="null"):
        prep.split_exact_side(nulls, u, 1, ["k"])
    twice = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k long")
    with pytest.raises(ValueError, match="repeats"):
        prep.split_exact_side(twice, u, 1, ["k"])
    for n in range(5):
        side = prep.split_exact_side(twice, u, n, ["k"]) if n != 1 else None
        assert side is None or side.filter("side = 'test'").count() == n


def test_row_mean_penalty_and_near_equal(fxa):
    plain = _fit(fxa, max_depth=1, alpha=1.0)
    assert _shape(_fit(fxa, max_depth=1, alpha=1.0, penalty="row_mean")) == _shape(plain)  # unit weights
    from missaware.operators.splits import NearEqual

    wide = _fit(fxa, max_depth=1, alpha=0.0, near_equal=NearEqual(0.0, 1e9))
    assert wide.root.is_leaf


def test_checkpointed_base_and_alpha_grid(fxa):
    """A checkpointed base grows the same tree; an alpha grid grows each alpha's tree."""
    plain = _fit(fxa, max_depth=2, alpha=0.1)
    ck = _fit(fxa, max_depth=2, alpha=0.1, checkpoint=True)
    assert _shape(plain) == _shape(ck)
    spec = FeatureSpec.columns(fxa, FEATS)
    grid = fit_forest(fxa, spec, "label", FitParams(max_depth=2, alphas=(0.0, 0.1)))
    assert _shape(grid[1]) == _shape(plain)
    assert _shape(grid[0]) == _shape(_fit(fxa, max_depth=2, alpha=0.0))


def test_fit_with_forced_value_ranges(fxa):
    """The whole fit through the two-phase range scan (every group 'oversized') grows the
    same tree as the single-window scan."""
    assert _shape(_fit(fxa, max_depth=3, alpha=0.1, max_window_bins=5)) == _shape(_fit(fxa, max_depth=3, alpha=0.1))


def test_fold_alpha_trees_equal_separate_fits(fxa):
    """Every (fold, alpha) tree of the joint sweep equals a separate fit on that fold's
    training rows, and its held-out accuracy and reliance match."""
    from missaware.operators import scoring
    from missaware.plans.experiment import fold_alpha_trees

    df = fxa.withColumn("fold", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 3).cast("int"))
    got = {(r["fold"], r["alpha"]): r for r in fold_alpha_trees(df, FEATS, "fold", 3, [0.0, 1.0], 2).collect()}
    assert len(got) == 6
    for f, a in [(0, 0.0), (2, 1.0)]:
        m = _fit(df.filter(F.col("fold") != f), max_depth=2, alpha=a)
        test = df.filter(F.col("fold") == f)
        row = test.agg(
            F.avg((scoring.predict_col(m) == F.col("label")).cast("double")).alias("acc"),
            F.avg(scoring.reliance_col(m).cast("double")).alias("rho"),
        ).first()
        assert abs(got[(f, a)]["accuracy"] - row["acc"]) < 1e-12
        assert abs(got[(f, a)]["rho"] - row["rho"]) < 1e-12


def test_bin_edges_are_exact_at_any_size(spark):
    import math

    from missaware.operators import binning

    n = 150_000
    long_df = spark.range(n).selectExpr("0 AS _f", "CAST(pmod(id * 7919, 150000) AS DOUBLE) AS _v")
    cuts = binning.quantile_cuts(long_df, 7).first()["_cuts"]
    assert cuts == [math.ceil(i * n / 7) - 1.0 for i in range(1, 7)] + [math.inf] * 2


def test_many_trees_score_as_few(fxa, monkeypatch):
    """Forests beyond the stepped ones are walked by one expression: equal scores, a plan that does not grow by columns."""
    from missaware.plans.model import ForestModel

    trees = fit_forest(fxa, FeatureSpec.columns(fxa, FEATS), "label", FitParams(max_depth=3, alpha=0.1, bins=8), n_trees=5, bootstrap=True, key_cols=fx.FX_A_KEYS)
    forest, columns = ForestModel(trees), dict(probability="q", rho="r", votes="v")
    want = sorted(map(str, scoring.forest_transform(fxa, forest, **columns).collect()))
    rho = scoring.forest_reliance(fxa, forest).first()["rho"]
    monkeypatch.setattr(scoring, "STEPPED_TREES", 2)
    assert sorted(map(str, scoring.forest_transform(fxa, forest, **columns).collect())) == want
    assert abs(scoring.forest_reliance(fxa, forest).first()["rho"] - rho) < 1e-12
    assert scoring.forest_transform(fxa, forest, prediction=None, rho="r").columns == [*fxa.columns, "r"]
