"""Vectors read by their set entries: the same trees and scores as over arrays of all features."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from missaware import MissAwareTreeClassifier
from missaware.operators import scoring
from missaware.plans import tree as T
from missaware.plans.estimators import TreeClassifierModel
from missaware.plans.tree import FeatureSpec, FitParams, fit_forest


def _rows(n, size, seed, filled=0.3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x = {i: float(rng.choice([-2, -1, 1, 2, 3])) for i in range(size) if rng.random() < filled}
        m = {i: 1.0 for i in range(size) if rng.random() < 0.2}
        for i in list(m):
            if rng.random() < 0.7:
                x.pop(i, None)  # most missing values are imputed with 0
        y = int(x.get(0, 0.0) + x.get(2, 0.0) - x.get(1, 0.0) + rng.random() > 0.7)
        make = (lambda d: Vectors.dense([d.get(i, 0.0) for i in range(size)])) if k % 5 == 0 else (lambda d: Vectors.sparse(size, d))
        out.append((k, make(x), make(m), y, float(1 + k % 3)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(400, 12, 3), ["k", "x", "m", "label", "w"]).repartition(4).cache()


def _arrays(df):
    return df.withColumns({"x": vector_to_array("x"), "m": vector_to_array("m").cast("array<int>")})


def _shape(model):
    return sorted((k, n.feature_idx, n.threshold, n.score, n.missing_share, n.n, n.weight, tuple(n.class_weights)) for k, n in model.nodes.items())


@pytest.mark.parametrize("how", [dict(max_depth=4, alpha=0.1), dict(max_depth=3, alpha=1.0, criterion="info_gain"), dict(max_depth=3, alphas=(0.0, 0.5))])
@pytest.mark.parametrize("subtract", [0.0, 1e9])
def test_trees_equal_those_over_arrays(table, monkeypatch, how, subtract):
    monkeypatch.setattr(T, "SPARSE", subtract)
    for weight in (None, "w"):
        dense = fit_forest(_arrays(table), FeatureSpec.array(_arrays(table), "x", "m"), "label", FitParams(**how), weight=weight)
        got = fit_forest(table, FeatureSpec.vectors(table, "x", "m"), "label", FitParams(**how), weight=weight)
        assert [_shape(m) for m in got] == [_shape(m) for m in dense]


def test_scores_equal_those_over_arrays(table):
    m = fit_forest(table, FeatureSpec.vectors(table, "x", "m"), "label", FitParams(max_depth=4, alpha=0.0))[0]
    plain = fit_forest(_arrays(table), FeatureSpec.array(_arrays(table), "x", "m"), "label", FitParams(max_depth=4, alpha=0.0))[0]
    columns = dict(probability="q", leaf="l", rho="r")
    got = scoring.transform(table, m, **columns).select("k", "prediction", "q", "l", "r")
    want = scoring.transform(_arrays(table), plain, **columns).select("k", "prediction", "q", "l", "r")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    cells = scoring.reliance_matrix(table, m, ["k"])
    assert cells.exceptAll(scoring.reliance_matrix(_arrays(table), plain, ["k"])).count() == 0
    both = scoring.transform(table, m, leaf="l", rho="r").select("l", "r", scoring.leaf_col(m).alias("l2"), scoring.reliance_col(m).alias("r2"))
    assert both.filter("l != l2 or r != r2").count() == 0


def test_estimator_reads_entries_and_keeps_the_model(table, tmp_path):
    clf = MissAwareTreeClassifier(featuresCol="x", missingnessCol="m", sparseFeatures=True, maxDepth=3, alpha=0.1)
    model = clf.fit(table)
    dense = MissAwareTreeClassifier(featuresCol="x", missingnessCol="m", maxDepth=3, alpha=0.1).fit(table)
    columns = ["k", "prediction", "probability", "rho"]
    got = model.transform(table)
    assert got.select(columns).exceptAll(dense.transform(table).select(columns)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "lambdafunction" not in plan
    model.write().overwrite().save(str(tmp_path / "m"))
    again = TreeClassifierModel.load(str(tmp_path / "m"))
    assert again.model.sparse and again.transform(table).select(columns).exceptAll(got.select(columns)).count() == 0
    assert abs(again.reliance(table).first()["rho"] - got.agg(F.avg(F.col("rho").cast("double"))).first()[0]) < 1e-12


def test_wrong_vectors_are_refused(spark, table):
    odd = table.unionByName(spark.createDataFrame([(999, Vectors.sparse(5, {1: 1.0}), Vectors.sparse(12, {}), 1, 1.0)], table.schema))
    with pytest.raises(ValueError, match="length"):
        fit_forest(odd, FeatureSpec.vectors(odd, "x", "m"), "label", FitParams(max_depth=1))
    flags = table.withColumn("m", F.col("x"))
    with pytest.raises(ValueError, match="flags"):
        fit_forest(flags, FeatureSpec.vectors(flags, "x", "m"), "label", FitParams(max_depth=1))
    with pytest.raises(ValueError, match="bins"):
        fit_forest(table, FeatureSpec.vectors(table, "x", "m"), "label", FitParams(max_depth=1, bins=8))


def test_a_hundred_thousand_features_with_fifty_set(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        x = {rng.randrange(100_000): rng.random() for _ in range(49)} | ({777: 1.0} if k % 2 else {})
        rows.append((k, Vectors.sparse(100_000, x), k % 2))
    df = spark.createDataFrame(rows, ["k", "x", "label"])
    seen, made = [], T.splits.histogram
    T.splits.histogram = lambda long_df, *a: seen.append(long_df.count()) or made(long_df, *a)
    try:
        m = fit_forest(df, FeatureSpec.vectors(df, "x"), "label", FitParams(max_depth=2, alpha=0.1))[0]
    finally:
        T.splits.histogram = made
    assert m.root.feature_idx == 777 and m.nodes[2].is_leaf and seen == [sum(r[1].numNonzeros() for r in rows)]
