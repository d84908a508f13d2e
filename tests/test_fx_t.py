"""FX_T: expected splits, accuracy and reliance worked out by hand."""

import pytest
from pyspark.sql import functions as F

from missaware import MissAwareTreeClassifier
from missaware.operators import scoring
from missaware.plans.tree import FeatureSpec, FitParams, fit_tree


def _fit(df, alpha, depth):
    return fit_tree(df, FeatureSpec.columns(df, ["a", "b"]), "label", FitParams(max_depth=depth, alpha=alpha))


def _acc_rho(df, model):
    row = df.agg(
        F.avg((scoring.predict_col(model) == F.col("label")).cast("double")).alias("acc"),
        F.avg(scoring.reliance_col(model).cast("double")).alias("rho"),
    ).first()
    return row["acc"], row["rho"]


@pytest.mark.parametrize("alpha,score", [(0.0, 0.0), (0.1, -0.025)])
def test_low_alpha_uses_a(fx_t, alpha, score):
    m = _fit(fx_t, alpha, 1)
    root = m.root
    assert m.features[root.feature_idx] == "a"
    assert root.threshold == 3.0
    assert root.score == pytest.approx(score)
    assert root.missing_share == pytest.approx(0.25)
    assert _acc_rho(fx_t, m) == (1.0, 0.25)


def test_high_alpha_avoids_a(fx_t):
    m = _fit(fx_t, 0.9, 1)
    assert m.features[m.root.feature_idx] == "b"
    # b <= 4 and b <= 6.5 both score -0.2: the smallest threshold wins
    assert m.root.threshold == 4.0
    assert m.root.score == pytest.approx(-0.2)
    assert _acc_rho(fx_t, m) == (7 / 8, 0.0)


def test_depth_two(fx_t):
    m = _fit(fx_t, 0.9, 2)
    assert m.features[m.root.feature_idx] == "b" and m.root.threshold == 4.0
    assert m.nodes[2].is_leaf and m.nodes[2].prediction == 0
    n3 = m.nodes[3]
    assert m.features[n3.feature_idx] == "a" and n3.threshold == 2.5
    assert m.nodes[6].prediction == 0 and m.nodes[7].prediction == 1
    assert _acc_rho(fx_t, m) == (1.0, 1 / 8)


def test_exact_tie_goes_to_first_feature(fx_t):
    """At node b > 4 with alpha 1, a <= 2.5 and b <= 6.5 tie at -0.2 (in exact arithmetic)."""
    m = _fit(fx_t, 1.0, 2)
    n3 = m.nodes[3]
    assert m.features[n3.feature_idx] == "a"
    assert n3.score == pytest.approx(-0.2)


def test_estimator_api(fx_t):
    model = MissAwareTreeClassifier(featureCols=["a", "b"], maxDepth=2, alpha=0.9).fit(fx_t)
    out = model.transform(fx_t).select("prediction", "probability", "rho").collect()
    assert [r["prediction"] for r in out] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert all(abs(sum(r["probability"]) - 1.0) < 1e-12 for r in out)
    assert model.reliance(fx_t).first()["rho"] == pytest.approx(1 / 8)


def test_feature_discovery(fx_t):
    model = MissAwareTreeClassifier(maxDepth=1, alpha=0.0).fit(fx_t.drop("k"))
    assert model.model.features == ["a", "b"]


def test_pure_root_is_leaf(fx_t):
    m = _fit(fx_t.filter(F.col("label") == 0), 0.0, 3)
    assert list(m.nodes) == [1] and m.root.is_leaf and m.root.prediction == 0


def test_reliance_empty_and_masked(fx_t):
    m = _fit(fx_t, 0.0, 1)
    assert scoring.reliance(fx_t.filter(F.lit(False)), m).first()["rho"] == 0.0
    # only rows 1..4 counted, denominator stays 8: rows 2 and 4 rely on a
    r = scoring.reliance(fx_t, m, sample_mask=F.col("k") <= 4).first()["rho"]
    assert r == pytest.approx(2 / 8)


def test_reliance_null_value_stops(spark, fx_t):
    """Without imputation a null tested value adds that node's flag and stops."""
    m = _fit(fx_t, 0.0, 1)
    raw = fx_t.withColumn("a", F.when(F.col("missing_a") == 1, None).otherwise(F.col("a")))
    rows = raw.select("k", scoring.reliance_col(m).alias("r")).orderBy("k").collect()
    assert [r["r"] for r in rows] == [0, 1, 0, 1, 0, 0, 0, 0]


def test_invalid_params():
    with pytest.raises(ValueError):
        FitParams(criterion="entropy").validate()
    with pytest.raises(ValueError):
        FitParams(max_depth=0).validate()
    with pytest.raises(ValueError):
        FitParams(alpha=-1.0).validate()


def test_labels_must_be_0_to_k(spark, fx_t):
    bad = fx_t.withColumn("label", F.col("label") + 1)
    with pytest.raises(ValueError):
        _fit(bad, 0.0, 1)


def test_scoring_needs_model_features(spark, fx_t):
    from pyspark.errors import AnalysisException

    m = _fit(fx_t, 0.0, 1)
    with pytest.raises(AnalysisException):
        fx_t.drop("a").select(scoring.predict_col(m)).collect()


def test_pipeline_and_mllib_names(fx_t):
    from pyspark.ml import Pipeline

    from missaware.operators import prep

    arr = prep.assemble(fx_t, ["a", "b"], out="features", mask_out="missing")
    clf = MissAwareTreeClassifier(featuresCol="features", missingnessCol="missing", impurity="entropy",
                                  maxDepth=2, alpha=0.9, missingnessRelianceCol="reliance", probabilityCol="")
    model = Pipeline(stages=[clf]).fit(arr)
    out = model.transform(arr)
    assert "reliance" in out.columns and "probability" not in out.columns
    assert out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] == 1.0


def test_merge_equal_siblings():
    from missaware.plans.model import TreeModel
    from missaware.plans.tree import merge_equal_siblings

    m = TreeModel.literal(
        ["a", "b"],
        {1: ("a", 3.0), 2: ("b", 4.0), 3: ("b", 6.5)},
        {4: [0.5, 0.5], 5: [0.5, 0.5], 6: [0.0, 1.0], 7: [1.0, 0.0]},
    )
    # node 2's children have equal class shares: node 2 becomes a leaf; node 3 keeps its split
    m.nodes[2].class_weights, m.nodes[2].weight = [1.0, 1.0], 2.0
    merge_equal_siblings(m)
    assert sorted(m.nodes) == [1, 2, 3, 6, 7]
    assert m.nodes[2].is_leaf and m.nodes[2].probability == [0.5, 0.5]
    assert not m.nodes[3].is_leaf


def test_models_save_and_load(spark, fx_t, tmp_path):
    """Vectors in, a saved Pipeline and forest out; MLlib evaluators read the prediction."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    from missaware import MissAwareForestClassifier
    from missaware.plans.estimators import ForestClassifierModel

    stages = [
        VectorAssembler(inputCols=["a", "b"], outputCol="features"),
        VectorAssembler(inputCols=["missing_a", "missing_b"], outputCol="missing"),
        MissAwareTreeClassifier(featuresCol="features", missingnessCol="missing", maxDepth=2, alpha=0.9),
    ]
    model = Pipeline(stages=stages).fit(fx_t)
    out = model.transform(fx_t)
    assert dict(out.dtypes)["prediction"] == "double" and dict(out.dtypes)["features"] == "vector"
    assert MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy").evaluate(out) == 1.0
    model.write().overwrite().save(f"{tmp_path}/pipeline")
    again = PipelineModel.load(f"{tmp_path}/pipeline").transform(fx_t)
    cols = ["k", "prediction", "probability", "rho"]
    assert sorted(out.select(cols).collect()) == sorted(again.select(cols).collect())

    forest = MissAwareForestClassifier(numTrees=3, maxDepth=2, keyCols=["k"], featureCols=["a", "b"]).fit(fx_t)
    scored = forest.transform(fx_t)
    assert {"prediction", "probability", "rho"} <= set(scored.columns)
    forest.save(f"{tmp_path}/forest")
    loaded = ForestClassifierModel.load(f"{tmp_path}/forest")
    assert sorted(scored.select(cols).collect()) == sorted(loaded.transform(fx_t).select(cols).collect())
    with pytest.raises(ValueError, match="impurity"):
        MissAwareTreeClassifier(impurity="variance")


# fixed values: thirty credit decisions (credit_age, income, full_time, part_time, student, credit_approved)
CREDIT = """
25,50000,1,,,1  42,80000,,1,,0  35,60000,1,,,1  29,45000,,,,0  48,90000,1,,,1  33,55000,1,,,1  40,70000,,1,,0  22,35000,,,1,0
45,85000,1,,,1  30,40000,,,,0  31,65000,1,,,1  28,48000,,1,,0  50,95000,1,,,1  37,52000,,,,0  41,68000,,1,,1  26,56000,,,1,0
39,72000,1,,,1  34,47000,,1,,0  47,88000,,,,1  32,41000,,,1,0  27,53000,1,,,1  44,77000,,1,,0  36,62000,,,,1  49,91000,1,,,0
38,57000,,,1,1  43,81000,1,,,0  46,84000,,1,,1  21,34000,,,,0  23,36000,,,1,1  24,39000,1,,,0
"""


@pytest.mark.parametrize("alpha", [0.0, 0.001, 0.01, 0.1, 1.0])
def test_credit_tree(spark, alpha):
    """A known depth-3 tree over thirty rows, mean imputed; the same for every alpha, as only the two
    features without nulls can split."""
    from missaware.operators import prep

    names = ["credit_age", "income", "full_time", "part_time", "student"]
    rows = [[float(v) if v else None for v in r.split(",")] for r in CREDIT.split()]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "label"]))
    m = _fit_on(prep.prepare(raw, names, impute="mean"), names, alpha)
    found = {k: (m.feature_name(n.feature_idx), n.threshold) for k, n in m.nodes.items() if not n.is_leaf}
    assert found == {1: ("income", 49000.0), 2: ("credit_age", 23.5), 4: ("credit_age", 22.5), 3: ("credit_age", 36.5), 6: ("credit_age", 26.5), 7: ("credit_age", 44.5)}
    # the leaf of two rows and both classes (node 12) is a tie, which goes to the smallest label
    assert {k: n.prediction for k, n in m.nodes.items() if n.is_leaf} == {5: 0, 8: 0, 9: 1, 12: 0, 13: 1, 14: 0, 15: 1}


def _fit_on(df, names, alpha):
    return fit_tree(df, FeatureSpec.columns(df, names), "label", FitParams(max_depth=3, alpha=alpha))
