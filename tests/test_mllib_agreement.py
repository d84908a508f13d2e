"""With alpha 0 the penalty vanishes: on low-cardinality features (all distinct values are
split candidates in both) the tree partitions the rows like MLlib's DecisionTreeClassifier."""

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from missaware.catalog import fixtures as fx
from missaware.operators import scoring
from missaware.plans.tree import FeatureSpec, FitParams, fit_tree

from conftest import SF_SMALL


def test_alpha_zero_partitions_like_mllib(spark):
    feats = ["discount", "tax"]
    df = fx.fx_a_prepared(spark, SF_SMALL).select(*feats, "label").cache()
    ours = fit_tree(df, FeatureSpec.columns(df, feats), "label", FitParams(max_depth=3, alpha=0.0))
    vec = VectorAssembler(inputCols=feats, outputCol="features").transform(df)
    mllib = DecisionTreeClassifier(maxDepth=3, maxBins=64, impurity="gini", leafCol="mleaf", seed=0).fit(vec)
    both = mllib.transform(vec).select(scoring.leaf_col(ours).alias("leaf"), "mleaf")
    pairs = both.distinct().collect()
    # every one of our leaves lies inside one MLlib leaf: the same cuts, where MLlib only
    # prunes sibling leaves that predict the same class
    ours_to_mllib = {}
    for r in pairs:
        ours_to_mllib.setdefault(r["leaf"], set()).add(r["mleaf"])
    assert all(len(v) == 1 for v in ours_to_mllib.values())
    assert mllib.numNodes <= len(ours.nodes)
    acc_ours = df.agg(F.avg((scoring.predict_col(ours) == F.col("label")).cast("double"))).first()[0]
    acc_mllib = mllib.transform(vec).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert abs(acc_ours - acc_mllib) < 1e-12
