"""Physical plans keep the properties the design relies on at scale."""

from pyspark.sql import functions as F

from missaware.catalog import fixtures as fx
from missaware.catalog import fxmodel as fm
from missaware.operators import scoring, splits
from missaware.plans import tree as T

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_search_plan(spark):
    df = fx.fx_a_prepared(spark, SF_SMALL)
    plan = _plan(splits.search(df, fx.FX_A_FEATURES, 2, alpha=0.1))
    assert "EvalPython" not in plan  # no Python UDFs
    assert plan.count("HashAggregate") >= 2  # partial (map side) and final histogram aggregate
    assert "Window" in plan
    # the scan reads only the columns the fixture needs
    assert "l_shipdate" not in plan and "l_returnflag" not in plan


def test_scoring_is_one_narrow_projection(spark):
    df = fx.fx_a_prepared(spark, SF_SMALL)
    m = fm.fx_m()
    scored = df.select(scoring.predict_col(m).alias("p"), scoring.reliance_col(m).alias("r"))
    plan = _plan(scored)
    assert "EvalPython" not in plan and "Exchange" not in plan
    from missaware.plans.model import ForestModel

    forest = _plan(df.select("*", scoring.forest_predict_col(ForestModel([m] * 5)), scoring.forest_reliance_col(ForestModel([m] * 5))))
    assert "EvalPython" not in forest and "Exchange" not in forest and "Join" not in forest
    matrix = _plan(scoring.reliance_matrix(df, m, fx.FX_A_KEYS))
    assert "Exchange" not in matrix and "Aggregate" not in matrix


def _deep_tree(depth):
    from missaware.plans.model import TreeModel

    inner = {n: (fx.FX_A_FEATURES[n % 4], float(n % 7)) for n in range(1, 2**depth)}
    leaves = {n: [float(n % 2), float(1 - n % 2)] for n in range(2**depth, 2 ** (depth + 1))}
    return TreeModel.literal(fx.FX_A_FEATURES, inner, leaves)


def test_the_walk_is_generated_code(spark):
    from missaware.plans.model import ForestModel

    df = fx.fx_a_prepared(spark, SF_SMALL)
    for m in (fm.fx_m(), _deep_tree(10)):
        plan = _plan(scoring.transform(df, m, probability="q", leaf="l", rho="r"))
        steps = [line.strip() for line in plan.split("\n") if "Project" in line]
        assert len(steps) >= m.max_depth and all("*(1) Project" in line for line in steps)
        assert "lambdafunction" not in plan and "Exchange" not in plan
    forest = _plan(scoring.forest_transform(df, ForestModel([fm.fx_m()] * 5), probability="q", rho="r", votes="v"))
    assert "lambdafunction" not in forest and "Exchange" not in forest and "Join" not in forest
    for long in (scoring.decision_path(df, fm.fx_m(), fx.FX_A_KEYS), scoring.reliance_matrix(df, fm.fx_m(), fx.FX_A_KEYS)):
        assert "lambdafunction" not in _plan(long) and "Exchange" not in _plan(long)


def test_a_filter_on_a_score_does_not_copy_the_steps(spark):
    df = fx.fx_a_prepared(spark, SF_SMALL)
    plain = scoring.transform(df, _deep_tree(8), rho="r")
    kept = plain.filter("prediction = 1 and r = 0")
    assert len(_plan(kept)) < 1.2 * len(_plan(plain))
    rows = [r for r in plain.collect() if r["prediction"] == 1 and r["r"] == 0]
    assert sorted(map(str, rows)) == sorted(map(str, kept.collect()))


def test_walk_and_expression_agree(spark):
    df = fx.fx_a_prepared(spark, SF_SMALL)
    m = _deep_tree(5)
    both = scoring.transform(df, m, probability="q", leaf="l", rho="r").select(
        "prediction", "q", "l", "r", scoring.predict_col(m).alias("p2"), scoring.proba_col(m).alias("q2"), scoring.leaf_col(m).alias("l2"), scoring.reliance_col(m).alias("r2")
    )
    assert both.filter("not (prediction <=> p2 and q <=> q2 and l <=> l2 and r <=> r2)").count() == 0


def test_building_a_split_search_runs_no_job(spark):
    sc = spark.sparkContext
    df = fx.fx_a_prepared(spark, SF_SMALL)
    sc.setJobGroup("build-only", "no job")
    splits.search(df, fx.FX_A_FEATURES, 2, alpha=0.1)
    assert list(sc.statusTracker().getJobIdsForGroup("build-only")) == []
    sc.setJobGroup("other", "")


def test_forest_routing_needs_no_join(spark, monkeypatch):
    df = fx.fx_a_prepared(spark, SF_SMALL)
    spec = T.FeatureSpec.columns(df, fx.FX_A_FEATURES)
    plans = []
    orig = splits.best_split

    def spy(pc, keys, criterion, k):
        best = orig(pc, keys, criterion, k)
        plans.append(_plan(best))
        return best

    monkeypatch.setattr(T.splits, "best_split", spy)
    T.fit_forest(df, spec, "label", T.FitParams(max_depth=2, alpha=0.1), n_trees=3, bootstrap=True, key_cols=fx.FX_A_KEYS)
    assert len(plans) == 2
    assert "Join" not in plans[1] and "EvalPython" not in plans[1] and "lambdafunction" not in plans[1]
