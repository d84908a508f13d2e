"""Queries: split search and tree / forest fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missaware.catalog import fixtures as fx
from missaware.catalog import sqlsplit as sq
from missaware.catalog.registry import query
from missaware.operators import scoring, splits
from missaware.plans import experiment
from missaware.plans.model import ForestModel
from missaware.plans.tree import FeatureSpec, FitParams, fit_forest
from missaware.session import table

ALPHA = 0.1


def node_output(spark, models) -> DataFrame:
    nt = ForestModel(models).node_table(spark)
    return nt.select(
        F.col("tree").cast("bigint").alias("tree"),
        F.col("node").cast("bigint").alias("node"),
        F.col("depth").cast("bigint").alias("depth"),
        "feature",
        "threshold",
        F.col("n").cast("bigint").alias("n"),
        "weight",
        F.col("prediction").cast("bigint").alias("prediction"),
        F.round("score", 6).alias("score"),
        F.round("missing_share", 6).alias("missing_share"),
        "is_leaf",
    )


def _fit(spark, df, features, params, weight=None, **kw):
    spec = FeatureSpec.columns(df, features)
    return node_output(spark, fit_forest(df, spec, "label", params, weight=weight, **kw))


def split_output(best: DataFrame, features: list[str]) -> DataFrame:
    return best.select(
        F.col("_n").cast("bigint").alias("node"),
        splits.feature_name(features).alias("feature"),
        F.col("_thr").alias("threshold"),
        F.round("_ps", 6).alias("score"),
        F.round("_share", 6).alias("missing_share"),
        F.col("_nl").cast("bigint").alias("n_left"),
        F.col("_nr").cast("bigint").alias("n_right"),
    )


SPLIT_OUT_SQL = (
    "SELECT CAST(node AS BIGINT) AS node, fname AS feature, thr AS threshold, round(ps, 6) AS score, "
    "round(share, 6) AS missing_share, CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right FROM best"
)


def _search_sql(prep_sql, features, k, alpha, criterion="gini", per_feature=False, weight="1.0"):
    return (
        f"WITH prep AS ({prep_sql}),\n"
        + sq.chain("prep", features, k, alpha, criterion, weight=weight, per_feature=per_feature)
        + "\n"
        + SPLIT_OUT_SQL
    )


# ---- split search ------------------------------------------------------------------------

@query("best_split", oracle=_search_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA))
def best_split(spark, sf_dir):
    """Which feature and cut best separates the label while avoiding missing values?"""
    df = fx.fx_a_prepared(spark, sf_dir)
    return split_output(splits.search(df, fx.FX_A_FEATURES, 2, alpha=ALPHA), fx.FX_A_FEATURES)


@query("best_split_per_feature", oracle=_search_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, per_feature=True))
def best_split_per_feature(spark, sf_dir):
    df = fx.fx_a_prepared(spark, sf_dir)
    best = splits.search(df, fx.FX_A_FEATURES, 2, alpha=ALPHA, per_feature=True)
    return split_output(best, fx.FX_A_FEATURES)


# ---- fitting -----------------------------------------------------------------------------

@query("fit_stump", oracle=sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 1))
def fit_stump(spark, sf_dir):
    return _fit(spark, fx.fx_a_prepared(spark, sf_dir), fx.FX_A_FEATURES, FitParams(max_depth=1, alpha=ALPHA))


@query("fit_tree_d2", oracle=sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 2))
def fit_tree_d2(spark, sf_dir):
    return _fit(spark, fx.fx_a_prepared(spark, sf_dir), fx.FX_A_FEATURES, FitParams(max_depth=2, alpha=ALPHA))


@query("fit_tree_d3", oracle=sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 3))
def fit_tree_d3(spark, sf_dir):
    return _fit(spark, fx.fx_a_prepared(spark, sf_dir), fx.FX_A_FEATURES, FitParams(max_depth=3, alpha=ALPHA))


@query("fit_stump_entropy", oracle=sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 1, criterion="info_gain"))
def fit_stump_entropy(spark, sf_dir):
    params = FitParams(max_depth=1, alpha=ALPHA, criterion="info_gain")
    return _fit(spark, fx.fx_a_prepared(spark, sf_dir), fx.FX_A_FEATURES, params)


@query("fit_weighted_stump", oracle=sq.fit_sql(fx.FX_C_PREP_SQL, fx.FX_C_FEATURES, 2, ALPHA, 1, weight="sample_weight"))
def fit_weighted_stump(spark, sf_dir):
    df = fx.fx_c_prepared(spark, sf_dir)
    return _fit(spark, df, fx.FX_C_FEATURES, FitParams(max_depth=1, alpha=ALPHA), weight="sample_weight")


@query("fit_stump_multiclass", oracle=sq.fit_sql(fx.FX_B_PREP_SQL, fx.FX_B_FEATURES, 3, ALPHA, 1))
def fit_stump_multiclass(spark, sf_dir):
    return _fit(spark, fx.fx_b_prepared(spark, sf_dir), fx.FX_B_FEATURES, FitParams(max_depth=1, alpha=ALPHA))


@query("fit_tree_multiclass_d2", oracle=sq.fit_sql(fx.FX_B_PREP_SQL, fx.FX_B_FEATURES, 3, ALPHA, 2))
def fit_tree_multiclass_d2(spark, sf_dir):
    return _fit(spark, fx.fx_b_prepared(spark, sf_dir), fx.FX_B_FEATURES, FitParams(max_depth=2, alpha=ALPHA))


_CONST_PREP_SQL = f"SELECT *, CAST(1.0 AS DOUBLE) AS const_one, 0 AS missing_const_one FROM ({fx.FX_A_PREP_SQL}) q"


@query("fit_constant_features", oracle=sq.fit_sql(_CONST_PREP_SQL, ["const_one"], 2, ALPHA, 2))
def fit_constant_features(spark, sf_dir):
    """Only a constant feature: no usable cut, so the root stays a leaf."""
    df = fx.fx_a_prepared(spark, sf_dir).withColumn("const_one", F.lit(1.0))
    return _fit(spark, df, ["const_one"], FitParams(max_depth=2, alpha=ALPHA))


# ---- alpha re-ranks features ---------------------------------------------------------------

ALPHA_FLIP_GRID = [0.0, 0.5, 0.8, 0.9, 1.0]
ALPHA_SWEEP_GRID = [0.0, 0.001, 0.01, 0.1, 1.0]


def _grid_sql(alphas) -> str:
    return "(VALUES " + ", ".join(f"({sq.lit(a)})" for a in alphas) + ") AS g(alpha)"


def _alpha_sql(alphas) -> str:
    base = (
        f"WITH prep AS ({fx.FX_A_PREP_SQL}),\n"
        + sq.chain("prep", fx.FX_A_FEATURES, 2, 0.0, per_feature=True)
    )
    return (
        base
        + f", ranked AS (SELECT b.*, g.alpha, b.s - g.alpha * b.share AS ps2, row_number() OVER (PARTITION BY g.alpha "
        "ORDER BY round(b.s - g.alpha * b.share, 12) DESC, b.f ASC, b.thr ASC) AS rk2 FROM best b, "
        + _grid_sql(alphas)
        + ") SELECT alpha, fname AS feature, thr AS threshold, round(ps2, 6) AS score, round(share, 6) AS missing_share "
        "FROM ranked WHERE rk2 = 1"
    )


def _alpha_query(alphas):
    def fn(spark, sf_dir):
        df = fx.fx_a_prepared(spark, sf_dir)
        spec = FeatureSpec.columns(df, fx.FX_A_FEATURES)
        rows = df.select(*spec.base_cols(), F.col("label").cast("int").alias("_y"), F.lit(1.0).alias("_w"),
                         F.lit(0).alias("_t"), F.lit(1).cast("bigint").alias("_n"))
        best = experiment.per_feature_best(rows, spec, 2)
        won = experiment.apply_alpha_grid(best, alphas)
        return won.select(
            "alpha",
            splits.feature_name(fx.FX_A_FEATURES).alias("feature"),
            F.col("_thr").alias("threshold"),
            F.round("_ps", 6).alias("score"),
            F.round("_share", 6).alias("missing_share"),
        )

    return fn


query("alpha_flip", oracle=_alpha_sql(ALPHA_FLIP_GRID))(_alpha_query(ALPHA_FLIP_GRID))
query("alpha_sweep_root", oracle=_alpha_sql(ALPHA_SWEEP_GRID))(_alpha_query(ALPHA_SWEEP_GRID))


# ---- bootstrap and forests ----------------------------------------------------------------
N_TREES = 3
# fixed values: P(X <= k) of Poisson(1), k = 0 .. 9; the draws of FX_F are multiples of 1 / 2147483,
# so no draw reaches the next value
CDF = [
    0.36787944117144233, 0.73575888234288464, 0.91969860292860584, 0.98101184312384626,
    0.99634015317265634, 0.99940581518241839, 0.99991675885071196, 0.99998975080332538,
    0.99999887479740206, 0.99999988857452168,
]


def _count_sql(u: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} >= {c!r} THEN 1 ELSE 0 END" for c in CDF) + ")"


def _trees_sql(n_trees: int) -> str:
    return (
        f"SELECT * FROM (SELECT p.*, CAST(r.t AS INTEGER) AS t, CAST({_count_sql(fx.fx_f_u_sql('r.t'))} AS DOUBLE) AS w "
        f"FROM ({fx.FX_A_PREP_SQL}) p, range({n_trees}) r(t)) q WHERE w > 0"
    )


@query(
    "bootstrap_weights",
    oracle=(
        f"SELECT CAST(t AS BIGINT) AS tree, count(*) AS n_rows, CAST(sum(w) AS BIGINT) AS total FROM ({_trees_sql(N_TREES)}) b GROUP BY t"
    ),
)
def bootstrap_weights(spark, sf_dir):
    """Poisson(1) count per (row, tree) from an integer hash: rows drawn and total count."""
    from missaware.operators import forest

    df = fx.fx_a_prepared(spark, sf_dir)
    w = forest.bootstrap_counts(df, N_TREES, fx.fx_f_u)
    return w.groupBy(F.col("_t").cast("bigint").alias("tree")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_count").cast("bigint").alias("total")
    )


def _forest(spark, sf_dir, depth):
    df = fx.fx_a_prepared(spark, sf_dir)
    params = FitParams(max_depth=depth, alpha=ALPHA)
    return _fit(spark, df, fx.FX_A_FEATURES, params, n_trees=N_TREES, bootstrap=True, bootstrap_u=fx.fx_f_u, key_cols=fx.FX_A_KEYS)


@query("fit_forest_stumps", oracle=sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 1, trees_sql=_trees_sql(N_TREES)))
def fit_forest_stumps(spark, sf_dir):
    """Three bootstrap stumps grown together: one histogram job keyed by tree."""
    return _forest(spark, sf_dir, 1)


@query("fit_forest_d2", oracle=sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 2, trees_sql=_trees_sql(N_TREES)))
def fit_forest_d2(spark, sf_dir):
    return _forest(spark, sf_dir, 2)


ARRAY_BINS, ARRAY_SIZE = 16, 64


def _binned_array_sql(depth: int) -> str:
    """Embedding positions as columns p0 .. p63: masked cells 0, then each value's bin edge (the
    smallest value at a rank i / 16 that is not below it)."""
    shares = ", ".join(repr(i / ARRAY_BINS) for i in range(1, ARRAY_BINS))
    flag = "CASE WHEN (vec_id * 7 + {i} * 13) % 100 < 5 + ({i} * 3) % 35 THEN 1 ELSE 0 END"
    flags = ", ".join(f"{flag.format(i=i)} AS missing_p{i}" for i in range(ARRAY_SIZE))
    values = ", ".join(f"CASE WHEN {flag.format(i=i)} = 1 THEN CAST(0.0 AS DOUBLE) ELSE CAST(embedding[{i + 1}] AS DOUBLE) END AS v{i}" for i in range(ARRAY_SIZE))
    cuts = ", ".join(f"list_sort(list_distinct(quantile_disc(v{i}, [{shares}]))) AS c{i}" for i in range(ARRAY_SIZE))
    edges = ", ".join(f"coalesce(list_filter(c{i}, lambda x: x >= v{i})[1], CAST('inf' AS DOUBLE)) AS p{i}" for i in range(ARRAY_SIZE))
    masks = ", ".join(f"missing_p{i}" for i in range(ARRAY_SIZE))
    prep = f"WITH v AS (SELECT label, {flags}, {values} FROM embeddings), c AS (SELECT {cuts} FROM v) SELECT label, {masks}, {edges} FROM v, c"
    fit = sq.fit_sql(prep, [f"p{i}" for i in range(ARRAY_SIZE)], 10, ALPHA, depth, threshold="value")
    return f"SELECT * REPLACE ('embedding[' || substr(feature, 2) || ']' AS feature) FROM ({fit}) q"


@query("fit_binned_array", oracle=_binned_array_sql(3))
def fit_binned_array(spark, sf_dir):
    """Array features (64 embedding positions with masks), 16 quantile bins, ten classes."""
    df = fx.fx_d(spark, sf_dir)
    spec = FeatureSpec.array(df, "embedding", "missing")
    params = FitParams(max_depth=3, alpha=ALPHA, bins=ARRAY_BINS)
    return node_output(spark, fit_forest(df, spec, "label", params))


# y tells the label, x tells nothing: each (x, label) combination occurs once per order line
_MERGE_SQL = (
    "SELECT CAST(l_quantity > 25 AS DOUBLE) AS y, CAST(xs.x AS DOUBLE) AS x, 0 AS missing_x, 0 AS missing_y, "
    "CASE WHEN l_quantity > 25 THEN 1 - ls.lab ELSE ls.lab END AS label "
    "FROM lineitem, (VALUES (0), (1)) AS xs(x), (VALUES (0), (1), (1)) AS ls(lab)"
)


@query("merge_siblings", oracle=sq.fit_sql(_MERGE_SQL, ["x", "y"], 2, ALPHA, 1))
def merge_siblings(spark, sf_dir):
    """A depth-2 tree whose lower splits change nothing: with equal siblings merged it is the
    depth-1 tree (7 nodes become 3)."""
    li = table(spark, sf_dir, "lineitem")
    high = F.col("l_quantity") > 25
    df = li.select(high.alias("high"), F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("x")).select("high", "x", F.explode(F.array(F.lit(0), F.lit(1), F.lit(1))).alias("lab"))
    df = df.select(high_as_double(), "x", F.lit(0).alias("missing_x"), F.lit(0).alias("missing_y"), F.when(F.col("high"), 1 - F.col("lab")).otherwise(F.col("lab")).alias("label"))
    return _fit(spark, df, ["x", "y"], FitParams(max_depth=2, alpha=ALPHA, merge_equal_siblings=True))


def high_as_double():
    return F.col("high").cast("int").cast("double").alias("y")


_FRACTION = "(0.25 + 0.5 * (l_linenumber % 4))"


@query("fit_weighted_d2", oracle=sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, ALPHA, 2, weight=_FRACTION))
def fit_weighted_d2(spark, sf_dir):
    """Fractional row weights below the root."""
    df = fx.fx_a_prepared(spark, sf_dir).withColumn("sample_weight", 0.25 + 0.5 * (F.col("l_linenumber") % 4))
    return _fit(spark, df, fx.FX_A_FEATURES, FitParams(max_depth=2, alpha=ALPHA), weight="sample_weight")


@query("fit_entropy_d2_multiclass", oracle=sq.fit_sql(fx.FX_B_PREP_SQL, fx.FX_B_FEATURES, 3, ALPHA, 2, criterion="info_gain"))
def fit_entropy_d2_multiclass(spark, sf_dir):
    """Entropy, three classes, depth 2."""
    return _fit(spark, fx.fx_b_prepared(spark, sf_dir), fx.FX_B_FEATURES, FitParams(max_depth=2, alpha=ALPHA, criterion="info_gain"))


RAW_FEATURES = ["l_extendedprice", "l_discount"]
_RAW_SQL = (
    "SELECT l_extendedprice, l_discount, 0 AS missing_l_extendedprice, 0 AS missing_l_discount, "
    "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label FROM lineitem"
)


def _routed_sql(depth: int) -> str:
    """Rows per leaf by sending every row down the fitted splits, not by the histogram's sums."""
    tree = sq.fit_sql(_RAW_SQL, RAW_FEATURES, 2, ALPHA, depth)
    steps = "raw0 AS (SELECT *, CAST(1 AS BIGINT) AS leaf FROM (" + _RAW_SQL + ") q)"
    value = "CASE t.feature " + " ".join(f"WHEN '{f}' THEN r.{f}" for f in RAW_FEATURES) + " END"
    for d in range(depth):
        steps += (
            f", raw{d + 1} AS (SELECT r.* EXCLUDE (leaf), CASE WHEN t.is_leaf THEN r.leaf WHEN {value} <= t.threshold THEN 2 * r.leaf ELSE 2 * r.leaf + 1 END AS leaf "
            f"FROM raw{d} r JOIN tree t ON r.leaf = t.node)"
        )
    return f"WITH tree AS ({tree}), {steps} SELECT leaf AS node, count(*) AS n_routed, any_value(t.n) AS n FROM raw{depth} r JOIN tree t ON r.leaf = t.node GROUP BY leaf"


@query("fit_tree_raw", oracle=_routed_sql(3))
def fit_tree_raw(spark, sf_dir):
    """Depth 3 on raw prices: the rows that reach each leaf against the fitted counts."""
    df = table(spark, sf_dir, "lineitem").select(*RAW_FEATURES, (F.col("l_quantity") > 25).cast("int").alias("label"))
    model = fit_forest(df, FeatureSpec.columns(df, RAW_FEATURES), "label", FitParams(max_depth=3, alpha=ALPHA))[0]
    routed = df.groupBy(scoring.leaf_col(model).alias("node")).agg(F.count(F.lit(1)).alias("n_routed"))
    fitted = model.node_table(spark).select("node", F.col("n").cast("bigint").alias("n"))
    return routed.join(fitted, "node").select("node", "n_routed", "n")


# ---- evaluation and sweeps ------------------------------------------------------------------

def _value_of(features, prefix="p.", name="w.fname"):
    return f"CASE {name} " + " ".join(f"WHEN '{f}' THEN {prefix}{f}" for f in features) + " END"


def _evaluate_sql() -> str:
    train = f"SELECT * FROM ({fx.FX_A_PREP_SQL}) q WHERE l_orderkey % 2 = 0"
    test = f"SELECT * FROM ({fx.FX_A_PREP_SQL}) q WHERE l_orderkey % 2 = 1"
    left = sq.argmax_sql(["w.l0", "w.l1"])
    right = sq.argmax_sql(["w.r0", "w.r1"])
    return (
        f"WITH tr AS ({train}), te AS ({test}),\n"
        + sq.chain("tr", fx.FX_A_FEATURES, 2, ALPHA)
        + f", ev AS (SELECT CASE WHEN {_value_of(fx.FX_A_FEATURES)} <= w.thr THEN {left} ELSE {right} END = p.label AS hit, "
        f"{_value_of([f'missing_{f}' for f in fx.FX_A_FEATURES], name='w.fname').replace('WHEN ' + chr(39) + 'missing_', 'WHEN ' + chr(39))} AS miss "
        "FROM te p, best w) "
        "SELECT (SELECT fname FROM best) AS feature, (SELECT thr FROM best) AS threshold, "
        "(SELECT CAST(nl + nr AS BIGINT) FROM best) AS n_train, count(*) AS n_test, "
        "round(avg(CAST(hit AS DOUBLE)), 6) AS accuracy, round(avg(CAST(miss AS DOUBLE)), 6) AS rho FROM ev"
    )


@query("evaluate_stump", oracle=_evaluate_sql())
def evaluate_stump(spark, sf_dir):
    """Fit a stump on even order keys, score accuracy and reliance on odd ones."""
    df = fx.fx_a_prepared(spark, sf_dir)
    train = df.filter(F.col("l_orderkey") % 2 == 0)
    test = df.filter(F.col("l_orderkey") % 2 == 1)
    model, out = experiment.evaluate(train, test, fx.FX_A_FEATURES, FitParams(max_depth=1, alpha=ALPHA))
    root = model.root
    return out.select(
        F.lit(model.feature_name(root.feature_idx)).cast("string").alias("feature"),
        F.lit(root.threshold).cast("double").alias("threshold"),
        F.lit(root.n).cast("bigint").alias("n_train"),
        "n_test",
        F.round("accuracy", 6).alias("accuracy"),
        F.round("rho", 6).alias("rho"),
    )


N_FOLDS = 5
FOLD_SQL = f"(l_orderkey*7 + l_linenumber) % {N_FOLDS}"


def _sweep_sql() -> str:
    left = sq.argmax_sql(["w.l0", "w.l1"])
    right = sq.argmax_sql(["w.r0", "w.r1"])
    masks = "CASE w.fname " + " ".join(f"WHEN '{f}' THEN p.missing_{f}" for f in fx.FX_A_FEATURES) + " END"
    return (
        f"WITH fd AS (SELECT *, {FOLD_SQL} AS fold FROM ({fx.FX_A_PREP_SQL}) q), "
        f"tr AS (SELECT p.*, CAST(r.t AS INTEGER) AS t FROM fd p, range({N_FOLDS}) r(t) WHERE p.fold <> r.t),\n"
        + sq.chain("tr", fx.FX_A_FEATURES, 2, 0.0, per_feature=True, tree="t")
        + ", ranked AS (SELECT b.*, g.alpha, row_number() OVER (PARTITION BY b.t, g.alpha ORDER BY round(b.s - g.alpha * b.share, 12) DESC, "
        + "b.f ASC, b.thr ASC) AS rk2 FROM best b, " + _grid_sql(ALPHA_SWEEP_GRID) + "), "
        "win AS (SELECT * FROM ranked WHERE rk2 = 1), "
        f"ev AS (SELECT w.t, w.alpha, CAST(CASE WHEN {_value_of(fx.FX_A_FEATURES)} <= w.thr THEN {left} ELSE {right} END = p.label AS DOUBLE) AS hit, "
        f"CAST({masks} AS DOUBLE) AS miss FROM fd p JOIN win w ON p.fold = w.t), "
        "per AS (SELECT t, alpha, avg(hit) AS acc, avg(miss) AS rho FROM ev GROUP BY t, alpha) "
        "SELECT alpha, round(avg(acc), 6) AS accuracy_mean, round(stddev_samp(acc), 6) AS accuracy_std, "
        "round(avg(rho), 6) AS rho_mean, round(stddev_samp(rho), 6) AS rho_std, count(*) AS n_runs FROM per GROUP BY alpha"
    )


@query("sweep_summary", oracle=_sweep_sql())
def sweep_summary(spark, sf_dir):
    """alpha grid x 5 key-hash folds: accuracy and reliance mean / spread per alpha."""
    df = fx.fx_a_prepared(spark, sf_dir)
    fold = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % N_FOLDS
    per = experiment.fold_alpha_sweep(df, fx.FX_A_FEATURES, fold.cast("int"), N_FOLDS, ALPHA_SWEEP_GRID)
    out = experiment.sweep_summary(per, ["alpha"])
    return out.select("alpha", *[F.round(c, 6).alias(c) for c in ("accuracy_mean", "accuracy_std", "rho_mean", "rho_std")], "n_runs")


def _alpha_trees_sql(alphas, depth) -> str:
    parts = [
        f"SELECT * EXCLUDE (tree), CAST({i} AS BIGINT) AS tree, {sq.lit(a)} AS alpha "
        f"FROM ({sq.fit_sql(fx.FX_A_PREP_SQL, fx.FX_A_FEATURES, 2, a, depth)}) q{i}"
        for i, a in enumerate(alphas)
    ]
    return "\nUNION ALL ".join(parts)


@query("alpha_sweep_fit", oracle=_alpha_trees_sql(ALPHA_SWEEP_GRID, 2))
def alpha_sweep_fit(spark, sf_dir):
    """A depth-2 tree for every alpha of the grid, all grown in the same per-level jobs."""
    df = fx.fx_a_prepared(spark, sf_dir)
    params = FitParams(max_depth=2, alphas=tuple(ALPHA_SWEEP_GRID))
    models = fit_forest(df, FeatureSpec.columns(df, fx.FX_A_FEATURES), "label", params)
    grid = F.array(*[F.lit(float(a)) for a in ALPHA_SWEEP_GRID])
    out = node_output(spark, models)
    return out.withColumn("alpha", F.element_at(grid, F.col("tree").cast("int") + 1))


def _sweep_trees_sql(depth: int) -> str:
    """Tree ``t`` leaves fold ``t // 5`` out and uses alpha ``t % 5``; each tree scores its own fold."""
    g = len(ALPHA_SWEEP_GRID)
    fold = f"SELECT *, {FOLD_SQL} AS fold FROM ({fx.FX_A_PREP_SQL}) q"
    trees = f"SELECT p.*, CAST(r.t AS INTEGER) AS t, CAST(1.0 AS DOUBLE) AS w FROM ({fold}) p, range({N_FOLDS * g}) r(t) WHERE p.fold <> r.t // {g}"
    alpha = f"(CASE t % {g} " + " ".join(f"WHEN {i} THEN {sq.lit(a)}" for i, a in enumerate(ALPHA_SWEEP_GRID)) + " END)"
    fit = sq.fit_sql(fold, fx.FX_A_FEATURES, 2, alpha, depth, trees_sql=trees)
    walk = sq.walk_sql(fold, fit, fx.FX_A_FEATURES, depth, where=f"p.fold = t.tree // {g}")
    return (
        f"WITH {walk}, per AS (SELECT r.tree, avg(CAST(t.prediction = r.label AS DOUBLE)) AS acc, avg(CAST(r.miss AS DOUBLE)) AS rho "
        f"FROM at{depth} r JOIN nodes t ON r.tree = t.tree AND r.leaf = t.node GROUP BY r.tree) "
        f"SELECT {alpha.replace('t % ', 'tree % ')} AS alpha, round(avg(acc), 6) AS accuracy_mean, round(stddev_samp(acc), 6) AS accuracy_std, "
        "round(avg(rho), 6) AS rho_mean, round(stddev_samp(rho), 6) AS rho_std, count(*) AS n_runs FROM per GROUP BY 1"
    )


@query("alpha_sweep_trees", oracle=_sweep_trees_sql(4))
def alpha_sweep_trees(spark, sf_dir):
    """Depth-4 trees for 5 key-hash folds x the alpha grid, grown as one forest and scored
    on held-out folds; mean and spread of accuracy and reliance per alpha."""
    df = fx.fx_a_prepared(spark, sf_dir)
    df = df.withColumn("fold", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % N_FOLDS).cast("int"))
    per = experiment.fold_alpha_trees(df, fx.FX_A_FEATURES, "fold", N_FOLDS, ALPHA_SWEEP_GRID, 4, partitions=spark.sparkContext.defaultParallelism)
    out = experiment.sweep_summary(per, ["alpha"])
    return out.select("alpha", *[F.round(c, 6).alias(c) for c in ("accuracy_mean", "accuracy_std", "rho_mean", "rho_std")], "n_runs")
