"""Queries: node statistics, histograms, running weights, candidate cuts and their scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from missaware.catalog import fixtures as fx
from missaware.catalog import fxmodel as fm
from missaware.catalog import sqlsplit as sq
from missaware.catalog.registry import query
from missaware.catalog.sqlsplit import lit
from missaware.operators import binning, scoring, splits, stats
from missaware.plans.model import TreeModel

# fixed values: a two-level routing tree over FX_B (nodes 4..7) and over FX_C
B_NODES = TreeModel.literal(
    fx.FX_B_FEATURES,
    {1: ("total_5k", 30.5), 2: ("bal_100", 40.5), 3: ("nation", 9.5)},
    {4: [1.0, 0.0, 0.0], 5: [1.0, 0.0, 0.0], 6: [1.0, 0.0, 0.0], 7: [1.0, 0.0, 0.0]},
)
C_NODES = TreeModel.literal(
    fx.FX_C_FEATURES,
    {1: ("hour_num", 11.5), 2: ("user_num", 50.5), 3: ("user_num", 50.5)},
    {4: [1.0, 0.0], 5: [1.0, 0.0], 6: [1.0, 0.0], 7: [1.0, 0.0]},
)

B_PREP = f"WITH prep AS ({fx.FX_B_PREP_SQL}), nd AS (SELECT *, {fm.leaf_sql(B_NODES)} AS node FROM prep)"
C_PREP = f"WITH prep AS ({fx.FX_C_PREP_SQL}), nd AS (SELECT *, {fm.leaf_sql(C_NODES)} AS node FROM prep)"


def _b(spark, sf_dir):
    return fx.fx_b_prepared(spark, sf_dir)


@query("node_stats", oracle=f"{B_PREP} SELECT node, count(*) AS n, sum(CAST(1.0 AS DOUBLE)) AS weight FROM nd GROUP BY node")
def node_stats(spark, sf_dir):
    return stats.node_stats(_b(spark, sf_dir), scoring.leaf_col(B_NODES))


@query(
    "node_class_weights",
    oracle=f"{B_PREP} SELECT node, label, count(*) AS n, sum(CAST(1.0 AS DOUBLE)) AS weight FROM nd GROUP BY node, label",
)
def node_class_weights(spark, sf_dir):
    return stats.class_weights(_b(spark, sf_dir), scoring.leaf_col(B_NODES))


@query(
    "node_distribution",
    oracle=(
        f"{B_PREP}, cw AS (SELECT node, label, sum(CAST(1.0 AS DOUBLE)) AS weight FROM nd GROUP BY node, label) "
        "SELECT node, label, round(weight / sum(weight) OVER (PARTITION BY node), 6) AS share FROM cw"
    ),
)
def node_distribution(spark, sf_dir):
    cw = stats.class_weights(_b(spark, sf_dir), scoring.leaf_col(B_NODES))
    return stats.distribution(cw).withColumn("share", F.round("share", 6))


_PURE_NODES = TreeModel.literal(
    fx.FX_B_FEATURES,
    {1: ("total_5k", 29.5), 2: ("total_5k", 0.5), 3: ("bal_100", 40.5)},
    {4: [1.0, 0.0, 0.0], 5: [1.0, 0.0, 0.0], 6: [1.0, 0.0, 0.0], 7: [1.0, 0.0, 0.0]},
)


@query(
    "pure_nodes",
    oracle=(
        f"WITH prep AS ({fx.FX_B_PREP_SQL}), nd AS (SELECT *, {fm.leaf_sql(_PURE_NODES)} AS node FROM prep), "
        "cw AS (SELECT node, label, sum(CAST(1.0 AS DOUBLE)) AS weight FROM nd GROUP BY node, label) "
        "SELECT node, count(*) FILTER (WHERE weight > 0) AS n_classes, count(*) FILTER (WHERE weight > 0) <= 1 AS is_pure "
        "FROM cw GROUP BY node"
    ),
)
def pure_nodes(spark, sf_dir):
    """Node 5 (1 < total_5k <= 29.5) holds only class 0: the pure test of the fit's stop rule."""
    return stats.purity(_b(spark, sf_dir), scoring.leaf_col(_PURE_NODES))


@query(
    "majority_leaf",
    oracle=(
        f"{B_PREP}, cw AS (SELECT node, label, sum(CAST(1.0 AS DOUBLE)) AS weight FROM nd GROUP BY node, label) "
        "SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, label ASC) AS rk FROM cw) r WHERE rk = 1"
    ),
)
def majority_leaf(spark, sf_dir):
    return stats.majority(_b(spark, sf_dir), scoring.leaf_col(B_NODES))


@query(
    "weighted_node_stats",
    oracle=(
        f"{C_PREP} SELECT node, count(*) AS n, sum(sample_weight) AS weight, "
        "sum(CASE WHEN label = 1 THEN sample_weight ELSE 0.0 END) AS positive_weight FROM nd GROUP BY node"
    ),
)
def weighted_node_stats(spark, sf_dir):
    df = fx.fx_c_prepared(spark, sf_dir)
    node = scoring.leaf_col(C_NODES)
    return df.groupBy(node.alias("node")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("sample_weight").alias("weight"),
        F.sum(F.when(F.col("label") == 1, F.col("sample_weight")).otherwise(F.lit(0.0))).alias("positive_weight"),
    )


ALPHA = 0.1
A_FEATURES = fx.FX_A_FEATURES
A_NODE_SQL = f"CASE WHEN quantity <= {lit(26.5)} THEN 2 ELSE 3 END"


def _a_node():
    return F.when(F.col("quantity") <= F.lit(26.5), F.lit(2)).otherwise(F.lit(3))


def _a_hist(spark, sf_dir, features, node=None, k=2, df=None):
    df = df if df is not None else fx.fx_a_prepared(spark, sf_dir)
    return splits.histogram(splits.long_form(df, features, node=node), ["_t", "_n"], k)


@query(
    "missing_share",
    oracle=(
        f"WITH prep AS ({fx.FX_A_PREP_SQL}), lg AS ({sq.long_sql('prep', A_FEATURES, node=A_NODE_SQL)}) "
        f"SELECT CAST(node AS BIGINT) AS node, fname AS feature, sum(w * m) AS missing_weight, round(sum(w * m) / sum(w), 6) AS share, "
        f"round({lit(ALPHA)} * (sum(w * m) / sum(w)), 6) AS penalty FROM lg GROUP BY node, fname"
    ),
)
def missing_share(spark, sf_dir):
    """Per node and feature: weight of rows missing the feature, its share and alpha * share."""
    hist = _a_hist(spark, sf_dir, A_FEATURES, node=_a_node())
    tot = splits.group_totals(hist, ["_t", "_n"], 2)
    share = F.col("_tot_mw") / F.col("_tot_w")
    return tot.select(
        F.col("_n").alias("node"),
        splits.feature_name(A_FEATURES).alias("feature"),
        F.col("_tot_mw").alias("missing_weight"),
        F.round(share, 6).alias("share"),
        F.round(F.lit(ALPHA) * share, 6).alias("penalty"),
    )


H_FEATURES = ["discount", "tax"]
H_LONG = f"WITH prep AS ({fx.FX_A_PREP_SQL}), lg AS ({sq.long_sql('prep', H_FEATURES)}), hist AS ({sq.hist_sql('lg', 2)})"


@query(
    "feature_histogram",
    oracle=(
        f"{H_LONG} SELECT fname AS feature, v AS value, cnt AS n, wt AS weight, c1 AS positive_weight, "
        "sum(wt) OVER (PARTITION BY f) AS total_weight FROM hist"
    ),
)
def feature_histogram(spark, sf_dir):
    hist = _a_hist(spark, sf_dir, H_FEATURES)
    tot = F.sum("_wt").over(Window.partitionBy("_t", "_n", "_f"))
    return hist.select(
        splits.feature_name(H_FEATURES).alias("feature"),
        F.col("_v").alias("value"),
        F.col("_cnt").alias("n"),
        F.col("_wt").alias("weight"),
        F.col("_c1").alias("positive_weight"),
        tot.alias("total_weight"),
    )


@query(
    "cumulative_stats",
    oracle=(
        f"{H_LONG}, cum AS ({sq.cum_sql('hist', 2)}) SELECT fname AS feature, v AS value, wl AS weight_left, "
        "W - wl AS weight_right, l1 AS positive_left, C1 - l1 AS positive_right FROM cum"
    ),
)
def cumulative_stats(spark, sf_dir):
    cum = splits.cumulative(_a_hist(spark, sf_dir, H_FEATURES), ["_t", "_n"], 2)
    return cum.select(
        splits.feature_name(H_FEATURES).alias("feature"),
        F.col("_v").alias("value"),
        F.col("_wl").alias("weight_left"),
        (F.col("_tot_w") - F.col("_wl")).alias("weight_right"),
        F.col("_l1").alias("positive_left"),
        (F.col("_tot_c1") - F.col("_l1")).alias("positive_right"),
    )


CAND_SQL = f"{H_LONG}, cum AS ({sq.cum_sql('hist', 2)})"


def _cands(spark, sf_dir, criterion="gini"):
    cum = splits.cumulative(_a_hist(spark, sf_dir, H_FEATURES), ["_t", "_n"], 2)
    return splits.candidates(cum, ["_t", "_n"], 2, criterion)


@query(
    "split_candidates",
    oracle=(
        f"{CAND_SQL}, cand AS ({sq.cand_sql('cum', 2)}) SELECT fname AS feature, thr AS threshold, "
        "CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right FROM cand"
    ),
)
def split_candidates(spark, sf_dir):
    return _cands(spark, sf_dir).select(
        splits.feature_name(H_FEATURES).alias("feature"),
        F.col("_thr").alias("threshold"),
        F.col("_nl").cast("bigint").alias("n_left"),
        F.col("_nr").cast("bigint").alias("n_right"),
    )


def _score_query(criterion: str, penalised: bool):
    def fn(spark, sf_dir):
        c = _cands(spark, sf_dir, criterion)
        col = "_s"
        if penalised:
            c, col = splits.penalised(c, ALPHA), "_ps"
        return c.select(
            splits.feature_name(H_FEATURES).alias("feature"),
            F.col("_thr").alias("threshold"),
            F.round(col, 6).alias("score"),
        )

    return fn


def _score_sql(criterion: str, penalised: bool) -> str:
    expr = f"s - {lit(ALPHA)} * share" if penalised else "s"
    return (
        f"{CAND_SQL}, cand AS ({sq.cand_sql('cum', 2, criterion)}) "
        f"SELECT fname AS feature, thr AS threshold, round({expr}, 6) AS score FROM cand"
    )


query("gini_score", oracle=_score_sql("gini", False))(_score_query("gini", False))
query("entropy_score", oracle=_score_sql("info_gain", False))(_score_query("info_gain", False))
query("penalised_score", oracle=_score_sql("gini", True))(_score_query("gini", True))


@query(
    "histogram_multiclass",
    oracle=(
        f"WITH prep AS ({fx.FX_B_PREP_SQL}), lg AS ({sq.long_sql('prep', fx.FX_B_FEATURES)}), hist AS ({sq.hist_sql('lg', 3)}) "
        "SELECT fname AS feature, v AS value, cnt AS n, c0, c1, c2 FROM hist"
    ),
)
def histogram_multiclass(spark, sf_dir):
    hist = _a_hist(spark, sf_dir, fx.FX_B_FEATURES, k=3, df=_b(spark, sf_dir))
    return hist.select(
        splits.feature_name(fx.FX_B_FEATURES).alias("feature"),
        F.col("_v").alias("value"),
        F.col("_cnt").alias("n"),
        F.col("_c0").alias("c0"),
        F.col("_c1").alias("c1"),
        F.col("_c2").alias("c2"),
    )


# ---- raw extended price: binning and near-equal neighbours ---------------------------------
N_BINS = 32
_RAW_PRICE_SQL = f"WITH raw AS ({fx.FX_A_SQL.replace('FROM lineitem', ', l_extendedprice AS price FROM lineitem')})"


def _raw_price(spark, sf_dir):
    from missaware.session import table

    li = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_quantity") * (1 - F.col("l_discount") * 4) > 20, 1).otherwise(0)
    return li.select(F.col("l_extendedprice").alias("price"), label.alias("label"))


def _binned_sql() -> str:
    fr = ", ".join(repr(x) for x in binning.fractions(N_BINS))
    return (
        f"{_RAW_PRICE_SQL}, cuts AS (SELECT list_sort(list_distinct(quantile_disc(price, [{fr}]))) AS c FROM raw), "
        "binned AS (SELECT coalesce(list_sort(list_filter(c, lambda x: x >= price))[1], CAST('inf' AS DOUBLE)) AS edge, label "
        "FROM raw, cuts) SELECT edge AS bin_edge, count(*) AS n, sum(CAST(1.0 AS DOUBLE)) AS weight, sum(CASE WHEN label = 1 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END) AS positive_weight "
        "FROM binned GROUP BY edge"
    )


@query("binned_histogram", oracle=_binned_sql())
def binned_histogram(spark, sf_dir):
    """Histogram over 32 quantile bins of the raw extended price (bin = upper edge, a price)."""
    long_df = splits.long_form(_raw_price(spark, sf_dir), ["price"])
    cuts = binning.quantile_cuts(long_df, N_BINS, exact=True).first()["_cuts"]
    hist = splits.histogram(long_df.withColumn("_v", binning.bin_column(F.col("_v"), cuts)), ["_t", "_n"], 2)
    return hist.select(
        F.col("_v").alias("bin_edge"),
        F.col("_cnt").alias("n"),
        F.col("_wt").alias("weight"),
        F.col("_c1").alias("positive_weight"),
    )


NEAR = splits.NearEqual()


@query(
    "split_near_equal",
    oracle=(
        f"{_RAW_PRICE_SQL}, lg AS ({sq.long_sql('raw', ['price'], masked=False)}), hist AS ({sq.hist_sql('lg', 2)}), "
        f"cum AS ({sq.cum_sql('hist', 2)}) SELECT (SELECT count(*) FROM ({sq.cand_sql('cum', 2)}) a) AS n_candidates, "
        f"(SELECT count(*) FROM ({sq.cand_sql('cum', 2, near_equal=(NEAR.rtol, NEAR.atol))}) b) AS n_candidates_near_equal"
    ),
)
def split_near_equal(spark, sf_dir):
    """Candidate cuts of the raw price with and without skipping near-equal neighbours."""
    long_df = splits.long_form(_raw_price(spark, sf_dir), ["price"])
    cum = splits.cumulative(splits.histogram(long_df, ["_t", "_n"], 2), ["_t", "_n"], 2)
    plain = splits.candidates(cum, ["_t", "_n"], 2)
    kept = splits.apart(F.col("_v"), F.col("_next"), NEAR)
    return plain.agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count(F.when(kept, 1)).alias("n_candidates_near_equal")
    )
