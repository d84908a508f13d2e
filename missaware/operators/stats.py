"""Node statistics: counts, class weights, class shares, purity, majority class.

Each is one ``groupBy`` over (node[, label]) with map-side partial aggregation; the node
column is any expression (e.g. ``scoring.leaf_col(model)``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def node_stats(df: DataFrame, node: Column, weight: str | None = None) -> DataFrame:
    """Per node: row count ``n`` and total ``weight``."""
    return df.groupBy(node.alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_w(weight)).alias("weight")
    )


def class_weights(df: DataFrame, node: Column, label: str = "label", weight: str | None = None) -> DataFrame:
    """Per (node, label): rows and weight."""
    return df.groupBy(node.alias("node"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_w(weight)).alias("weight")
    )


def distribution(cw: DataFrame) -> DataFrame:
    """Class shares per node from ``class_weights`` output (window over the small table)."""
    tot = F.sum("weight").over(Window.partitionBy("node"))
    return cw.select("node", "label", (F.col("weight") / tot).alias("share"))


def purity(df: DataFrame, node: Column, label: str = "label", weight: str | None = None) -> DataFrame:
    """Per node: number of classes with positive weight and whether it is pure (<= 1)."""
    w = _w(weight)
    per = df.groupBy(node.alias("node"), F.col(label).alias("label")).agg(F.sum(w).alias("weight"))
    return per.groupBy("node").agg(
        F.count(F.when(F.col("weight") > 0, 1)).alias("n_classes")
    ).withColumn("is_pure", F.col("n_classes") <= 1)


def majority(df: DataFrame, node: Column, label: str = "label", weight: str | None = None) -> DataFrame:
    """Per node: class with the largest weight; a tie goes to the smallest label."""
    per = class_weights(df, node, label, weight)
    best = per.groupBy("node").agg(F.max(F.struct(F.col("weight"), (-F.col("label")).alias("neg"))).alias("b"))
    return best.select("node", (-F.col("b.neg")).alias("label"))


def label_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """min, max, number of distinct labels and whether they are exactly 0 .. K-1."""
    y = F.col(label)
    out = df.agg(F.min(y).alias("min_label"), F.max(y).alias("max_label"), F.count_distinct(y).alias("n_classes"))
    valid = (F.col("min_label") == 0) & (F.col("max_label") == F.col("n_classes") - 1)
    return out.withColumn("valid", valid)


def mask_summary(df: DataFrame, features: list[str], prefix: str = "missing_") -> DataFrame:
    """Per feature: mask column present, rows, non-null mask values and missing rows (one pass)."""
    present = set(df.columns)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(features):
        m = f"{prefix}{f}"
        if m in present:
            aggs += [F.count(F.col(m)).alias(f"_c{i}"), F.sum(F.col(m).cast("bigint")).alias(f"_s{i}")]
        else:
            aggs += [F.lit(0).cast("bigint").alias(f"_c{i}"), F.lit(0).cast("bigint").alias(f"_s{i}")]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(f"{prefix}{f}" in present).alias("has_mask"),
                F.col("_rows").alias("n"),
                F.col(f"_c{i}").alias("n_mask"),
                F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("bigint").alias("n_missing"),
            )
            for i, f in enumerate(features)
        ]
    )
    return one.select(F.inline(rows)).withColumn("complete", F.col("has_mask") & (F.col("n") == F.col("n_mask")))


def feature_profile(long_df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature of a long table (``_f``, ``_v``): values, nulls, distinct, min, max."""
    v = F.col("_v")
    out = long_df.groupBy("_f").agg(
        F.count(v).alias("n"),
        F.count(F.when(v.isNull(), 1)).alias("nulls"),
        F.count_distinct(v).alias("n_distinct"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_f") + 1)
    return out.select(names.alias("feature"), "n", "nulls", "n_distinct", "min", "max")
