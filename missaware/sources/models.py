"""Model persistence: node table (parquet) plus metadata, and the nested JSON export.

A saved model is a folder with ``nodes/`` (the node table, one row per node and tree) and
``meta/`` (one JSON text line: feature names, mask names, number of classes).  Loading
collects the node table, which is bounded by trees x 2^(maxDepth+1) rows.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession

from missaware.plans.model import ForestModel, TreeModel


def save_forest(spark: SparkSession, forest: ForestModel, path: str, mode: str = "overwrite") -> None:
    forest.node_table(spark).coalesce(1).write.mode(mode).parquet(os.path.join(path, "nodes"))
    meta = forest.trees[0].meta() if forest.trees else {}
    meta["n_trees"] = len(forest.trees)
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(mode).text(
        os.path.join(path, "meta")
    )


def save_tree(spark: SparkSession, model: TreeModel, path: str, mode: str = "overwrite") -> None:
    save_forest(spark, ForestModel([model]), path, mode)


def load_forest(spark: SparkSession, path: str) -> ForestModel:
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    rows = spark.read.parquet(os.path.join(path, "nodes")).collect()
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(int(r["tree"]), []).append(r)
    trees = [TreeModel.from_node_rows(by_tree[t], meta, tree=t) for t in sorted(by_tree)]
    return ForestModel(trees)


def load_tree(spark: SparkSession, path: str) -> TreeModel:
    return load_forest(spark, path).trees[0]


def save_nested_json(spark: SparkSession, forest_or_tree, path: str, mode: str = "overwrite") -> None:
    """The nested ``{"If", "Left", "Else", "Right"} / {"Predict"}`` form; a forest is a list."""
    doc = forest_or_tree.to_nested()
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode(mode).text(path)
