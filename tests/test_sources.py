"""Sources and sinks: grids, run records, saved models, CSV parts."""

import os

from pyspark.sql import functions as F

from missaware.plans.model import ForestModel, TreeModel
from missaware.session import scratch_path
from missaware.sources import csv as csv_io
from missaware.sources import models as model_io
from missaware.sources import results as results_io


def test_param_grid(spark, tmp_path):
    p = tmp_path / "grid.txt"
    p.write_text("alias=tree n_train=100 alpha=0.1 seed=0\nalias=tree n_train=100 n_features=7 alpha=1.0 seed=1\n\n")
    rows = results_io.read_param_grid(spark, str(p)).collect()
    assert [r["params"]["n_features"] for r in rows] == ["20", "7"]
    assert rows[0]["params"]["alpha"] == "0.1"


def test_collect_results(spark):
    path = scratch_path(spark, "runs")
    recs = [("tree", 100 + i, 10, 20, 4, 0.1 * i, i, 1.5, 0.8, 0.3) for i in range(3)]
    df = spark.createDataFrame(recs, results_io.RESULT_KEYS).withColumn("run", F.col("seed"))
    results_io.write_runs(df, path)
    got = results_io.collect_results(spark, path).orderBy("seed").collect()
    assert [r["n_train"] for r in got] == [100.0, 101.0, 102.0]
    assert got[0]["estimator_alias"] == "tree" and isinstance(got[0]["accuracy"], float)


def test_model_roundtrip(spark):
    m = TreeModel.literal(["x", "y"], {1: ("x", 1.5), 3: ("y", 2.5)}, {2: [1.0, 0.0], 6: [0.3, 0.7], 7: [0.5, 0.5]})
    path = scratch_path(spark, "m")
    model_io.save_tree(spark, m, path)
    back = model_io.load_tree(spark, path)
    assert back.to_nested() == m.to_nested()
    assert back.nodes[6].probability == [0.3, 0.7]
    model_io.save_nested_json(spark, ForestModel([m, back]), path + "-json")
    assert "Predict" in spark.read.text(path + "-json").first()[0]


def test_csv_parts(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") / 3).alias("x"))
    path = scratch_path(spark, "csv")
    csv_io.write_csv_parts(df, path, 4)
    local = path.removeprefix("file:")
    parts = [f for f in os.listdir(local) if f.startswith("part-") and f.endswith(".csv")]
    assert len(parts) == 4
    back = csv_io.read_csv(spark, path, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
