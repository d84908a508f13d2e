"""Run records: one key,value CSV per run; a folder of them read back as one typed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missaware.plans.experiment import RESULT_KEYS


def write_result(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write one-row result DataFrames (columns = RESULT_KEYS) as headerless key,value CSV."""
    kv = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in RESULT_KEYS])
    df.select(F.inline(kv)).write.mode(mode).csv(path)


def write_runs(runs: DataFrame, path: str, run_col: str = "run") -> None:
    """Many runs at once: one key,value CSV file per distinct ``run_col`` value."""
    kv = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in RESULT_KEYS])
    rows = runs.select(F.col(run_col), F.inline(kv))
    rows.repartition(F.col(run_col)).write.mode("append").partitionBy(run_col).csv(path)


def collect_results(spark: SparkSession, path: str) -> DataFrame:
    """All result files of a folder, transposed to one row per file; all but the alias
    become doubles.  One ``groupBy(file)`` with a fixed pivot list (no extra pass)."""
    raw = (
        spark.read.schema("key string, value string")
        .option("recursiveFileLookup", True)
        .csv(path)
        .withColumn("_file", F.input_file_name())
    )
    wide = raw.groupBy("_file").pivot("key", RESULT_KEYS).agg(F.first("value"))
    cols = [F.col("estimator_alias")] + [F.col(k).cast("double").alias(k) for k in RESULT_KEYS if k != "estimator_alias"]
    return wide.select(*cols)


def read_param_grid(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """Experiment grid lines ``k=v k=v ...`` -> one map per line, with defaults filled in."""
    defaults = defaults if defaults is not None else {"n_features": "20"}
    m = F.expr("str_to_map(value, ' ', '=')")
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(m.alias("params"))
    filled = lines
    if defaults:
        dm = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
        params = F.col("params")
        missing = F.map_filter(dm, lambda k, v: ~F.map_contains_key(params, k))
        filled = lines.select(F.map_concat(missing, params).alias("params"))
    return filled
