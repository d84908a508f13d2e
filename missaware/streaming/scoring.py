"""Scoring on Structured Streaming sources.

Scoring is a stateless projection, so a fitted model applies to
a streaming DataFrame unchanged.  Reliance over a stream is a running aggregate (count and
sum of the per-row flag), kept in Spark's state store and exact at every trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missaware.operators import scoring
from missaware.plans.model import TreeModel
from missaware.session import scratch_path


def read_parquet_stream(spark: SparkSession, folder: str, file_glob: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream (schema given up front, as streams require)."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)


def score_stream(stream: DataFrame, model: TreeModel, keep: list[str]) -> DataFrame:
    return scoring.transform(stream, model, prediction="prediction", rho="rho").select(*keep, "prediction", "rho")


def reliance_stream(stream: DataFrame, model: TreeModel) -> DataFrame:
    """Running totals: rows seen and rows relying on a missing value; ``rho`` is their ratio."""
    scored = scoring.transform(stream, model, prediction=None, rho="_r")
    agg = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_r").cast("long")).alias("n_reliant"))
    return agg.withColumn(
        "rho", F.when(F.col("n") > 0, F.col("n_reliant") / F.col("n")).otherwise(F.lit(0.0))
    )


def run_available(spark: SparkSession, sdf: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a streaming query over everything available, stop it, and return what it wrote.

    ``append`` writes Parquet files to the shared checkpoint folder.  ``complete`` holds a running
    aggregate of a few rows, which goes through an in-process table that is dropped again.
    """
    ckpt = scratch_path(spark, f"stream-{name}")
    writer = sdf.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        path = scratch_path(spark, f"stream-out-{name}")
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(sdf.schema).parquet(path)
    writer.format("memory").queryName(name).start().awaitTermination()
    rows = spark.table(name).collect()  # the aggregate
    spark.catalog.dropTempView(name)
    return spark.createDataFrame(rows, sdf.schema)
