"""CSV directories: read with a header (explicit schema preferred), write as N header parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Read a directory of header CSV parts; infer types only when no schema is given."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def write_csv_parts(df: DataFrame, path: str, num_partitions: int = 8, mode: str = "overwrite") -> None:
    """Write ``df`` as ``num_partitions`` header CSV part files (one shuffle to spread rows)."""
    df.repartition(num_partitions).write.mode(mode).option("header", True).csv(path)
