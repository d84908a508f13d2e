"""MLlib vectors as columns of their set entries, without Python and without the zeros.

``entries`` turns a vector into a struct of its places ``i``, its values ``v`` and its length ``n``; every
other function works on that struct.  Places that are not set hold 0.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_vector(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, VectorUDT)


def entries(vector: Column) -> Column:
    """A sparse vector's own places and values; a dense one has all places."""
    s = F.unwrap_udt(vector)
    length = F.when(s["type"] == 0, s["size"]).otherwise(F.size(s["values"]))
    places = F.when(s["type"] == 0, s["indices"]).when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(places.alias("i"), s["values"].alias("v"), length.alias("n"))


def entries_of(df: DataFrame, column: str) -> Column:
    """The struct of a column that is a vector or already such a struct."""
    return entries(F.col(column)) if is_vector(df, column) else F.col(column)


def value_at(places: str, values: str, place: str) -> str:
    """SQL text of the value at a place, 0 where it is not set; null in a null vector."""
    return f"CASE WHEN {values} IS NOT NULL THEN coalesce(get({values}, CAST(array_position({places}, {place}) AS INT) - 1), 0.0D) END"


def long_form(df: DataFrame, values: str, mask: str | None, keep: list[str]) -> DataFrame:
    """(keep, _f, _v, _m): a row per entry that is not 0, and one with value 0 per feature that is missing
    and 0.  Features that are 0 and not missing have no row."""
    rows = df.select(*keep, F.col(f"{values}.i").alias("_xi"), F.col(f"{values}.v").alias("_xv"), *([F.col(f"{mask}.i").alias("_mi"), F.col(f"{mask}.v").alias("_mv")] if mask else []))
    flags = ["_mi", "_mv"] if mask else []
    set_ = rows.select(*keep, *flags, F.inline(F.arrays_zip(F.col("_xi").alias("_f"), F.col("_xv").alias("_v")))).filter("_v != 0")
    flag = F.expr(f"CAST({value_at('_mi', '_mv', '_f')} AS INT)") if mask else F.lit(0)
    out = set_.select(*keep, "_f", F.col("_v").cast("double").alias("_v"), F.coalesce(flag, F.lit(0)).alias("_m"))
    if not mask:
        return out
    missing = rows.select(*keep, "_xi", "_xv", F.inline(F.arrays_zip(F.col("_mi").alias("_f"), F.col("_mv").alias("_set")))).filter("_set != 0")
    missing = missing.withColumn("_v", F.expr(value_at("_xi", "_xv", "_f"))).filter("_v = 0")
    return out.unionByName(missing.select(*keep, "_f", "_v", F.lit(1).alias("_m")))
