"""Helpers shared by the corpus operators.

A word is ``[^\\x20\\x09-\\x0D]+`` everywhere: text cut at the six ASCII whitespace characters, as
``bytes.split()`` cuts it; no other Unicode space counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from missaware.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared scratch folder as Parquet and read it again.

    The folder is the cluster's ``spark.checkpoint.dir`` and is cleared as checkpoints are.  A lost
    executor costs nothing that was written, and Spark then knows the table's size for joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def id_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's text modulo m (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def parts_for(n_bytes: float, per_part: int, least: int = 1) -> int:
    """Number of parts that grows with the data, so that a part keeps its size."""
    return max(least, math.ceil(n_bytes / per_part))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of a text column; a scan of that column with one number per task."""
    return df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0


def before(totals: DataFrame, keys: list[str], order: str, value: str, name: str, fan: int = 1024) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over smaller ``order`` (a long from 0) of the same keys.

    Two levels: a window over ``fan`` neighbours, and one over the sums of such runs, so a window
    holds the square root of what one over all of a key's rows would.
    """
    t = totals.withColumn("_run", F.floor(F.col(order) / F.lit(fan)).cast("long"))
    runs = t.groupBy(*keys, "_run").agg(F.sum(value).alias("_sum"))
    wide = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_run", F.coalesce(F.sum("_sum").over(wide), F.lit(0)).alias("_far"))
    near = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_near", F.coalesce(F.sum(value).over(near), F.lit(0)))
    return t.join(runs, [*keys, "_run"]).withColumn(name, F.col("_near") + F.col("_far")).drop("_run", "_near", "_far")


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row (maps, which have no order, are left out)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def whole_ids(df: DataFrame, id_col: str) -> None:
    """Refuses ids that are not whole numbers, when the query is built."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError(f"{id_col} must be a whole number, found {kind.simpleString()}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
