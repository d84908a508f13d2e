"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard.  At each level every child draws an exponential from a
hash of (document, child), divided by the child's weight (the number of shards below it); the
smallest draw wins, so a child is chosen in proportion to its weight.  A changed weight moves
documents only between the changed child and its siblings: movement stays in the subtrees whose
weights change.  A shard that opens its own region takes documents only into itself, and nothing
else moves.  So a tree is a history: ``founded`` shards stand in regions and racks from the start, and
each one added later keeps a region of its own for ever.  Trees of different foundings are
different trees; growth keeps ``founded`` and raises the number of shards.

Law ``key``: the row's id and the tree (founded and present number of shards) alone decide the shard.

Slots number the rows of a shard from 0 without gaps, by hash bucket and id.  A shard's rows never
meet in one task: buckets of a few thousand rows are numbered alone, with offsets.

Defined results: a null id is an id of its own; a null text has no bytes (size 1, crc32 0); repeated
rows share the shard and get slots of their own; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missaware.llm.common import before, text_or_empty, written

RACKS, SHARDS = 2, 2
BUCKET_ROWS = 4096

Tree = list[list[list[int]]]  # regions of racks of shard numbers


def tree(n_shards: int, founded: int | None = None) -> Tree:
    """Founded shards (all by default) in regions of 2 racks of 2, what is left over and every later
    shard as a region of its own."""
    founded = n_shards if founded is None else founded
    if not 1 <= founded <= n_shards:
        raise ValueError(f"a tree of {n_shards} shards cannot have been founded with {founded}")
    full = founded // (RACKS * SHARDS)
    regions = [[[(r * RACKS + k) * SHARDS + s for s in range(SHARDS)] for k in range(RACKS)] for r in range(full)]
    return regions + [[[s]] for s in range(full * RACKS * SHARDS, n_shards)]


def _draw(key: Column, node: str, weight: int) -> Column:
    """Exponential with rate ``weight`` from a hash of the row and the child."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**53))) / F.lit(float(weight))


def _choose(key: Column, children: list[tuple[str, int, Column]]) -> Column:
    """The outcome of the child with the smallest draw (ties: the first)."""
    if len(children) == 1:
        return children[0][2]
    draws = [_draw(key, name, weight) for name, weight, _ in children]
    best = F.array_min(F.array(*draws))
    out = children[-1][2]
    for (_, _, inner), draw in reversed(list(zip(children[:-1], draws[:-1], strict=True))):
        out = F.when(draw == best, inner).otherwise(out)
    return out


def shard_of(key: Column, regions: Tree) -> Column:
    """The shard number a key reaches in the tree."""
    level = []
    for r, racks in enumerate(regions):
        inner = []
        for k, shards in enumerate(racks):
            leaf = _choose(key, [(f"{r}/{k}/{s}", 1, F.lit(s)) for s in shards])
            inner.append((f"{r}/{k}", len(shards), leaf))
        level.append((f"{r}", sum(len(x) for x in racks), _choose(key, inner)))
    return _choose(key, level)


def place(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", founded: int | None = None) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` for every row; ``grown_shard`` is the shard
    in the same tree with one more."""
    founded = n_shards if founded is None else founded
    key, text = F.col(id_col), text_or_empty(F.col(text_col)).cast("binary")
    rows = docs.select(key.alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(key).alias("h"))
    rows = rows.withColumn("shard", shard_of(F.col("row"), tree(n_shards, founded))).withColumn("grown", shard_of(F.col("row"), tree(n_shards + 1, founded)))
    rows = written(rows, "shards")
    buckets = max(1, rows.count() // (n_shards * BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    ahead = before(rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")), ["shard"], "bucket", "n", "ahead")
    ahead = written(ahead.select("shard", "bucket", "ahead"), "shard-offsets")
    inside = Window.partitionBy("shard", "bucket").orderBy("row", "crc", "size")
    slot = F.col("ahead") + F.row_number().over(inside) - 1
    return rows.join(ahead, ["shard", "bucket"]).select(
        F.col("row").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), F.col("grown").alias("grown_shard")
    )


def op6(spark, sf_dir):
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"))
