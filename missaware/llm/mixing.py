"""Mixing sources to target weights by weighted fair queueing.

Every document is a packet of ``size`` words in its source's queue; the queue is shuffled by a hash
and repeats up to ``max_repeats`` times.  A packet's virtual finish time is the source's cumulative
words up to and including it, divided by the source's target.  All packets are put in one order by
finish time (range bins of time, then sorted inside the bin where the budget ends) and the
order is cut where the total budget is reached.  Whole documents only: a source's taken words differ
from its target by about one document.

Nothing is collected but the cut itself (one bin, one row).  The running sums over a source, which
may hold a third of all rows, are taken over hash buckets of a few thousand rows with offsets.

Defined results: null text and text without words have size 0 and are never taken; a source without
any word has target 0 and gives nothing; a null source is a source of its own, after all others; repeated rows are separate packets; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missaware.llm.common import WORD, before, fresh, row_hash, written

#: Rows in a bucket of a source's shuffled queue, and packets in a bin of virtual time (about).
BUCKET_ROWS = 4096


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: list[int], max_repeats: int) -> DataFrame:
    """One row per source: ``source, rank, n, source_size, target``.

    Sources by code point (null last) weigh ``weights`` in turn and share the total size; a target
    stops at ``max_repeats`` times its source, the excess goes to the others by weight.  Sources in
    ascending order of cap per weight reach their cap first, so the level of the rest is
    ``(total - caps so far) / (weights left)`` at the first source that stays below its cap.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    fill = Window.orderBy((F.col("cap").cast("double") / F.col("w")), "rank")
    done = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(done), F.lit(0)))
    s = s.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(done), F.lit(0)))
    level = F.col("left").cast("double") / F.col("w_left")
    s = s.withColumn("open", F.when(F.col("cap") >= level * F.col("w"), F.struct(F.col("w_left").alias("o"), level.alias("level"))))
    s = s.withColumn("level", F.max("open").over(every)["level"])
    cap = F.col("cap").cast("double")
    target = F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("w")))
    return s.select("source", "rank", "n", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    row_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: list[int] = (1, 2, 3),
    max_repeats: int = 3,
    seed: int = 17,
    shuffle_col: str | None = None,
) -> DataFrame:
    """``row_col, size, source, source_size, target, copies``: how often the mix takes each row.

    A source's queue is shuffled by a hash of ``row_col``, or of ``shuffle_col`` where given."""
    row = F.col(row_col)
    shuffled = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(shuffle_col or row_col).cast("string"))), 1, 15), 16, 10).cast("long")
    sized = docs.select(row.alias("row"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), shuffled.alias("h"))
    sized = written(sized, "mix-sized")
    sources = written(source_targets(sized, list(weights), max_repeats), "mix-sources")
    budget, n_rows = sources.agg(F.sum("source_size"), F.sum("n")).first()
    per_source = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sized["source"])

    # buckets follow the hash order, so bucket offsets plus a sum inside the bucket give the queue
    buckets = F.ceil(F.col("n") / F.lit(BUCKET_ROWS)).cast("long")
    bucket = F.shiftright(F.shiftright("h", 29) * buckets, 31)
    per_source = per_source.withColumn("bucket", bucket)
    totals = per_source.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    offsets = written(before(totals, ["rank"], "bucket", "words", "ahead").select("rank", "bucket", "ahead"), "mix-offsets")
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "row", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = per_source.withColumn("inside", F.sum("size").over(inside)).join(offsets, ["rank", "bucket"])
    queue = queue.select("row", "size", "source", "rank", "source_size", "target", (F.col("ahead") + F.col("inside")).alias("done"))
    queue = written(queue, "mix-queue")

    def finish(epoch):
        words = F.col("source_size") * (epoch - 1) + F.col("done")
        return F.try_divide(words.cast("double"), F.col("target"))  # null for a source without words

    epochs = range(1, max_repeats + 1)
    if not budget:
        return queue.select(F.col("row").alias(row_col), "size", "source", "source_size", "target", F.lit(0).alias("copies"))
    live = (F.col("size") > 0) & (F.col("target") > 0)
    packets = queue.filter(live).select(F.explode(F.array(*[F.struct(finish(e).alias("finish"), F.lit(e).alias("epoch")) for e in epochs])).alias("p"), "rank", "row", "size")
    bins = max(1, n_rows // BUCKET_ROWS)  # bins in a unit of time; every source ends a target by time 1
    packets = packets.select("p.*", "rank", "row", "size", F.floor(F.col("p.finish") * bins).cast("long").alias("bin"))
    by_bin = before(packets.groupBy("bin").agg(F.sum("size").alias("words")).withColumn("_all", F.lit(0)), ["_all"], "bin", "words", "ahead")
    edge = by_bin.filter((F.col("ahead") < budget) & (F.col("ahead") + F.col("words") >= budget)).select("bin", "ahead").first()
    key = F.struct("finish", "rank", "row", "epoch")
    order = Window.orderBy("finish", "rank", "row", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    taken = packets.filter(F.col("bin") == edge["bin"]).withColumn("total", F.sum("size").over(order) + F.lit(edge["ahead"]))
    last = taken.filter(F.col("total") <= budget).agg(F.max(key).alias("k")).first()["k"]
    copies = F.lit(0)
    for e in epochs:
        t = finish(e)
        within = F.floor(t * bins) < edge["bin"]
        if last is not None:
            cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["rank"]).alias("rank"), F.lit(last["row"]).cast(queue.schema["row"].dataType).alias("row"), F.lit(last["epoch"]).alias("epoch"))
            own = F.struct(t.alias("finish"), F.col("rank"), F.col("row"), F.lit(e).alias("epoch"))
            within = within | ((F.floor(t * bins) == edge["bin"]) & (own <= cut))
        copies = copies + F.when(live & within, 1).otherwise(0)
    return queue.select(F.col("row").alias(row_col), "size", "source", "source_size", "target", copies.alias("copies"))


def remix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as in the input.

    The queues are shuffled by a hash of the whole row; the row number only tells equal rows apart, so
    reruns agree whatever the layout of the files."""
    row, copy, key = fresh(docs, "_row"), fresh(docs, "_copy"), fresh(docs, "_key")
    rows = written(docs.withColumns({row: F.monotonically_increasing_id(), key: row_hash(docs)}), "mix-docs")
    taken = mix(rows, row_col=row, shuffle_col=key, **options).filter("copies > 0").select(row, F.sequence(F.lit(1), F.col("copies")).alias(copy))
    return rows.join(taken, row).select(*docs.columns, F.explode(copy)).select(*docs.columns)


def op1(spark, sf_dir):
    """The contract's columns for every document of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM src),
weighed AS (SELECT *, [1, 2, 3][((rnk - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM ranked),
filled AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER f, 0)::BIGINT)::DOUBLE
         / ((sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER f, 0)::BIGINT) AS lvl,
         (sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER f, 0)::BIGINT AS w_left
  FROM weighed
  WINDOW f AS (ORDER BY cap::DOUBLE / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_max(lvl, w_left) AS lvl FROM filled WHERE cap >= lvl * w),
targets AS (SELECT source, rnk, source_size, least(cap::DOUBLE, level.lvl * w) AS target FROM filled, level),
queue AS (
  SELECT s.doc_id, s.size, s.source, t.rnk, t.source_size, t.target,
         (sum(s.size) OVER (PARTITION BY t.rnk ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING))::BIGINT AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
packets AS (
  SELECT doc_id, size, rnk, e.epoch, ((e.epoch - 1) * source_size + done)::DOUBLE / target AS finish
  FROM queue, (VALUES (1), (2), (3)) e(epoch) WHERE size > 0 AND target > 0),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rnk, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS total FROM packets),
taken AS (
  SELECT doc_id, count(*)::INT AS copies FROM ordered
  WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, q.size::BIGINT AS size, q.source_size, q.target,
       (q.size * coalesce(t.copies, 0))::BIGINT AS taken, q.source, coalesce(t.copies, 0)::INT AS copies
FROM queue q LEFT JOIN taken t ON q.doc_id = t.doc_id
"""
