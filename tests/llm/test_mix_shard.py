from collections import defaultdict

import xxhash
from corpus_fixtures import no_docs, odd_docs  # noqa: F401
from missaware.llm import mixing, sharding
from pyspark.sql import functions as F


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Water filling by repetition: {source: target}."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not full:
            out.update({s: level * w[s] for s in open_})
            break
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def check_mix(rows):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])
    assert sum(taken.values()) <= sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= sum(largest.values())


def test_mix_reaches_targets_and_reruns_agree(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 18
    check_mix(rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_docs).collect()))


def test_mix_of_many_small_documents_is_close(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 40 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'hot' else 's' || (id % 7) end").alias("source"))
    rows = mixing.mix(docs).collect()
    check_mix(rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) < 0.01 * own[0]["target"] + 80


def test_mix_of_nothing(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["size"], r["copies"]) for r in mixing.mix(blank).collect()} == {(1, 0, 0), (2, 0, 0)}


def test_sources_without_words_take_nothing(spark):
    good = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(120)]
    blank = [(200, None, "c"), (201, "", "c"), (202, " \t ", "c"), (203, None, None), (204, "\n", None)]
    rows = mixing.mix(spark.createDataFrame(good + blank, "doc_id long, text string, source string")).collect()
    assert len(rows) == 125
    check_mix(rows)
    assert all((r["size"], r["copies"], r["target"]) == (0, 0, 0.0) for r in rows if r["doc_id"] >= 200)
    alone = mixing.mix(spark.createDataFrame(blank, "doc_id long, text string, source string")).collect()
    assert [r["copies"] for r in alone] == [0] * 5


def test_remix_repeats_whole_rows(odd_docs, no_docs):
    out = mixing.remix(odd_docs)
    assert out.columns == odd_docs.columns
    by_mix = sum(r["copies"] for r in mixing.mix(odd_docs.withColumn("n", F.monotonically_increasing_id()), row_col="n").collect())
    assert abs(out.count() - by_mix) <= 3  # another shuffle
    again = mixing.remix(odd_docs.repartition(7).orderBy(F.rand(3)))
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    assert mixing.remix(no_docs).count() == 0


def test_shards_are_gapless_balanced_and_grow_into_the_new_one(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.place(docs).collect()
    count = defaultdict(list)
    for r in rows:
        count[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and r["size"] == 2
    assert sorted(count) == list(range(16))
    for slots in count.values():
        assert sorted(slots) == list(range(len(slots))) and 1000 < len(slots) < 1500
    moved = sum(r["grown_shard"] == 16 for r in rows)
    assert 900 < moved < 1500


def test_shard_of_equals_plain_descent(spark):
    import math
    import struct

    def hashed(k, node):
        h = xxhash.xxh64(struct.pack("<q", k), seed=42).intdigest()
        h = xxhash.xxh64(node.encode(), seed=h).intdigest()
        return -math.log(((h >> 11) + 0.5) / 2**53)

    regions = sharding.tree(17, founded=16)
    got = {r[0]: r[1] for r in spark.range(500).select("id", sharding.shard_of(F.col("id"), regions)).collect()}
    for k in range(500):
        r = min(range(5), key=lambda r: hashed(k, f"{r}") / sum(map(len, regions[r])))
        c = min(range(len(regions[r])), key=lambda c: hashed(k, f"{r}/{c}") / len(regions[r][c]))
        assert got[k] == min(regions[r][c], key=lambda s: hashed(k, f"{r}/{c}/{s}"))


def test_growth_inside_a_subtree_stays_there(spark):
    regions = sharding.tree(16)
    wider = [*regions[:3], [regions[3][0], [*regions[3][1], 16]]]
    rows = spark.range(5000).select(sharding.shard_of(F.col("id"), regions).alias("a"), sharding.shard_of(F.col("id"), wider).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["b"] >= 12 for r in rows) and any(r["b"] == 16 for r in rows)


def test_every_tree_grows_only_into_the_new_shard(spark):
    cols = []
    for n in range(1, 41):
        cols += [sharding.shard_of(F.col("id"), sharding.tree(n)).alias(f"a{n}"), sharding.shard_of(F.col("id"), sharding.tree(n + 1, founded=n)).alias(f"b{n}")]
    rows = spark.range(4000).select(*cols).toPandas()
    for n in range(1, 41):
        a, b = rows[f"a{n}"], rows[f"b{n}"]
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.sum() - 4000 / (n + 1)) < 6 * (4000 / (n + 1)) ** 0.5
        counts = b.value_counts()
        assert sorted(counts.index) == list(range(n + 1)) and counts.max() - 4000 / (n + 1) < 6 * (4000 / (n + 1)) ** 0.5


def test_growth_over_several_steps(spark):
    trees = [sharding.tree(n, founded=6) for n in range(6, 13)]
    rows = spark.range(3000).select(*[sharding.shard_of(F.col("id"), t).alias(f"s{i}") for i, t in enumerate(trees)]).collect()
    for r in rows:
        for i in range(1, len(trees)):
            assert r[i] in (r[i - 1], 5 + i)


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = sharding.place(odd_docs).collect()
    assert len(rows) == 18 and sharding.place(no_docs).count() == 0
    assert len({(r["shard"], r["slot"]) for r in rows}) == 18
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (4, 5)} == {(1, 0)}
