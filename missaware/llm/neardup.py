"""Near-duplicate groups by SuperMinHash, banding, verification and connected components.

A document's set holds the hashes of its 5-word shingles.  SuperMinHash gives each shingle a random
permutation of the signature's places, one place per level, with values that grow with the level: the
ranks a shingle takes at different places are correlated, which lowers the variance, and a
document is done at the level that every place has already been filled below.

Steps: equal sets are one node; nodes that agree in a band meet.  A band's first node is its hub (one
number per band, pre-aggregated, so a large group gives a star, not all pairs).  Every node is
compared with the hub it shares most bands with, then, where that left groups apart, with its other
hubs; pairs whose signatures allow the similarity are confirmed on the full sets and links are
grouped.  What is left, groups whose nodes share a band, is compared in full, block by
block, so no link is lost to the star; only that part takes work beyond the input's size.  32 bands of 4 miss a pair at similarity 0.75 with
probability 5e-6, and the signature test as many.

Defined results: null texts and texts without words have no shingles and are linked with nothing;
with fewer than five words the whole sequence is the one shingle; rows that are equal in every
respect share their group; several rows with one id count as one document each; a null
id comes last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missaware.llm.common import fresh, row_hash, whole_ids, written
from missaware.llm.components import components
from missaware.llm.grams import WordHashes, hashed, mix, windows

SHINGLE, SLOTS, BANDS = 5, 128, 32
ROWS = SLOTS // BANDS
PERCENT = 75
#: Least share of equal signature places for a pair to be compared on full sets.
LIKELY = 0.58
#: Nodes and bytes of sets in a block of a cluster that is compared in full (about).
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Shingles that are signed together.
TOGETHER = 1 << 17
GOLDEN = 0x9E3779B97F4A7C15


def seed(i: int) -> np.uint64:
    return np.uint64(GOLDEN * i % 2**64)


def shingle_set(text: bytes | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (ASCII letters lower-cased)."""
    words = (text or b"").lower().split()
    a = hashed(words, known)
    if not len(a):
        return a
    if len(a) < SHINGLE:
        return windows(np.concatenate((np.full(SHINGLE - len(a), len(a), np.uint64), a)), SHINGLE, 1)
    return np.unique(windows(a, SHINGLE))


def super_min_hash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of non-empty sets: level in the top bits, a random number below, the least per place."""
    sizes = np.array([len(s) for s in sets])
    doc, h = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    least = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    flat, order = least.reshape(-1), None
    for level in range(SLOTS):
        draw = mix(h + seed(2 * level + 1))
        pick = level + (mix(h + seed(2 * level + 2)) % np.uint64(SLOTS - level)).astype(np.int64)
        if order is None:
            place = pick
        else:
            at = np.arange(len(h))
            place = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, level]
            order[:, level] = place
        np.minimum.at(flat, doc * SLOTS + place, (np.uint64(level) << np.uint64(48)) | (draw >> np.uint64(16)))
        open_docs = least.max(1) >= (np.uint64(level + 1) << np.uint64(48))
        if not open_docs.any():
            break
        go = open_docs[doc]
        first = order is None
        doc, h = doc[go], h[go]
        if first:  # the permutations are only needed from the second level on
            order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(h), 1))
            at, pick = np.arange(len(h)), pick[go]
            order[at, pick], order[:, 0] = 0, pick
        else:
            order = order[go]
    return least


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """One long per band."""
    s = signatures.reshape(-1, BANDS, ROWS)
    out = np.zeros(s.shape[:2], np.uint64)
    for r in range(ROWS):
        out = mix(out * seed(1) + s[:, :, r])
    return out.view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``id, h`` (hash of the text), ``n, digest`` of the set, ``bands, sig``."""

    def chunks(ids, hs, texts):
        known, sets, held, start = WordHashes(), [], 0, 0
        for i, t in enumerate(texts):  # one text at a time out of the batch
            sets.append(shingle_set(t.as_py(), known))
            held += len(sets[-1])
            if held >= TOGETHER or i == len(texts) - 1:
                some = [s for s in sets if len(s)]
                sig = super_min_hash(some) if some else np.zeros((0, SLOTS), np.uint64)
                keys, small = bands_of(sig), (mix(sig) & np.uint64(0xFF)).astype(np.uint8)
                lists, bytes_, digests, k = [], [], [], 0
                for s in sets:
                    if len(s):
                        lists.append(keys[k])
                        bytes_.append(small[k].tobytes())
                        digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        k += 1
                    else:
                        lists.append(None)
                        bytes_.append(None)
                        digests.append(None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, len(sets)), hs.slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())],
                    ["id", "h", "n", "digest", "bands", "sig"],
                )
                sets, held, start = [], 0, i + 1

    def run(batches):
        for b in batches:
            yield from chunks(b.column(0), b.column(1), b.column(2))

    text = F.col(text_col).cast("string")
    one = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    return one.mapInArrow(run, "id long, h long, n long, digest binary, bands array<long>, sig binary")


def sets_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``node, grams`` (the sorted set as bytes) for ``wanted`` (node, key, h): one row per node."""

    def run(batches):
        known = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((shingle_set(t.as_py(), known).tobytes() for t in b.column(1)), pa.binary())], ["node", "grams"])

    text = F.col(text_col).cast("string")
    one = docs.select(key_of(F.col(id_col)).alias("key"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    return one.join(wanted, ["key", "h"]).select("node", "text").mapInArrow(run, "node long, grams binary").dropDuplicates(["node"])


def key_of(doc_id):
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def grams_in(value) -> np.ndarray:
    """A set out of an Arrow value, without a copy."""
    return np.frombuffer(value.as_buffer(), np.uint64)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for b in batches:
            ok = [similar(grams_in(x), grams_in(y), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    x, y = sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def equal_share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(-1)


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree often enough."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in (2, 3))
            keep = pa.array(equal_share(x, y) >= LIKELY, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    x, y = nodes.select(F.col("node").alias("a"), F.col("sig").alias("x")), nodes.select(F.col("node").alias("b"), F.col("sig").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def best_hub(met: DataFrame) -> DataFrame:
    """For each node the hub that it shares most bands with (ties: the smallest): one pair per node."""
    shared = met.filter("node > hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("node").agg(F.max(F.struct("n", (-F.col("hub")).alias("minus")))["minus"].alias("minus"))
    return best.select(F.col("node").alias("a"), (-F.col("minus")).alias("b"))


def apart(met: DataFrame, root: DataFrame) -> DataFrame:
    """The rows of ``met`` in bands whose nodes are not all in one group yet, with ``root``, the band's
    ``size`` and the first node's group ``main``."""
    rows = met.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stat = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("least"), F.max("root").alias("most"), F.min(F.struct("node", "root"))["root"].alias("main"))
    return rows.join(stat.filter("least < most").drop("least", "most"), ["band", "key"])


def left_over(met: DataFrame, nodes: DataFrame, sets: DataFrame, root: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes that share a band but no group yet.

    Groups that meet in a band form a cluster.  The nodes of a cluster that meet another group are dealt
    to blocks, and each two blocks are compared in one task: by signature first, likely pairs of
    groups still apart on the full sets.  Only links come out, at most one per node and task.
    """
    rows = written(apart(met, root).select("node", "root", "main").distinct(), "near-apart")
    cluster = components(rows.filter("root != main").select(F.col("root").alias("a"), F.col("main").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    rows = rows.select("node", "root").distinct().join(cluster, "root", "left").withColumn("cluster", F.coalesce("cluster", "root"))
    # a cluster may be most of the rows: only ids meet by cluster, sets and signatures come in by node
    weight = rows.join(sets.select("node", F.octet_length("grams").alias("bytes")), "node")
    size = weight.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = rows.join(size, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.join(sets, "node").join(nodes.select("node", "sig"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "sig", "grams")

    def run(table):
        node, group, own = (table.column(c).to_numpy() for c in ("node", "root", "own"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
        full = [grams_in(g) for g in table.column("grams")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        size, group = np.array([len(g) for g in full]), group.copy()
        a, b = [], []
        for p in np.flatnonzero(own == i):
            to = np.flatnonzero(own == j) if i != j else np.arange(p + 1, len(node))
            to = to[(group[to] != group[p]) & (100 * np.minimum(size[to], size[p]) >= percent * np.maximum(size[to], size[p]))]
            share = equal_share(sig[to], sig[p])
            for k in np.argsort(-share, kind="stable")[: int((share >= LIKELY).sum())]:
                q = to[k]
                if group[q] != group[p] and similar(full[p], full[q], percent):
                    a.append(int(node[p]))
                    b.append(int(node[q]))
                    group[group == group[q]] = group[p]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: ``id, h, n_shingles, component_id`` (the smallest id reachable)."""
    whole_ids(docs, id_col)
    rows = written(signed(docs, id_col, text_col), "near-rows")
    last = F.col("id").isNull()  # a null id comes last
    nodes = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct(last.alias("last"), "id", "h", "n", "bands", "sig")).alias("m"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "m.id", "m.h", "m.bands", "m.sig"), "near-nodes")
    met = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = met.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).filter("size > 1")
    met = written(met.join(shared.select("band", "key", "hub"), ["band", "key"]), "near-met")
    wanted = met.select("node").distinct().join(nodes, "node").select("node", key_of(F.col("id")).alias("key"), "h")
    sets = written(sets_of(docs, id_col, text_col, wanted), "near-sets")
    # first one pair per node; then the other star pairs between groups; then whatever shares a band
    tried = written(likely(best_hub(met), nodes), "near-pairs")
    links = written(verified(tried, sets, percent), "near-links")
    root = components(links)
    star = apart(met, root).filter("node > hub and root != main").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    star = written(likely(star.join(tried, ["a", "b"], "left_anti"), nodes), "near-pairs")
    for find in (lambda: verified(star, sets, percent), lambda: left_over(met, nodes, sets, root, percent)):
        more = written(find(), "near-links")
        if more.limit(1).count():
            links = links.unionByName(more)
            root = components(links)
    least = nodes.join(root, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), F.col("id").isNull().alias("last"), "id")
    least = written(least, "near-least")
    first = least.groupBy("root").agg(F.min(F.struct("last", "id"))["id"].alias("component_id"))
    of = least.join(first, "root").select("digest", "component_id")
    return rows.select("id", "h", "n", "digest").join(of, "digest", "left").select(
        F.col("id").alias(id_col), "h", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group (the one with the smallest id); of rows equal in id and text the one with the
    smallest hash of the whole row, so reruns agree."""
    got = groups(docs, id_col, text_col, percent).filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    key, h = fresh(docs, "_key"), fresh(docs, "_h")
    got = got.select(key_of(F.col(id_col)).alias(key), F.col("h").alias(h)).distinct()
    keyed = docs.withColumn(key, key_of(F.col(id_col))).withColumn(h, F.xxhash64(F.col(text_col).cast("string")))
    first, order = fresh(docs, "_first"), row_hash(docs)
    kept = keyed.join(got, [key, h], "left_semi").groupBy(key, h).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias(first))
    return kept.select(f"{first}.*")


def op5(spark, sf_dir):
    got = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN least_of c ON d.doc_id = c.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""
