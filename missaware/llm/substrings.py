"""Substring dedup by difference-cover anchors.

A window of 20 words is repeated where the same words also start earlier (smaller id, or earlier in
the same document); every word that a repeated window covers is removed.

Anchors: the positions of a document whose number modulo 13 lies in {0, 1, 3, 9}.  Every difference
modulo 13 is a difference of two of these, so two equal windows of 20 words share, at one of the 13
first offsets, an anchor position in both; the 8 words from there lie inside the windows.  So the
first round hashes 8 words at 4 of 13 positions only and finds the anchors that occur again.  The
second round extends: only windows of 20 words around such an anchor are hashed and
compared over the whole corpus.  The third marks and removes.

Documents are dealt to blocks by id.  A block sends each hash once (however often it holds it),
packed by hash range, and gets one bit per hash back, so a passage that fills a third of the corpus
is one entry per block, and texts move once (all rounds read the same exchange).  Blocks and ranges
grow with the input; a task holds a few of either.

Defined results: a null text has no words; texts under 20 words lose nothing; a null id comes after
all others; rows with the same id are ordered by text; an empty table gives no rows; other columns
are ignored.  Windows count as equal when 96 bits of hash are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missaware.llm.common import parts_for, text_bytes, whole_ids
from missaware.llm.grams import WordHashes, hashed, windows

WINDOW, PERIOD = 20, 13
COVER = np.isin(np.arange(PERIOD), (0, 1, 3, 9))
ANCHOR = WINDOW - PERIOD + 1
#: Text bytes of a block, and the most hash ranges (beyond 65,536 blocks the ranges grow instead).
BLOCK_BYTES, MAX_RANGE_BITS = 16 << 20, 16
PACKED = "range int, block int, packed binary"
ANSWER = "block int, step int, range int, bits binary"


class Block:
    """The documents of a block in order of id, their words' hashes in one array."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] or b"" for i in order]
        known = WordHashes()
        each = [hashed(t.split(), known) for t in self.texts]
        self.sizes = np.array([len(x) for x in each], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.words = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(each)), self.sizes)

    def whole(self, size: int) -> np.ndarray:
        """Whether a window of that size starts here and ends in the same document."""
        out = np.zeros(len(self.doc), bool)
        if len(out) >= size:
            out[: len(out) - size + 1] = self.doc[: len(out) - size + 1] == self.doc[size - 1 :]
        return out

    def anchors(self, bits: int):
        """Positions of anchors and their keys of 32 + bits bits."""
        inside = np.arange(len(self.doc)) - self.starts[self.doc]
        at = np.flatnonzero(self.whole(ANCHOR) & COVER[inside % PERIOD])
        return at, windows(self.words, ANCHOR, 0, at) >> np.uint64(32 - bits)

    def shared(self, bits: int, answers: dict) -> np.ndarray:
        """Starts of the 20-word windows that hold an anchor found again."""
        at, key = self.anchors(bits)
        unique, where, n = np.unique(key, return_inverse=True, return_counts=True)
        again = (n > 1) | told(unique >> np.uint64(32), answers)
        hit = at[again[where]] if len(at) else at
        edge = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(edge, np.maximum(0, hit - (PERIOD - 1)), 1)
        np.add.at(edge, hit + 1, -1)
        return np.flatnonzero((np.cumsum(edge)[:-1] > 0) & self.whole(WINDOW))

    def keys(self, at: np.ndarray):
        """Of the windows there: order by hash, which are the first of their hash, and both hashes in that order."""
        a, b = windows(self.words, WINDOW, 0, at), (windows(self.words, WINDOW, 1, at) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return order, first, a, b


def told(ranges: np.ndarray, answers: dict) -> np.ndarray:
    """The bits that came back for sorted keys, given each key's range."""
    out = np.zeros(len(ranges), bool)
    for r, bits in answers.items():
        lo, hi = np.searchsorted(ranges, np.uint64(r), "left"), np.searchsorted(ranges, np.uint64(r), "right")
        out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def answers_of(table: pa.Table, step: int) -> dict:
    return {r: b for s, r, b in zip(*(table.column(c).to_pylist() for c in ("step", "range", "bits")), strict=True) if s == step}


def sent(block: int, ranges: np.ndarray, pack) -> pa.Table:
    """One row per hash range; ``pack(lo, hi)`` has the bytes of the sorted keys there."""
    r, lo = np.unique(ranges, return_index=True)
    hi = np.concatenate((lo[1:], [len(ranges)])) if len(r) else lo
    return pa.table({"range": pa.array(r.astype(np.int32)), "block": pa.array(np.full(len(r), block, np.int32)), "packed": pa.array([pack(i, j) for i, j in zip(lo, hi, strict=True)], pa.binary())})


def answer(table: pa.Table, step: int, sizes: list[int], flags: np.ndarray) -> pa.Table:
    """A row of bits for every block that has a bit set."""
    at, rows = 0, []
    r = table.column("range")[0].as_py() if table.num_rows else 0
    for block, n in zip(table.column("block").to_pylist(), sizes, strict=True):
        if flags[at : at + n].any():
            rows.append((block, np.packbits(flags[at : at + n]).tobytes()))
        at += n
    return pa.table({"block": pa.array([b for b, _ in rows], pa.int32()), "step": pa.array([step] * len(rows), pa.int32()), "range": pa.array([r] * len(rows), pa.int32()), "bits": pa.array([b for _, b in rows], pa.binary())})


def met_anchors(table: pa.Table) -> pa.Table:
    """A hash range of round 1: which keys more than one block sent."""
    parts = [np.frombuffer(b, np.uint32) for b in table.column("packed").to_pylist()]
    _, where, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    return answer(table, 1, [len(p) for p in parts], (n > 1)[where])


WINDOW_KEY = np.dtype([("a", "<u8"), ("b", "<u4"), ("id", "<i8"), ("null", "u1")])


def met_windows(table: pa.Table) -> pa.Table:
    """A hash range of round 2: which windows another block has in a smaller id."""
    parts = [np.frombuffer(b, WINDOW_KEY) for b in table.column("packed").to_pylist()]
    k = np.concatenate(parts)
    order = np.lexsort((k["id"], k["null"], k["b"], k["a"]))
    a, b = k["a"][order], k["b"][order]
    later = np.zeros(len(k), bool)
    later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])  # an id is in one block, so ids differ here
    flags = np.zeros(len(k), bool)
    flags[order] = later
    return answer(table, 2, [len(p) for p in parts], flags)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id, n_words, n_removed, kept_text`` (binary; kept words joined by one space) for every row."""
    whole_ids(docs, id_col)
    # no fewer blocks than shuffle partitions, so small inputs use all of them too
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = parts_for(text_bytes(docs, text_col), block_bytes, least)
    bits = min(MAX_RANGE_BITS, max(0, (n_blocks - 1).bit_length()))
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)).cast("int").alias("block"))

    def round1(table):
        _, key = Block(table).anchors(bits)
        key = np.unique(key)
        low = key.astype(np.uint32)
        return sent(table.column("block")[0].as_py(), key >> np.uint64(32), lambda i, j: low[i:j].tobytes())

    def round2(left, right):
        block = Block(left)
        at = block.shared(bits, answers_of(right, 1))
        order, first, a, b = block.keys(at)
        doc = block.doc[at[order[first]]]
        k = np.zeros(len(doc), WINDOW_KEY)
        ids = np.array([i or 0 for i in block.ids], np.int64)
        k["a"], k["b"], k["id"], k["null"] = a[first], b[first], ids[doc], np.array([i is None for i in block.ids])[doc]
        return sent(left.column("block")[0].as_py(), range_of(k["a"], bits), lambda i, j: k[i:j].tobytes())

    def round3(left, right):
        block = Block(left)
        at = block.shared(bits, answers_of(right, 1))
        order, first, a, _ = block.keys(at)
        repeated = ~first
        repeated[first] = told(range_of(a[first], bits), answers_of(right, 2))
        hit = at[order[repeated]]
        edge = np.zeros(len(block.doc) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
        gone = np.cumsum(edge)[:-1] > 0
        n_removed, kept = [], []
        for text, i, j in zip(block.texts, block.starts[:-1], block.starts[1:], strict=True):
            words, out = text.split(), gone[i:j]
            n = int(out.sum())
            n_removed.append(n)
            kept.append(b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x] if n else words))
        return pa.table({"id": pa.array(block.ids, pa.int64()), "n_words": pa.array(block.sizes), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary())})

    by_block = dealt.groupBy("block")
    met1 = by_block.applyInArrow(round1, PACKED).groupBy("range").applyInArrow(met_anchors, ANSWER)
    met2 = by_block.cogroup(met1.groupBy("block")).applyInArrow(round2, PACKED).groupBy("range").applyInArrow(met_windows, ANSWER)
    out = by_block.cogroup(met1.unionByName(met2).groupBy("block")).applyInArrow(round3, "id long, n_words long, n_removed long, kept_text binary")
    return out.withColumnRenamed("id", id_col)


def range_of(a: np.ndarray, bits: int) -> np.ndarray:
    return a >> np.uint64(64 - bits) if bits else np.zeros(len(a), np.uint64)


def op4(spark, sf_dir):
    got = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
windows AS (
  SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k FROM places),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM windows WHERE pos <= n - 19),
gone AS (SELECT DISTINCT doc_id, pos + o AS pos FROM ranked, range(0, 20) r(o) WHERE nth > 1),
kept AS (
  SELECT p.doc_id, count(g.pos) AS n_removed, string_agg(p.word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS text
  FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
