"""Ranked lexical search with range-maximum tables.

``build`` makes an inverted index of every document: tasks cut their documents into shards of about
``SHARD_TERMS`` terms, sorted by id; a row of the index is a term of a shard with the places of its documents and
its occurrences there, and one row (the empty term) has the shard's document ids and sizes.  Nothing is
shuffled to build it, and no term's list over all documents ever meets in one task.

``search`` ranks all documents for each item.  With N documents that have a term, L terms in all, a document
of n terms and a term in df documents, tf times in this one::

    w = floor(1000 * ln((2 N + 2) / (2 df + 1)))    m = 10 + (90 n N) div L
    score = sum of w * ((10**9 tf) div (1000 tf + 8 m)) over the item's distinct terms

The lists of the items' terms go to one task per shard, which works out all impacts and a sparse
table of range maxima per list.  An item's documents are then searched best first: an interval of
documents is bounded by the sum of its lists' range maxima; the interval with the largest bound is split at the
document of its largest single impact, which is scored exactly, and the two sides get bounds of
their own; intervals of ``LEAF`` documents are scored whole.  The search ends where no bound reaches the
``k``-th score, so each shard returns exactly its best k; the best k of these are the answer.

Items are searched in blocks of about ``BLOCK_TERMS`` (item, term) pairs: only one block at a time is on the
driver and travels with the tasks, whatever the number of items; the index is built once for all of them.

Defined results: null and empty texts have no terms and are never found; equal scores stand by id
(null first); rows with equal ids are documents of their own; items with equal ids are one item with
the terms of all; items without terms, or whose terms no document has, find nothing; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from missaware.llm.common import parts_for, text_or_empty, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms (with repeats) in a shard, about; a longer document is a shard of its own.  Pairs in a block of items.
SHARD_TERMS, BLOCK_TERMS = 1 << 22, 200_000
#: Documents of an interval that is scored whole; rows of the index in one batch; bytes of text cut at once.
LEAF, ROWS, PIECE = 64, 1 << 14, 1 << 22

LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None):
    """Lists of terms of a text, in order."""
    text, at = text or b"", 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # on to the next byte that is in no term
            while end < len(text) and LETTERS[text[end]] != 32:
                end += 1
        yield text[at:end].translate(LETTERS).split()
        at = end


# ---- index -----------------------------------------------------------------------------


class Shard:
    """Documents of a task, until they are an index shard."""

    def __init__(self):
        self.vocabulary, self.ids, self.codes, self.sizes, self.total = {}, [], [], [], 0

    def add(self, doc_id: pa.Array, text: bytes | None) -> None:
        known, n = self.vocabulary, 0
        codes = []
        for some in terms(text):
            for t in set(some).difference(known):
                known[t] = len(known)
            codes.append(np.fromiter(map(known.__getitem__, some), np.int32, len(some)))
            n += len(some)
        self.ids.append(doc_id)
        self.codes.append(np.concatenate(codes) if codes else np.zeros(0, np.int32))
        self.sizes.append(n)
        self.total += n

    def batches(self, number: int, id_type: pa.DataType):
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        sizes = np.array(self.sizes, np.int64)[order]
        names = sorted(self.vocabulary)
        rank = np.empty(len(names), np.int64)
        rank[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        code = np.concatenate([rank[self.codes[i]] * len(order) + place for place, i in enumerate(order)]) if names else np.zeros(0, np.int64)
        code, tf = np.unique(code, return_counts=True)
        docs, edges = (code % len(order)).astype(np.int32), np.searchsorted(code // len(order), np.arange(len(names) + 1))
        tf = tf.astype(np.int64)

        def rows(term, edges, docs, tf, ids, sizes, with_terms):
            n, lists = len(term), lambda x: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x))
            columns = [pa.array(np.full(n, number, np.int64)), pa.array(term, pa.binary()), lists(docs), lists(tf), ids, sizes, pa.array(with_terms, pa.int64()), pa.array(np.diff(edges), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "term", "docs", "tfs", "ids", "sizes", "n_docs", "df"])

        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        yield rows([b""], np.zeros(2, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), one(ids.take(pa.array(order)).cast(id_type)), one(pa.array(sizes)), [int((sizes > 0).sum())])
        for i in range(0, len(names), ROWS):
            some = edges[i : i + ROWS + 1]
            n = len(some) - 1
            yield rows(names[i : i + n], some - some[0], docs[some[0] : some[-1]], tf[some[0] : some[-1]], pa.nulls(n, pa.list_(id_type)), pa.nulls(n, pa.list_(pa.int64())), [None] * n)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: ``shard, term, docs, tfs, df`` per term of a shard, and per shard a row of the empty term
    with ``ids, sizes, n_docs`` (documents with a term)."""
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        shard, made = Shard(), 0
        for b in batches:
            for i, text in enumerate(b.column(1)):
                shard.add(b.column(0).slice(i, 1), text.as_py())
                if shard.total >= SHARD_TERMS or len(shard.ids) >= SHARD_TERMS // 16:
                    yield from shard.batches(TaskContext.get().partitionId() << 32 | made, id_type)
                    shard, made = Shard(), made + 1
        if shard.ids:
            yield from shard.batches(TaskContext.get().partitionId() << 32 | made, id_type)

    one = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary"))
    schema = f"shard long, term binary, docs array<int>, tfs array<long>, ids array<{kind.simpleString()}>, sizes array<long>, n_docs long, df long"
    return written(one.mapInArrow(run, schema), "search-index")


# ---- search in a shard -----------------------------------------------------------------


class Lists:
    """Posting lists of one shard, one after the other, with range maxima; places are documents."""

    def __init__(self, edges: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_docs: int):
        self.edges, self.docs, self.impact, self.n_docs = edges, docs, impact, n_docs
        self.keys = np.repeat(np.arange(len(edges) - 1), np.diff(edges)) * (n_docs + 1) + docs
        longest = int(np.diff(edges).max(initial=1))
        # table[k][i]: the place of the largest of 2**k impacts from i on
        self.table = [np.arange(len(docs), dtype=np.int32)]
        for k in range(longest.bit_length() - 1):
            a, half = self.table[-1], 1 << k
            b = np.concatenate((a[half:], a[max(0, len(a) - half) :]))[: len(a)]
            self.table.append(np.where(impact[b] > impact[a], b, a))
        self.table = np.stack(self.table)
        self.log = np.zeros(longest + 1, np.int64)
        for n in range(2, longest + 1):
            self.log[n] = self.log[n // 2] + 1

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of the largest impact of each (not empty) range of a list."""
        k = self.log[hi - lo]
        a, b = self.table[k, lo], self.table[k, hi - (1 << k)]
        return np.where(self.impact[b] > self.impact[a], b, a)

    def sums(self, lo: np.ndarray, hi: np.ndarray, first: int, n: int) -> np.ndarray:
        """Scores of n documents from ``first`` on, given their ranges of the lists."""
        length = hi - lo
        at = np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())
        out = np.zeros(n, np.int64)
        np.add.at(out, self.docs[at] - first, self.impact[at])
        return out

    def best(self, of: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, document) of the k best for the lists ``of``, best first."""
        found: list = []  # heap of (score, -document), the worst first
        queue: list = []

        def put(score: int, doc: int) -> None:
            if score > 0 and (len(found) < k or (score, -doc) > found[0]):
                (heapq.heappush if len(found) < k else heapq.heapreplace)(found, (score, -doc))

        def open_(of, lo, hi, first, end) -> None:
            some = hi > lo
            if not some.any():
                return
            if not some.all():
                of, lo, hi = of[some], lo[some], hi[some]
            at = self.largest(lo, hi)
            impact = self.impact[at]
            bound = int(impact.sum())
            if bound > 0 and not (len(found) == k and (bound, -first) < found[0]):
                heapq.heappush(queue, (-bound, first, end, int(self.docs[at[impact.argmax()]]), len(queue), of, lo, hi))

        open_(of, self.edges[of], self.edges[of + 1], 0, self.n_docs)
        while queue:
            bound, first, end, split, _, of, lo, hi = heapq.heappop(queue)
            if len(found) == k and (-bound, -first) < found[0]:
                break  # no other has a larger bound, or an equal one and an earlier document
            if end - first <= LEAF:
                score = self.sums(lo, hi, first, end - first)
                for d in np.flatnonzero(score >= (found[0][0] if len(found) == k else 1)).tolist():
                    put(int(score[d]), first + d)
                continue
            mid = np.searchsorted(self.keys, of * (self.n_docs + 1) + split)
            there = np.zeros(len(of), bool)
            inside = mid < hi
            there[inside] = self.docs[mid[inside]] == split
            put(int(self.impact[mid[there]].sum()), split)
            open_(of, lo, mid, first, split)
            open_(of, mid + there, hi, split + 1, end)
        return [(s, -d) for s, d in sorted(found, reverse=True)]


def sizes_factor(n: np.ndarray, n_all: int, l_all: int) -> np.ndarray:
    """``10 + (90 n N) div L``, with Python's numbers where 64 bits would not do."""
    if int(n.max(initial=0)) * 90 * n_all < 2**63:
        return 10 + 90 * n * n_all // l_all
    return np.array([10 + 90 * x * n_all // l_all for x in n.tolist()], np.int64)


# ---- search ----------------------------------------------------------------------------


def wanted(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, term``: the distinct terms of every item."""
    found = F.regexp_extract_all(text_or_empty(F.col(text_col)), F.lit(TERM), F.lit(0))
    raw = items.select(F.col(id_col).alias("item"), F.explode(found).alias("term"))
    return raw.select("item", F.translate("term", UPPER, LOWER).cast("binary").alias("term")).distinct()


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", found_id: str = "doc_id") -> DataFrame:
    """``id_col, rank, found_id, score``: the k best documents of every item."""
    spark = index.sparkSession
    doc_kind, item_kind = index.schema["ids"].dataType.elementType.simpleString(), items.schema[id_col].dataType.simpleString()
    shards = F.col("term") == F.lit(b"")
    n_all, l_all = index.filter(shards).agg(F.sum("n_docs"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    pairs = written(wanted(items, id_col, text_col), "search-items")
    blocks = parts_for(pairs.count(), BLOCK_TERMS)
    out = spark.createDataFrame([], f"item {item_kind}, rank int, doc {doc_kind}, score long")
    for block in range(blocks if n_all else 0):
        own = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = _search_block(index, own, n_all, l_all, k, doc_kind, item_kind)
        out = out.unionByName(written(found, "search-found"))
    return out.select(F.col("item").alias(id_col), "rank", F.col("doc").alias(found_id), "score")


def _search_block(index: DataFrame, pairs: DataFrame, n_all: int, l_all: int, k: int, doc_kind: str, item_kind: str) -> DataFrame:
    spark = index.sparkSession
    of: dict = {}
    for r in pairs.collect():  # about BLOCK_TERMS pairs
        of.setdefault(r["item"], []).append(bytes(r["term"]))
    number = {t: i for i, t in enumerate(sorted({t for ts in of.values() for t in ts}))}
    numbers = F.broadcast(spark.createDataFrame([(b"", -1), *number.items()], "term binary, _t int"))  # the block's terms
    rows = index.join(numbers, "term")
    weight = np.zeros(len(number), np.int64)
    for t, df in rows.filter("_t >= 0").groupBy("_t").agg(F.sum("df")).collect():
        weight[t] = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1)))
    item_ids = pa.array(list(of), to_arrow_type(pairs.schema["item"].dataType))
    queries = [np.array(sorted(number[t] for t in ts), np.int64) for ts in of.values()]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_t").combine_chunks()
        ids, sizes = (t.column(c)[0].values for c in ("ids", "sizes"))
        ts, postings = t.column("_t").to_numpy()[1:], t.slice(1)
        docs, tf = (pc.list_flatten(postings.column(c)).to_numpy().astype(np.int64) for c in ("docs", "tfs"))
        edges = np.concatenate(([0], np.cumsum(pc.list_value_length(postings.column("docs")).to_numpy()))).astype(np.int64)
        m = sizes_factor(sizes.to_numpy(), n_all, l_all)
        impact = np.repeat(weight[ts], np.diff(edges)) * (10**9 * tf // (1000 * tf + 8 * m[docs]))
        place = np.full(len(weight), -1)
        place[ts] = np.arange(len(ts))
        lists = Lists(edges, docs, impact, len(sizes))
        item, doc, score = [], [], []
        for i, q in enumerate(queries if len(docs) else []):
            here = place[q]
            for s, d in lists.best(here[here >= 0], k):
                item.append(i)
                doc.append(d)
                score.append(s)
        return pa.table([item_ids.take(pa.array(item, pa.int64())), ids.take(pa.array(doc, pa.int64())), pa.array(score, pa.int64())], ["item", "doc", "score"])

    per_shard = rows.select("shard", "_t", "docs", "tfs", "ids", "sizes").groupBy("shard").applyInArrow(run, f"item {item_kind}, doc {doc_kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    return per_shard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "doc", "score")


def op13(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(build(docs), items)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
tok AS (
  SELECT doc_id, rn, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
size AS (SELECT rn, count(*)::BIGINT AS n FROM tok GROUP BY rn),
alls AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM size),
m AS (SELECT rn, 10 + (90 * n * big_n) // big_l AS m FROM size, alls),
item AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM benchmark),
tf AS (SELECT doc_id, rn, term, count(*)::BIGINT AS tf FROM tok WHERE term IN (SELECT term FROM item) GROUP BY doc_id, rn, term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, alls GROUP BY term, big_n),
scored AS (
  SELECT item_id, doc_id, rn, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rn) GROUP BY item_id, doc_id, rn)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
