"""Source divergence audit: how far the sources of a language differ, and by which terms.

Terms are runs of letters (ASCII, lower-cased) and of all characters beyond ASCII.  A language keeps the
terms that at least ``min_docs`` of its documents hold.  With V kept terms and N their occurrences in
a group (a source of a language) or in the whole language, every kept term has the share
``p = 1 + floor(10**9 * (count + 1) / (N + V))`` there, and ``f = floor((p - q)**2 / q)`` compares two shares.
Everything is whole-number arithmetic (the share by three divisions of remainders, so no product leaves 64 bits
while N + V stays below 9 * 10**15).

Terms of a source: f falls where the group's count falls, or the language's rises, and ties go to the
earlier UTF-8.  So a term that ``k`` others dominate in all three (count not smaller, language's count not
larger, text earlier) cannot be among the first ``k``.  Partitions, sorted by group and text, retain the terms dominated by
fewer than k others (the k-skyband); the skybands of a group are merged by hash parts, then whole, each time
again cut to the skyband; what is left is ranked exactly.  A dominated term's k first dominators
are themselves in the skyband, so only retained terms need be kept at hand: a stream over sorted
rows with the skyband of one group in memory.

Pairs of sources: buckets of about ``TERMS`` terms meet with blocks of ``SOURCES`` sources; a task holds
one bucket's counts for two blocks as a matrix and adds up f for the pairs between them.  Terms that
no source of the two blocks holds enter by one product, and sums of buckets are added by shuffle.

Counts are added up in tasks before the shuffle, so a frequent term leaves ``HELD`` bytes of text as a row per group.
No group's terms or documents meet in one task or on the driver.

Defined results: null text, language and source count as ''; a language without kept terms has V = 0 (pairs
with value 0, no terms); repeated rows are documents of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missaware.llm.common import text_or_empty, written

SCALE_STEPS, SCALE_STEP = 3, 1000  # the scale 10**9 as three factors
#: Bytes of text that a task counts at once, and bytes of a text from which on it is counted alone, in such pieces.
HELD, PIECE = 1 << 24, 1 << 22
#: Terms in a bucket (about) and sources in a block of the pair part; parts of the first merge.
TERMS, SOURCES, MERGE = 2048, 64, 16
#: Rows of the skyband stream at once, terms compared with each other, cells of a table of counts.
CHUNK, STEP, CELLS = 4096, 256, 1 << 20

KINDS, NAMES = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), ["lang", "source", "term", "n", "d"]
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes):
    """Lists of terms of a text, in order."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # on to the next byte that is in no term
            while end < len(text) and LETTERS[text[end]] != 32:
                end += 1
        yield text[at:end].translate(LETTERS).split()
        at = end


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, in order, and every term's text (its place in the array)."""
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2])[off[0] : off[-1]] if off[-1] > off[0] else b""
    off = off - off[0]
    low = np.frombuffer(bytes(raw).translate(LETTERS), np.uint8)
    letter = low != 32
    new = letter.copy()
    new[1:] &= ~letter[:-1]
    edge = off[:-1][off[:-1] < len(low)]
    new[edge] = letter[edge]  # a term ends with its text
    per_text = np.diff(np.searchsorted(np.flatnonzero(new), off))
    data, at = low[letter], np.flatnonzero(new[letter])  # without what lies between, a term ends where the next starts
    ends = np.append(at, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.repeat(np.arange(len(off) - 1), per_text)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def tally(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """``lang, source, term, n, d`` of some texts; a row with the empty term for every group."""
    langs, sources = langs.dictionary_encode(), sources.dictionary_encode()
    wide = len(sources.dictionary)
    groups, group = np.unique(langs.indices.to_numpy().astype(np.int64) * wide + sources.indices.to_numpy(), return_inverse=True)
    found, text = cut(texts)
    found = found.dictionary_encode()
    v = max(1, len(found.dictionary))
    key = np.sort(text * v + found.indices.to_numpy())  # a text's equal terms are one run
    first = runs(key)
    n, key = np.diff(np.append(first, len(key))), key[first]
    key = group[key // v] * v + key % v
    order = np.argsort(key, kind="stable")
    n, key = n[order], key[order]
    first = runs(key)
    d, n, key = np.diff(np.append(first, len(key))), np.add.reduceat(n, first) if len(first) else n, key[first]
    of = groups[np.append(key // v, np.arange(len(groups)))]
    none = np.zeros(len(groups), np.int64)
    whole = [
        langs.dictionary.take(pa.array(of // wide)), sources.dictionary.take(pa.array(of % wide)),
        pa.concat_arrays([found.dictionary.take(pa.array(key % v)), pa.array([b""] * len(groups), pa.binary())]),
        pa.array(np.append(n, none)), pa.array(np.append(d, none)),
    ]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(whole, KINDS, strict=True)], NAMES)


def tally_long(lang: str, source: str, text: bytes) -> pa.RecordBatch:
    """``tally`` of one text, of which only the distinct terms are held."""
    n: Counter = Counter()
    for some in terms(text):
        n.update(some)
    whole = [lang] * (len(n) + 1), [source] * (len(n) + 1), [b"", *n], [0, *n.values()], [0] + [1] * len(n)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(whole, KINDS, strict=True)], NAMES)


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, d``: occurrences and documents, added up within ``HELD`` bytes of a task's texts;
    rows with the empty term for every group."""

    def run(batches):
        def counts():
            held, size = [], 0
            for b in batches:
                b = [b.column(0), b.column(1), b.column(2).cast(pa.binary())]
                sizes = pc.binary_length(b[2]).to_numpy().astype(np.int64)
                if (sizes > PIECE).any():
                    for i in np.flatnonzero(sizes > PIECE).tolist():
                        yield tally_long(*[c[i].as_py() for c in b])
                    b = [c.filter(pa.array(sizes <= PIECE)) for c in b]
                    sizes = sizes[sizes <= PIECE]
                first = runs(np.cumsum(sizes) // HELD).tolist()
                for i, end in zip(first, [*first[1:], len(sizes)], strict=True):
                    held.append([c.slice(i, end - i) for c in b])
                    size += int(sizes[i:end].sum())
                    if size > HELD:
                        yield tally(*[pa.concat_arrays(c) for c in zip(*held, strict=True)])
                        held, size = [], 0
            if held:
                yield tally(*[pa.concat_arrays(c) for c in zip(*held, strict=True)])

        for whole in counts():
            yield from (whole.slice(i, 1 << 16) for i in range(0, whole.num_rows, 1 << 16))

    parts = docs.select(*[text_or_empty(F.col(c)).alias(c) for c in ("lang", "source")], text_or_empty(F.col("text")).cast("binary").alias("text"))
    return parts.mapInArrow(run, "lang string, source string, term binary, n long, d long")


# ---- shares ----------------------------------------------------------------------------


def share(count: Column, total: Column) -> Column:
    """``1 + floor(10**9 * (count + 1) / total)`` digit group by digit group."""
    rest, out = count + F.lit(1), F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        out = out * SCALE_STEP + F.call_function("div", rest * SCALE_STEP, total)
        rest = (rest * SCALE_STEP) % total
    return out + 1


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` in numpy."""
    rest, out = count + 1, 0
    for _ in range(SCALE_STEPS):
        out = out * SCALE_STEP + rest * SCALE_STEP // total
        rest = rest * SCALE_STEP % total
    return out + 1


def apart(p, q):
    return (p - q) * (p - q) // q


# ---- skyband ---------------------------------------------------------------------------


class Band:
    """The skyband of one group's terms, given in order of their text."""

    def __init__(self, k: int):
        self.k, self.high, self.low = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.highs = self.lows = self.table = None
        self.tabled = 0  # members that the table has

    def retable(self) -> None:
        """How many members have at least / at most each pair of counts that occurs."""
        self.highs, g = np.unique(self.high, return_inverse=True)
        self.lows, x = np.unique(self.low, return_inverse=True)
        shape = len(self.highs) + 1, len(self.lows) + 1
        if shape[0] * shape[1] > CELLS:
            self.table, self.tabled = None, 0
            return
        table = np.bincount(g * shape[1] + x + 1, minlength=shape[0] * shape[1]).reshape(shape)
        self.table, self.tabled = table[::-1].cumsum(0)[::-1].cumsum(1), len(self.high)

    def dominators(self, g: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Members that dominate each of the given terms (which come after all members)."""
        if len(self.high) > 1.1 * self.tabled + 64:
            self.retable()
        out = np.zeros(len(g), np.int64)
        if self.tabled:
            out += self.table[np.searchsorted(self.highs, g, "left"), np.searchsorted(self.lows, x, "right")]
        for i in range(self.tabled, len(self.high), CHUNK):
            out += ((self.high[None, i : i + CHUNK] >= g[:, None]) & (self.low[None, i : i + CHUNK] <= x[:, None])).sum(1)
        return out

    def add(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Places of the given terms that fewer than k terms dominate."""
        kept = []
        for i in range(0, len(high), STEP):
            g, x = high[i : i + STEP], low[i : i + STEP]
            by = self.dominators(g, x)
            left = np.flatnonzero(by < self.k)  # a dominated term's dominators dominate what it dominates
            g, x = g[left], x[left]
            left = left[by[left] + np.tril((g[None] >= g[:, None]) & (x[None] <= x[:, None]), -1).sum(1) < self.k]
            kept.append(left + i)
            self.high, self.low = np.concatenate((self.high, high[left + i])), np.concatenate((self.low, low[left + i]))
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """Of every partition and group the terms that fewer than k others of the partition dominate."""

    def run(batches):
        group, band = None, None
        for whole in batches:
            for i in range(0, whole.num_rows, CHUNK):
                b = whole.slice(i, CHUNK)
                high, low = b.column(3).to_numpy(), b.column(4).to_numpy()
                codes = [c.dictionary_encode().indices.to_numpy() for c in b.columns[:2]]
                new = np.flatnonzero((np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)) + 1  # first rows of groups
                keep = []
                for first, end in zip([0, *new.tolist()], [*new.tolist(), len(high)], strict=True):
                    of = b.column(0)[first].as_py(), b.column(1)[first].as_py()
                    if of != group:
                        group, band = of, Band(k)
                    keep.append(band.add(high[first:end], low[first:end]) + first)
                yield b.take(pa.array(np.concatenate(keep)))

    return rows.select("lang", "source", "term", "n", "lang_n").sortWithinPartitions("lang", "source", "term").mapInArrow(run, "lang string, source string, term binary, n long, lang_n long")


def term_part(kept: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """The first ``k`` terms of every group whose share there is above the language's."""
    band = skyband(kept, k)
    band = skyband(band.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(MERGE))), k)
    band = skyband(band.repartition("lang", "source"), k)
    p, q = share(F.col("n"), F.col("total")), share(F.col("lang_n"), F.col("lang_total"))
    rows = band.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").cast("string").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    rows = rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    return ranked(rows).filter(F.col("rank") <= k)


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order))


# ---- pairs -----------------------------------------------------------------------------


def pair_part(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """f summed over the kept terms for every ordered pair of a language's sources, ranked."""
    block = F.floor(F.col("place") / F.lit(SOURCES)).cast("int")
    blocks = F.floor((F.col("sources") - 1) / F.lit(SOURCES)).cast("int")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("v") / F.lit(TERMS))).cast("int")  # of a language

    def met(rows: DataFrame, bucket: Column) -> DataFrame:
        """A row per pair of blocks that its block is in."""
        rows = rows.withColumn("_bucket", bucket).withColumn("_own", block).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks)))
        return rows.select("lang", "_bucket", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), "place", "source", "total", "v", "term", "n")

    rows = kept.select("lang", "source", "term", "n").join(groups, ["lang", "source"])
    marks = groups.withColumns({"term": F.lit(None).cast("binary"), "n": F.lit(0).cast("long")})
    met_rows = met(rows.withColumn("source", F.lit(None).cast("string")), F.pmod(F.xxhash64("term"), buckets).cast("int"))
    met_rows = met_rows.unionByName(met(marks, F.explode(F.sequence(F.lit(0), buckets - 1))))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        mark = t.column("term").is_null()
        m, r = t.filter(mark), t.filter(pc.invert(mark))
        order = np.argsort(m.column("place").to_numpy())
        place, total = m.column("place").to_numpy()[order], m.column("total").to_numpy()[order].astype(np.int64)
        names = m.column("source").take(pa.array(order))
        v, total = int(m.column("v")[0].as_py()), np.maximum(total, 1)
        code = r.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if r.num_rows else np.zeros(0, np.int64)
        count = np.zeros((int(code.max()) + 1 if len(code) else 0, len(place)), np.int64)
        count[code, np.searchsorted(place, r.column("place").to_numpy())] = r.column("n").to_numpy()
        p, base = shares(count, total[None]), shares(np.zeros(len(place), np.int64), total)
        a, b = t.column("_a")[0].as_py(), t.column("_b")[0].as_py()
        absent = (v if t.column("_bucket")[0].as_py() == 0 else 0) - len(p)  # terms in none of these sources, over all buckets
        left, right, value = [], [], []
        own = place // SOURCES
        for s in range(len(place)):
            others = np.flatnonzero((own == (b if own[s] == a else a)) & (np.arange(len(place)) != s))
            left.append(np.full(len(others), s))
            right.append(others)
            value.append(apart(p[:, s : s + 1], p[:, others]).sum(0) + absent * apart(base[s], base[others]) if v else np.zeros(len(others), np.int64))
        left, right, value = (np.concatenate(x).astype(np.int64) for x in (left, right, value))
        lang = pa.repeat(t.column("lang")[0], len(left))
        return pa.table([lang, names.take(pa.array(left)), names.take(pa.array(right)), pa.array(value)], ["lang", "source", "item", "value"])

    sums = met_rows.groupBy("lang", "_bucket", "_a", "_b").applyInArrow(run, "lang string, source string, item string, value long")
    return ranked(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, min_docs: int = 3, first: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: all other sources (part ``pair``) and the ``first`` terms
    (part ``term``) of every source of a language, by falling value."""
    # one shuffle by the language's term serves the counts of its groups and those of the language
    found = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    over, is_term = Window.partitionBy("lang", "term"), F.col("term") != F.lit(b"")
    found = found.withColumns({"lang_n": F.sum("n").over(over), "lang_d": F.sum("d").over(over), "least": F.min("source").over(over)})
    new = (is_term & (F.col("source") == F.col("least"))).cast("long").alias("new")  # one row of every kept term
    found = found.filter(~is_term | (F.col("lang_d") >= min_docs)).select("lang", "source", "term", "n", "lang_n", new)
    found = written(found, "divergence-counts")
    kept = found.filter(is_term).drop("new")

    whole = Window.partitionBy("lang")
    groups = found.groupBy("lang", "source").agg(F.sum("n").alias("sum"), F.sum("new").alias("new"))
    groups = groups.withColumn("v", F.sum("new").over(whole)).select(
        "lang", "source", (F.row_number().over(whole.orderBy("source")) - 1).alias("place"), F.count(F.lit(1)).over(whole).cast("int").alias("sources"),
        "v", (F.col("sum") + F.col("v")).alias("total"), (F.sum("sum").over(whole) + F.col("v")).alias("lang_total"),
    )
    groups = written(groups, "divergence-groups")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_part(kept, groups).withColumn("part", F.lit("pair"))
    return pairs.select(columns).unionByName(term_part(kept, groups, first).withColumn("part", F.lit("term")).select(columns))


def op11(spark, sf_dir):
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
t AS (
  SELECT lang, source, rn, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
lt AS (SELECT lang, term, count(*)::HUGEINT AS lc FROM t GROUP BY lang, term HAVING count(DISTINCT rn) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lc)::HUGEINT AS n FROM lt GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS gc FROM t JOIN lt USING (lang, term) GROUP BY t.lang, t.source, t.term),
ng AS (SELECT lang, source, sum(gc)::HUGEINT AS n FROM gt GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, lt.term, coalesce(gt.gc, 0) AS gc,
         1 + (1000000000::HUGEINT * (coalesce(gt.gc, 0) + 1)) // (coalesce(ng.n, 0) + v.v) AS p,
         1 + (1000000000::HUGEINT * (lt.lc + 1)) // (v.n + v.v) AS q
  FROM g JOIN lt USING (lang) JOIN v USING (lang)
  LEFT JOIN ng ON ng.lang = g.lang AND ng.source = g.source
  LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source AND gt.term = lt.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE gc > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 200
"""
