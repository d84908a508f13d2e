"""Benchmark decontamination: BM25 retrieval of test items by every training passage.

The test items are indexed (term, item, impact), impacts divided by the item's full score, so one
threshold fits all.  Items stand in blocks with the largest impact per term and block.  Every text is
cut into overlapping passages; a passage is a query.  As in block-max WAND, the sum of
block maxima over a passage's terms bounds every score in the block, and only blocks whose bound
reaches the threshold are scored.  Frequent terms are not looked up: they enter the bound with all
they can add in the block, and a block where that alone reaches the threshold is always scored, so
every item above the threshold is found.  What is retrieved is verified: question and answer of the item must both overlap the passage.

Items are grouped by length (up to 64 words, 128, 256, ...), a passage is twice that long and starts
every that many words, so each item fits whole into a passage.  A group's index travels with the tasks;
groups beyond ``INDEX_WORDS`` words are split and searched one after the other, with the statistics of the
whole group, so the parts do not change the scores.

Items of fewer than five words hold no shingle of five: they are found where a whole sentence or line of
a text has just their words.

Defined results: null and empty texts hold no passage; items without words match nothing; repeated items are found alike; repeated rows give repeated results; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from missaware.llm.common import parts_for, written

K1, B = 1.2, 0.75
#: Share of an item's full score a passage must reach, and shares of question and answer to verify.
THRESHOLD, OVERLAP = 0.6, 0.75
SHINGLE, BLOCK, SHORTEST = 5, 4, 64
#: Words of test items in one index at most (about; an index takes some 100 bytes a word).
INDEX_WORDS = 500_000
#: Words handled at once, in whole documents.
TOGETHER = 1 << 18
PARTS = rb"(?<=[.?!])\s+|\n+"  # between sentences or lines
MARKS = b".,;:!?\"'()[]{}<>*#$%&|_-"


def terms(text: bytes | None) -> list[bytes]:
    """Lower-cased words without marks at their ends (a word of marks alone is an empty term)."""
    return [w.strip(MARKS) for w in (text or b"").lower().split()]


def question_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The last sentence or line is the answer; of a single one, the last quarter of its words."""
    parts = [p for p in re.split(PARTS, text.strip()) if p.strip()]
    if len(parts) > 1:
        return terms(b" ".join(parts[:-1])), terms(parts[-1])
    w = terms(text)
    cut = len(w) - max(1, len(w) // 4)
    return w[:cut], w[cut:]


def grams(words: list[bytes], n: int) -> set:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Index:
    stride: int
    ids: list
    questions: list
    answers: list
    vocabulary: dict = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple], stride: int, whole: "Group | None" = None) -> "Index":
        """``items`` are (id, text bytes); ``whole``: the statistics of all items of the group, where these are a part."""
        parts = [question_answer(t) for _, t in items]
        ix = cls(stride, [i for i, _ in items], [q for q, _ in parts], [a for _, a in parts])
        term, item, count = [], [], []
        sizes = []
        for k, (_, text) in enumerate(items):
            of: dict = {}
            words = terms(text)
            sizes.append(len(words))
            for w in words:
                t = ix.vocabulary.setdefault(w, len(ix.vocabulary))
                of[t] = of.get(t, 0) + 1
            term.extend(of)
            count.extend(of.values())
            item.extend([k] * len(of))
        term, item, tf, n = np.array(term), np.array(item), np.array(count, float), len(items)
        ix.n_terms, ix.n_blocks = len(ix.vocabulary), -(-n // BLOCK)
        df, n_all = np.bincount(term, minlength=ix.n_terms), n
        size = np.array(sizes, float)
        mean = size.mean()
        if whole is not None:
            df, n_all, mean = np.array([whole.df[w] for w in ix.vocabulary]), whole.n, whole.words / whole.n
        idf = np.log(1 + (n_all - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean))
        impact /= np.bincount(item, impact, n)[item]
        # block maxima per term, and all postings by block
        block = item // BLOCK
        key, where = np.unique(term * ix.n_blocks + block, return_inverse=True)
        top = np.zeros(len(key))
        np.maximum.at(top, where, impact)
        ix.max_block, ix.max_value, ix.max_at = key % ix.n_blocks, top, np.searchsorted(key // ix.n_blocks, np.arange(ix.n_terms + 1))
        rare = np.diff(ix.max_at) <= max(2, ix.n_blocks // 20)
        ix.rare = rare
        # what frequent terms can add to a score in each block
        often = np.bincount(item[~rare[term]], impact[~rare[term]], n)
        ix.often = np.zeros(ix.n_blocks)
        np.maximum.at(ix.often, np.arange(n) // BLOCK, often)
        order = np.argsort(block, kind="stable")
        ix.post_term, ix.post_item, ix.post_impact = term[order], item[order], impact[order]
        ix.post_at = np.searchsorted(block[order], np.arange(ix.n_blocks + 1))
        ix.gram_sizes = [min(SHINGLE, len(q)) for q in ix.questions]
        ix.question_grams, ix.answer_sets = [grams(q, k) for q, k in zip(ix.questions, ix.gram_sizes, strict=True)], [set(a) for a in ix.answers]
        return ix

    def scores(self, present: np.ndarray, block: int):
        """(first item of the block, scores of its items) for the terms marked in ``present``."""
        lo, hi, first = self.post_at[block], self.post_at[block + 1], block * BLOCK
        here = present[self.post_term[lo:hi]]
        return first, np.bincount(self.post_item[lo:hi][here] - first, self.post_impact[lo:hi][here], BLOCK)

    def verify(self, item: int, words: list[bytes]) -> tuple[float, float]:
        q, a = self.question_grams[item], self.answer_sets[item]
        return (len(q & grams(words, self.gram_sizes[item])) / len(q) if q else 1.0), len(a & set(words)) / len(a)

    def find(self, texts: list):
        """Yields (text, item, first word of the passage, score, question and answer overlap)."""
        for first, docs in together(texts):
            for d, *rest in self.search(docs):
                yield first + d, *rest

    def search(self, docs: list[list[bytes]]):
        """Yields (document, item, first word of the passage, score, question and answer overlap)."""
        n = [len(w) for w in docs]
        get = self.vocabulary.get
        t = np.fromiter((get(w, -1) for d in docs for w in d), np.int64, sum(n))
        doc = np.repeat(np.arange(len(docs)), n)
        inside = np.arange(len(t)) - np.repeat(np.cumsum([0, *n[:-1]]), n)
        runs = [-(-x // self.stride) for x in n]  # pieces of stride words; two neighbours are a passage
        base = np.cumsum([0, *runs])
        known = t >= 0
        piece = base[doc[known]] + inside[known] // self.stride
        of_piece = np.repeat(np.arange(len(docs)), runs)
        code = np.unique(piece * self.n_terms + t[known])
        piece, term = code // self.n_terms, code % self.n_terms
        n_pieces = int(base[-1])
        if not len(code):
            return
        joined = np.append(of_piece[1:] == of_piece[:-1], False)  # has a second piece
        # bounds over rare terms: each posting counts for the passage of its piece and the one before
        rare = self.rare[term]
        p, w = piece[rare], term[rare]
        length = self.max_at[w + 1] - self.max_at[w]
        at = np.repeat(self.max_at[w] - np.cumsum(length) + length, length) + np.arange(length.sum())
        p, block, value = np.repeat(p, length), self.max_block[at], self.max_value[at]
        second = (p > 0) & joined[p - 1]
        p, block, value = np.concatenate((p, p[second] - 1)), np.concatenate((block, block[second])), np.concatenate((value, value[second]))
        key, where = np.unique(p * self.n_blocks + block, return_inverse=True)
        key = key[np.bincount(where, value, len(key)) + self.often[key % self.n_blocks] >= THRESHOLD - 1e-9]
        always = np.flatnonzero(self.often >= THRESHOLD - 1e-9)
        if len(always):
            key = np.unique(np.concatenate((key, (np.arange(n_pieces)[:, None] * self.n_blocks + always).ravel())))
        present, last = np.zeros(self.n_terms, bool), -1
        edges = np.searchsorted(piece, np.arange(n_pieces + 1))
        for k in key.tolist():
            passage, block = divmod(k, self.n_blocks)
            if passage != last:
                present[:] = False
                present[term[edges[passage] : edges[passage + 1 + int(joined[passage])]]] = True
                last = passage
            first, score = self.scores(present, block)
            for i in np.flatnonzero(score >= THRESHOLD - 1e-9).tolist():
                d = int(of_piece[passage])
                start = (passage - int(base[d])) * self.stride
                q, a = self.verify(first + i, docs[d][start : start + 2 * self.stride])
                if q >= OVERLAP and a >= OVERLAP:
                    yield d, first + i, start, float(score[i]), q, a


@dataclass
class Group:
    """Statistics of all items of a length group: items, words, and items per term."""

    n: int
    words: int
    df: dict


class Short:
    """Items of fewer than five words: found where a whole sentence or line of a text has the same words."""

    def __init__(self, items: list[tuple]):
        self.ids, self.of = [i for i, _ in items], {}
        for k, (_, text) in enumerate(items):
            words = tuple(w for w in terms(text) if w)
            if words:
                self.of.setdefault(words, []).append(k)

    def find(self, texts: list):
        for d, text in enumerate(texts):
            at = 0
            for part in re.split(PARTS, text or b""):
                words = terms(part)
                for k in self.of.get(tuple(w for w in words if w), ()) if len(words) < 2 * SHINGLE else ():
                    yield d, k, at, 1.0, 1.0, 1.0
                at += len(words)


def group_terms(rows: DataFrame) -> DataFrame:
    """``stride, term, n, words`` of items ``stride, t``: a row per term, and one without a term for the group."""

    def run(batches):
        for b in batches:
            out: dict = {}
            for stride, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words = terms(text)
                for key, size in [((stride, None), len(words)), *[((stride, w), 0) for w in set(words)]]:
                    n, total = out.get(key, (0, 0))
                    out[key] = n + 1, total + size
            columns = [[s for s, _ in out], [w for _, w in out], [n for n, _ in out.values()], [w for _, w in out.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["stride", "term", "n", "words"])

    found = rows.select("stride", "t").mapInArrow(run, "stride long, term binary, n long, words long")
    return found.groupBy("stride", "term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def indexes(items: DataFrame, id_col: str, text_col: str, index_words: int = INDEX_WORDS):
    """One index after the other; each is bounded, whatever the number of items.  Scores do not depend on
    the parts: statistics are those of a whole length group."""
    n = F.coalesce(F.size(F.filter(F.split(F.col(text_col).cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0))
    stride = F.greatest(F.lit(float(SHORTEST)), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))).cast("long")
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").cast("binary").alias("t"), n.alias("n")).filter("n > 0")
    rows = rows.withColumn("stride", F.when(F.col("n") >= SHINGLE, stride).otherwise(F.lit(0).cast("long")))
    groups = sorted(tuple(r) for r in rows.groupBy("stride").agg(F.sum("n")).collect())
    stats = written(group_terms(rows.filter("stride > 0")), "leak-terms") if any(parts_for(w, index_words) > 1 for _, w in groups) else None
    for stride_, words in groups:
        parts = parts_for(words, index_words)
        whole = stats.filter((F.col("stride") == stride_) & F.col("term").isNull()).first() if parts > 1 and stride_ else None
        for part in range(parts):
            own = rows.filter((F.col("stride") == stride_) & (F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part))
            found = [(r["i"], bytes(r["t"])) for r in own.orderBy("i", "t").collect()]  # about index_words words
            if found and not stride_:
                yield Short(found)
            elif found and whole is None:
                yield Index.build(found, stride_)
            elif found:
                df = stats.join(group_terms(own).filter("term is not null").select("stride", "term"), ["stride", "term"]).collect()
                yield Index.build(found, stride_, Group(whole["n"], whole["words"], {bytes(r["term"]): r["n"] for r in df}))


def together(texts: list):
    """Runs of documents with about TOGETHER words, as (first, lists of terms)."""
    docs, held, first = [], 0, 0
    for i, t in enumerate(texts):
        docs.append(terms(t))
        held += len(docs[-1])
        if held >= TOGETHER:
            yield first, docs
            docs, held, first = [], 0, i + 1
    if docs:
        yield first, docs


FOUND = [("passage_start", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index_words: int = INDEX_WORDS) -> DataFrame:
    """``id, item_id`` and the best passage of every leaked item of every row."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, `{item_id}` {item_kind}, passage_start long, score double, question_overlap double, answer_overlap double"
    item_type = to_arrow_type(items.schema[item_id].dataType)
    one = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary"))
    out = docs.sparkSession.createDataFrame([], ddl)
    for index in indexes(items, item_id, item_text, index_words):

        def run(batches, ix=index):
            for b in batches:
                best: dict = {}
                for d, i, *rest in ix.find(b.column(1).to_pylist()):
                    if (d, i) not in best or rest[1] > best[d, i][1]:
                        best[d, i] = rest
                rows = sorted(best.items())
                if rows:
                    ids, found = b.column(0).take(pa.array([d for (d, _), _ in rows], pa.int64())), pa.array([ix.ids[i] for (_, i), _ in rows], item_type)
                    yield pa.RecordBatch.from_arrays([ids, found, *[pa.array([v[j] for _, v in rows], t) for j, (_, t) in enumerate(FOUND)]], [id_col, item_id, *[c for c, _ in FOUND]])

        out = out.unionByName(one.mapInArrow(run, ddl))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows in which no item is found, all columns as they are."""
    at = docs.columns.index(text_col)
    for index in indexes(items, item_id, item_text):

        def run(batches, ix=index):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                texts = b.column(at).cast(pa.binary()).to_pylist()
                for d, *_ in ix.find(texts):
                    keep[d] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find(docs, items)
