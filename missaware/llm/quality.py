"""Quality classifier: random-indexing word vectors and a two-layer network.

Random indexing: each token has a sparse ternary index vector drawn from a seed; a token's context
vector is the sum of its neighbours' index vectors over the whole corpus.  Tokens are hashed
into a fixed table, so the table, which is all that reaches the driver, has a fixed size (about
8,256 x 32 numbers).  A token counts twice: as its lower-cased form and as its shape (capitals,
digits, which symbol).  A document's vector is the mean of its tokens' (unit-length) vectors.

Network: one hidden layer and a logistic output in numpy, fitted on the driver on
about ``max_rows`` labelled documents (16,384, chosen by hash; all where there are fewer), a fifth of them
kept aside to fit the temperature that calibrates the probabilities.  Every document is scored, on
its whole text.  Labels, language, source and id are not inputs.

Defined results: null and empty text have the zero vector and get a score; a null id is held out or
not like the empty text; repeated rows get equal scores; several labels of one id count by their
largest; without labels of both kinds the score is the share of ones (0.5 without labels); other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missaware.llm.common import id_mod, written

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x20\x09-\x0D0-9A-Za-z\x80-\xff]+")
SHAPES = 64
CHUNK = 1 << 16  # tokens handled at once, so long texts take no more memory


@dataclass(frozen=True)
class Settings:
    buckets: int = 8192
    dims: int = 32
    nonzero: int = 4
    hidden: int = 16
    steps: int = 300
    max_rows: int = 16384
    seed: int = 11


DEFAULT = Settings()


class Ids(dict):
    """Token to ``bucket * SHAPES + shape``; forgets all when it holds a million tokens."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, t: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        if t[0] >= 128 or t.isalpha():
            shape = 2 if len(t) > 1 and t.isupper() else 1 if t[:1].isupper() else 0 if t.islower() else 3
        else:
            shape = 4 if t.isdigit() else 5 + zlib.crc32(t[:3]) % (SHAPES - 5)
        self[t] = at = zlib.crc32(t.lower()) % self.buckets * SHAPES + shape
        return at


def token_ids(text: bytes | None, ids: Ids):
    """Arrays of at most CHUNK ids, in order."""
    found = TOKEN.findall(text or b"")
    for i in range(0, len(found), CHUNK):
        part = found[i : i + CHUNK]
        yield np.fromiter(map(ids.__getitem__, part), np.int64, len(part))


def index_vectors(n: int, s: Settings) -> np.ndarray:
    """n sparse ternary rows; a row is places and signs, dense here."""
    rng = np.random.default_rng(s.seed)
    places = np.argsort(rng.random((n, s.dims)), axis=1)[:, : s.nonzero]
    out = np.zeros((n, s.dims), np.int8)
    np.put_along_axis(out, places, rng.choice(np.array((-1, 1), np.int8), (n, s.nonzero)), 1)
    return out


def context_sums(texts, s: Settings, ids: Ids, index: np.ndarray, words: np.ndarray, shapes: np.ndarray):
    """Adds to ``words`` (buckets x dims) and ``shapes`` (SHAPES x dims) the neighbours' vectors."""
    r_word, r_shape = index[: s.buckets], index[s.buckets :].astype(np.int64)
    places = np.nonzero(r_word)[1].reshape(s.buckets, s.nonzero)
    signs = np.take_along_axis(r_word, places, 1).astype(float)
    flat = np.zeros(s.buckets * s.dims)
    by_shape, both = np.zeros(s.buckets * SHAPES), np.zeros(SHAPES * SHAPES)
    a, b, held = [], [], 0

    def add():
        left, right = np.concatenate(a), np.concatenate(b)
        for x, y in ((left, right), (right, left)):
            w, n = x // SHAPES, y // SHAPES
            at = (w * s.dims)[:, None] + places[n]
            flat[:] += np.bincount(at.ravel(), signs[n].ravel(), len(flat))
            by_shape[:] += np.bincount(w * SHAPES + y % SHAPES, minlength=len(by_shape))
            both[:] += np.bincount(x % SHAPES * SHAPES + y % SHAPES, minlength=len(both))

    for text in texts:
        last = None
        for part in token_ids(text, ids):
            if last is not None:
                part = np.concatenate(([last], part))
            a.append(part[:-1])
            b.append(part[1:])
            last, held = part[-1], held + len(part)
            if held >= 4 * CHUNK:
                add()
                a, b, held = [], [], 0
    if a:
        add()
    words += flat.reshape(words.shape).astype(np.int64) + by_shape.reshape(s.buckets, SHAPES).astype(np.int64) @ r_shape
    shapes += both.reshape(SHAPES, SHAPES).astype(np.int64) @ r_shape


def word_vectors(docs: DataFrame, text_col: str, s: Settings) -> np.ndarray:
    """Unit context vectors of all buckets and shapes, summed over every document."""
    index = index_vectors(s.buckets + SHAPES, s)

    def run(batches):
        words, shapes, ids = np.zeros((s.buckets, s.dims), np.int64), np.zeros((SHAPES, s.dims), np.int64), Ids(s.buckets)
        for b in batches:
            context_sums(b.column(0).to_pylist(), s, ids, index, words, shapes)
        rows = np.concatenate((words, shapes))
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(rows[some, d]) for d in range(s.dims)]], ["at", *[f"c{d}" for d in range(s.dims)]])

    dims = [f"c{d}" for d in range(s.dims)]
    parts = docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "at long, " + ", ".join(f"{d} long" for d in dims))
    sums = parts.groupBy("at").agg(*[F.sum(d).alias(d) for d in dims]).toPandas()  # at most buckets + SHAPES rows
    out = np.zeros((s.buckets + SHAPES, s.dims))
    out[sums["at"].to_numpy(np.int64)] = sums[dims].to_numpy(float)
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


def pooled(docs: DataFrame, id_col: str, text_col: str, vectors: np.ndarray, s: Settings) -> DataFrame:
    """``id, vec``: the mean word vector and the mean shape vector of each document."""
    # the vectors travel with the function: fixed size, (buckets + SHAPES) x dims
    def run(batches):
        ids, table = Ids(s.buckets), vectors
        for b in batches:
            out = np.zeros((b.num_rows, 2 * s.dims), np.float32)
            for row, text in zip(out, b.column(1).to_pylist(), strict=True):
                n = 0
                for part in token_ids(text, ids):
                    row[: s.dims] += table[part // SHAPES].sum(0)
                    row[s.dims :] += np.bincount(part % SHAPES, minlength=SHAPES).astype(np.float32) @ table[s.buckets :]
                    n += len(part)
                row /= max(1, n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(out.ravel(), 2 * s.dims).cast(pa.list_(pa.float32()))], [id_col, "vec"])

    one = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary"))
    return one.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, vec array<float>")


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self.logit(x.astype(float)) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, s: Settings = DEFAULT) -> Network:
    """Full-batch Adam with weight decay; every fifth row only fits the temperature."""
    d = x.shape[1] if x.ndim == 2 else 0
    if len(y) == 0 or y.min() == y.max():
        return Network(*[np.zeros(d)] * 4, np.zeros(0), 0.0, constant=float(y.mean()) if len(y) else 0.5)
    x, y = x.astype(float), y.astype(float)
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[~aside])) < 2 or not aside.any():
        aside = np.zeros(len(y), bool)
    tx, ty = x[~aside], y[~aside]
    rng = np.random.default_rng(s.seed)
    net = Network(tx.mean(0), tx.std(0) + 1e-6, rng.normal(0, 1 / np.sqrt(d), (d, s.hidden)), np.zeros(s.hidden), rng.normal(0, 0.3, s.hidden), 0.0)
    tx = (tx - net.mean) / net.scale
    state = [[np.zeros_like(np.asarray(p, float)), np.zeros_like(np.asarray(p, float))] for p in (net.w1, net.b1, net.w2, net.b2)]
    for step in range(1, s.steps + 1):
        h = np.tanh(tx @ net.w1 + net.b1)
        e = (sigmoid(h @ net.w2 + net.b2) - ty) / len(ty)
        dh = np.outer(e, net.w2) * (1 - h * h)
        grads = (tx.T @ dh + 1e-3 * net.w1, dh.sum(0), h.T @ e + 1e-3 * net.w2, e.sum())
        new = []
        for p, g, m in zip((net.w1, net.b1, net.w2, net.b2), grads, state, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            new.append(p - 0.02 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
        net.w1, net.b1, net.w2, net.b2 = new
    if aside.any():
        z = net.logit(x[aside])
        net.temperature = float(min(np.exp(np.linspace(-1.5, 3, 91)), key=lambda t: loss(z / t, y[aside])))
    return net


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = DEFAULT) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``."""
    vectors = word_vectors(docs, text_col, settings)
    rows = written(pooled(docs, id_col, text_col, vectors, settings), "quality-vectors")
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isNotNull()).groupBy("_id").agg(F.max("_y").alias("_y"))
    known = rows.filter(id_mod(F.col(id_col), 3) != 1).join(marks, F.col(id_col) == F.col("_id"))
    known = known.select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), "vec", "_y")
    n = known.count()
    if n > settings.max_rows:  # a hash decides, so nothing is sorted or sent but what is used
        known = known.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < (settings.max_rows << 30) // n)
    known = known.toPandas()  # about max_rows rows at most
    known = known.iloc[sorted(range(len(known)), key=lambda k: (known["h"][k], tuple(known["vec"][k]), known["_y"][k]))]
    x = np.array(known["vec"].tolist(), float) if len(known) else np.zeros((0, 2 * settings.dims))
    net = fit_network(x, known["_y"].to_numpy(float), settings)

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float32).reshape(b.num_rows, -1)
            score = net.score(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.withColumn("held_out", id_mod(F.col(id_col), 3) == 1).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def op2(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
