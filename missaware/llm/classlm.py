"""Language-model scores from a class-based bigram model (Brown clustering by exchange).

Tokens are words, ASCII letters lower-cased, then one end token.  Counts come from all training
documents.  Texts are then cut once more into numbers (``numbered``): the ``top_words`` most frequent words
have one each, any other word its place in the text's own list; everything after works on these.
Exchange clustering of the ``cluster_words`` most frequent words, on the driver, is the
seed: it moves one word at a time to the class that raises the likelihood of the class bigrams most.
Every other training word then gets the class that raises it most against the seed's table (one
choice each; only the seed's words are exchanged): tasks count the classes beside each word (words
outside the seed stand there as open classes by length, script and end mark) and send one pack of
counts per word; packs are added up and the class is chosen where they meet.  The class bigrams are
counted again with all words in their classes.  Open classes are left for words that no training
text has; the end token is a class of its own.

    P(text) = prod P(class | class before) * P(word | class)
    P(word | class) = (c + 1) / (N_class + V_class + 1),   P(k | j) = (n_jk + a) / (n_j. + a * K)

Counts and classes of the ``top_words`` most frequent words (a fixed bound) travel with the tasks, those
of all other words are joined by shuffle, so nothing is capped.  A word's packs, one per task, meet sorted and
are added up as a stream, so no word's packs are held together.

Defined results: a null text is empty (the end token alone); a null id is held out or not like the
empty text; repeated rows are scored alike; without training text all counts are 0; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missaware.llm.common import id_mod, written

END = b""  # no word is empty
#: Bytes of text cut at once, words of texts handled at once; a pack's entries.
PIECE, TOGETHER = 1 << 22, 1 << 19
PACK = np.dtype([("code", "<u2"), ("n", "<u4")])
LENGTHS = (3, 6, 10)
OPEN = (len(LENGTHS) + 1) * 4


@dataclass(frozen=True)
class Settings:
    cluster_words: int = 1024
    classes: int = 32
    sweeps: int = 4
    smoothing: float = 0.5
    top_words: int = 131072  # longest word 64 bytes: at most 13 MB with their counts
    flush_words: int = 300_000  # distinct words a task holds before it passes them on
    flush_codes: int = 1 << 19  # (rarer word, class beside it) pairs a task holds


DEFAULT = Settings()


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased (bytes.lower leaves all other characters alone)."""
    return (text or b"").lower().split()


def runs(text: bytes | None):
    """``tokens`` of a text in lists, so that long texts take no more memory."""
    text, at = text or b"", 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield tokens(text[at:end])
        at = end


def open_class(word: bytes) -> int:
    """By length, whether there are other than ASCII characters, and whether it ends in a mark."""
    size = sum(len(word) > n for n in LENGTHS)
    return size * 4 + 2 * (not word.isascii()) + (not (word[-1:].isalnum() or word[-1:] >= b"\x80"))


def word_counts(training: DataFrame, settings: Settings) -> DataFrame:
    """``word, c`` over the column ``text`` of bytes; the end token is the empty word."""

    def batch(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):  # one text at a time out of the batch
                for words in runs(t.as_py()):
                    counts.update(words)
                counts[END] += 1
                if len(counts) > settings.flush_words:
                    yield batch(counts)
                    counts = Counter()
        yield batch(counts)

    return training.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def numbered(docs: DataFrame, id_col: str, text_col: str, held, top: list[bytes]) -> DataFrame:
    """``_row, id, _held, _numbers, _tail``: a text's words as int32, a word's place in ``top``, or -1 - j for the
    j-th of the other words of the text, which ``_tail`` lists."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):  # top travels with the function; Settings bounds it
        get = {w: i for i, w in enumerate(top)}.get
        for b in batches:
            numbers, words, offsets, first, held = [], [], [0], 0, 0
            for n, t in enumerate(b.column(2)):  # one text at a time out of the batch
                own: dict[bytes, int] = {}
                parts = []
                for w in runs(t.as_py()):
                    a = np.fromiter(map(get, w, repeat(-1)), np.int32, len(w))
                    rare = np.flatnonzero(a < 0)
                    a[rare] = [-1 - own.setdefault(w[i], len(own)) for i in rare.tolist()]
                    parts.append(a)
                    held += len(a)
                numbers.append(np.concatenate(parts).tobytes() if parts else b"")
                words.extend(own)
                offsets.append(len(words))
                if held >= TOGETHER or n == b.num_rows - 1:
                    some = b.slice(first, len(numbers))
                    tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words, pa.binary()))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(3), pa.array(numbers, pa.binary()), tail], ["_row", id_col, "_held", "_numbers", "_tail"])
                    numbers, words, offsets, first, held = [], [], [0], n + 1, 0
                    pa.default_memory_pool().release_unused()

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_text"), held.alias("_held"))
    return written(rows.mapInArrow(run, f"_row long, `{id_col}` {kind}, _held boolean, _numbers binary, _tail array<binary>"), "lm-rows")


def kinds_of(numbers: np.ndarray, of_top: np.ndarray, of_tail: np.ndarray) -> np.ndarray:
    """A value per word from values per number and per word of the text's list."""
    rare = np.flatnonzero(numbers < 0)
    if not len(rare):
        return of_top[numbers]
    out = of_top[np.maximum(numbers, 0)] if len(of_top) else np.zeros(len(numbers), of_tail.dtype)
    out[rare] = of_tail[-1 - numbers[rare]]
    return out


def sequences(batch: pa.RecordBatch, of_top: np.ndarray, open_kind: int, end: int):
    """(kinds of all words of a batch with an end before each text and after the last, numbers with -1 for
    ends, and the lists' words with -2 - i for the i-th of them)."""
    kinds, numbers, lists, stop, none = [], [], [], np.array([end]), np.array([-1])
    for a, tail in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        a = np.frombuffer(a, np.int32)
        of_tail = np.array([open_kind + open_class(w) for w in tail], np.int64)
        kinds += [stop, kinds_of(a, of_top, of_tail)]
        numbers += [none, np.where(a < 0, a - 1 - len(lists), a)]
        lists.extend(tail)
    return np.concatenate([*kinds, stop]), np.concatenate([*numbers, none]), lists


def small_batches(batches, column: int = 0):
    """Batches with about ``TOGETHER`` words (at least one text), by the column of numbers."""
    for b in batches:
        done = np.cumsum(pc.binary_length(b.column(column)).to_numpy()) // 4
        first = 0
        while first < b.num_rows:
            here = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + TOGETHER, "right")))
            yield b.slice(first, here - first)
            first = here
        pa.default_memory_pool().release_unused()


def bigram_counts(training: DataFrame, of_top: np.ndarray, open_kind: int, n_items: int) -> np.ndarray:
    """Counts of neighbouring items: clustered words, open classes, the end (which also starts)."""

    def run(batches):
        total = np.zeros(n_items * n_items, np.int64)
        for b in small_batches(batches):
            a, _, _ = sequences(b, of_top, open_kind, n_items - 1)
            total += np.bincount(a[:-1] * n_items + a[1:], minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    pairs = training.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # at most n_items squared
    out = np.zeros(n_items * n_items, np.int64)
    out[pairs["code"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.int64)
    return out.reshape(n_items, n_items)


def exchange(bigrams: np.ndarray, movable: int, classes: int, sweeps: int) -> np.ndarray:
    """Class of every item.  The first ``movable`` items are moved; each other one is its own class."""
    n = len(bigrams)
    k = classes + n - movable
    of = np.concatenate((np.arange(movable) % classes, classes + np.arange(n - movable)))
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    b = bigrams.astype(float)
    table = member.T @ b @ member

    def h(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            own = b[w, w]
            to, come = b[w] @ member, b[:, w] @ member  # counts of the word with each class
            c = of[w]
            to[c] -= own
            come[c] -= own
            # take the word out
            table[c] -= to
            table[:, c] -= come
            table[c, c] -= own
            rows, cols = table.sum(1), table.sum(0)
            out_w, in_w = to.sum() + own, come.sum() + own
            idx = np.arange(classes)
            # likelihood change of putting it into each class: cells of that row and column, and sums
            gain = (h(table[:classes] + to) - h(table[:classes])).sum(1) + (h(table[:, :classes].T + come) - h(table[:, :classes].T)).sum(1)
            d = table[idx, idx]
            gain -= h(d + to[:classes]) + h(d + come[:classes]) - 2 * h(d)
            gain += h(d + to[:classes] + come[:classes] + own) - h(d)
            gain -= h(rows[:classes] + out_w) - h(rows[:classes]) + h(cols[:classes] + in_w) - h(cols[:classes])
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            moved += best != c
            table[best] += to
            table[:, best] += come
            table[best, best] += own
            member[w, c], member[w, best], of[w] = 0, 1, best
        if not moved:
            break
    return of


def packs(words: list[bytes], code: np.ndarray, n: np.ndarray, wide: int):
    """``word, pack`` batches from sorted codes (place in ``words`` * wide + code) and their counts."""
    of, first = np.unique(code // wide, return_index=True)
    entries = np.empty(len(code), PACK)
    entries["code"], entries["n"] = code % wide, n
    edges = np.append(first, len(code))
    for i in range(0, len(of), 1 << 15):
        e = edges[i : i + (1 << 15) + 1]
        offsets = ((e - e[0]) * PACK.itemsize).astype(np.int32)
        pack = pa.Array.from_buffers(pa.binary(), len(e) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries[e[0] : e[-1]].tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array([words[j] for j in of[i : i + len(e) - 1].tolist()], pa.binary()), pack], ["word", "pack"])


def neighbours(training: DataFrame, top: list[bytes], movable: int, of_top: np.ndarray, k: int, settings: Settings) -> DataFrame:
    """``word, pack`` of all words outside the seed, one row per word and task: how often each class
    stands before the word (code: the class) and after it (code: ``k`` more)."""
    wide = 2 * k

    def run(batches):
        often = np.zeros((len(top) - movable) * wide, np.int64 if len(top) < 1 << 12 else np.int32)
        known: dict[bytes, int] = {}
        held, n_held = [], 0

        def rare():
            if held:
                code, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
                yield from packs(list(known), code, np.bincount(back, np.concatenate([n for _, n in held])), wide)

        for b in small_batches(batches):
            kinds, numbers, lists = sequences(b, of_top, settings.classes, k - 1)
            place = np.fromiter((known.setdefault(w, len(known)) for w in lists), np.int64, len(lists))
            for at, base in ((np.flatnonzero(numbers >= movable), None), (np.flatnonzero(numbers < -1), place)):
                word = numbers[at] - movable if base is None else base[-2 - numbers[at]]
                code, n = np.unique(np.concatenate((word * wide + kinds[at - 1], word * wide + k + kinds[at + 1])), return_counts=True)
                if base is None:
                    often[code] += n.astype(often.dtype)
                elif len(code):
                    held.append((code, n))
                    n_held += len(code)
            if 2 * len(known) > settings.flush_words or n_held > settings.flush_codes:
                yield from rare()
                known.clear()
                held, n_held = [], 0
        yield from rare()
        for i in range(0, len(often), wide << 12):  # some words at a time
            code = np.flatnonzero(often[i : i + (wide << 12)]) + i
            yield from packs(top[movable:], code, often[code], wide)

    return training.mapInArrow(run, "word binary, pack binary")


def added(batches, wide: int):
    """Words and their counts (words x codes) from ``word, pack`` rows sorted by word: rows of a word are added up
    as they come, and the last word of a batch waits for the next one."""
    held, waiting = None, np.zeros(wide)
    for b in batches:
        words, packed = b.column(0), b.column(1)
        if not len(words):
            continue
        new = np.concatenate(([False], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)))
        of = np.cumsum(new)
        entries = np.frombuffer(b"".join(packed.to_pylist()), PACK)
        code = np.repeat(of, pc.binary_length(packed).to_numpy() // PACK.itemsize) * wide + entries["code"]
        n = np.bincount(code, entries["n"], (of[-1] + 1) * wide).reshape(-1, wide)  # below 2**53
        found = words.take(pa.array(np.append(0, np.flatnonzero(new))))
        if held is not None and held[0].as_py() == found[0].as_py():
            n[0] += waiting
        elif held is not None:
            yield held, waiting[None]
        if len(found) > 1:
            yield found.slice(0, len(found) - 1), n[:-1]
        held, waiting = pa.array([found[len(found) - 1].as_py()], pa.binary()), n[-1].copy()
    if held is not None:
        yield held, waiting[None]


def assigned(packed: DataFrame, table: np.ndarray, classes: int) -> DataFrame:
    """``word, c, k`` from ``neighbours``: the class whose bigrams gain most likelihood by the word
    (``table``: the seed's class bigrams); the first of equal ones."""
    size = len(table)
    cells = np.concatenate((table[:, :classes], table[:classes].T)).astype(float)
    sums = np.stack((table.sum(1)[:classes], table.sum(0)[:classes])).astype(float)

    def h(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    def run(batches):
        for all_words, counts in added(batches, 2 * size):
            for i in range(0, len(all_words), 1024):
                words, n = all_words.slice(i, 1024), counts[i : i + 1024]
                word, code = np.nonzero(n)
                m = n[word, code][:, None]
                gain = np.add.reduceat(h(cells[code] + m) - h(cells[code]), np.searchsorted(word, np.arange(len(words))))
                c = n[:, :size].sum(1)
                gain -= sum(h(x + c[:, None]) - h(x) for x in sums)
                yield pa.RecordBatch.from_arrays([words, pa.array(c.astype(np.int64)), pa.array(np.argmax(gain, 1).astype(np.int32))], ["word", "c", "k"])

    return packed.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, c long, k int")


@dataclass
class Model:
    """What scoring needs beside the counts and classes of rare words."""

    clustered: dict  # classes of frequent words
    classes: int  # of words; then OPEN classes, then the end
    log_step: np.ndarray  # log10 of (class before, class): transition, and the class' emission divisor
    n: int
    v: int
    end_count: int


def _lowest(steps: list, most: int) -> int | None:
    """The lowest count step that leaves at most ``most`` words."""
    taken, lowest = 0, None
    for step, n in sorted(map(tuple, steps), reverse=True):
        taken += n
        if taken > most:
            break
        lowest = step
    return lowest


def train(docs: DataFrame, id_col: str, text_col: str, settings: Settings, held_mod: int, held_at: int):
    """The model, the vocabulary (``word, c, k``: count, class), the counts of its most frequent part
    as a dict, and the rows of ``encoded``."""
    held = id_mod(F.col(id_col), held_mod) == held_at
    training = docs.filter(~held).select(F.col(text_col).cast("string").cast("binary").alias("text"))
    counts = written(word_counts(training, settings), "lm-counts")
    # frequent words from a histogram of counts by 64ths of an octave
    step = F.floor(F.log2("c") * 64)
    short = (F.octet_length("word") <= 64) & (F.octet_length("word") > 0)
    steps = counts.filter(short).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    lowest = _lowest(steps, settings.top_words)
    top = counts.filter(short & (step >= lowest)).toPandas() if lowest is not None else None  # at most top_words
    top = dict(sorted(zip(map(bytes, top["word"]), map(int, top["c"]), strict=True), key=lambda x: (-x[1], x[0]))) if lowest is not None else {}
    words = list(top)
    rows = numbered(docs, id_col, text_col, held, words)
    own = rows.filter("not _held").select("_numbers", "_tail")

    movable, k = min(len(words), settings.cluster_words), settings.classes + OPEN + 1
    n_items, opened = movable + OPEN + 1, np.array([open_class(w) for w in words], np.int64)
    bigrams = bigram_counts(own, np.concatenate((np.arange(movable), movable + opened[movable:])), movable, n_items)
    of = exchange(bigrams, movable, settings.classes, settings.sweeps)
    member = np.zeros((n_items, k))
    member[np.arange(n_items), of] = 1
    seed = {w: int(x) for w, x in zip(words, of[:movable])}

    of_top = np.concatenate((of[:movable], settings.classes + opened[movable:]))
    packed = neighbours(own, words, movable, of_top, k, settings)
    rest = assigned(packed, member.T @ bigrams @ member, settings.classes)
    ends = counts.filter(F.col("word") == F.lit(b"")).select("word", "c", F.lit(k - 1).alias("k"))
    seeded = docs.sparkSession.createDataFrame([(bytearray(w), top[w], x) for w, x in seed.items()], "word binary, c long, k int")
    vocabulary = written(rest.unionAll(ends).unionAll(seeded), "lm-words")

    known = vocabulary.filter(short & (step >= lowest)).select("word", "k").toPandas() if lowest is not None else None  # the top words
    clustered = dict(zip(map(bytes, known["word"]), map(int, known["k"]), strict=True)) if lowest is not None else {}
    by_class = vocabulary.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # k rows
    n_k, v_k = np.zeros(k), np.zeros(k)
    n_k[by_class["k"].to_numpy(np.int64)], v_k[by_class["k"].to_numpy(np.int64)] = by_class["n"], by_class["v"]

    rows = encoded(rows, id_col, vocabulary, np.array([clustered[w] for w in words], np.int64), np.array(list(top.values()), np.int64), settings, int(n_k[k - 1]))
    steps = class_bigrams(rows.filter("not _held").select("_kinds"), k) + settings.smoothing
    log_step = np.log10(steps / steps.sum(1, keepdims=True)) - np.log10(n_k + v_k + 1)
    return Model(clustered, settings.classes, log_step, int(n_k.sum()), int(v_k.sum()), int(n_k[k - 1])), vocabulary, top, rows


def fit(docs: DataFrame, id_col: str, text_col: str, settings: Settings, held_mod: int, held_at: int):
    """The model, the vocabulary and its most frequent part as a dict."""
    return train(docs, id_col, text_col, settings, held_mod, held_at)[:3]


def encoded(rows: DataFrame, id_col: str, vocabulary: DataFrame, kind_of: np.ndarray, count_of: np.ndarray, settings: Settings, end_count: int) -> DataFrame:
    """Per row ``id, _held, _size, _known, _emit, _kinds``: tokens, those known, sum of log10 (c + 1), and
    the classes of its words as an array's bytes; from ``numbered``."""
    classes = settings.classes
    dtype = np.min_scalar_type(classes + OPEN)
    kind = rows.schema[id_col].dataType.simpleString()
    log_of, log_end = np.log10(count_of + 1.0), math.log10(end_count + 1)

    def fill(batches):  # kind_of and log_of travel with the function; Settings bounds them
        for b in small_batches(batches, 2):
            size, known, emit, all_kinds = [], [], [], []
            found = b.column(4)
            edges = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy())))
            flat = found.flatten()
            j, c, k = (x.to_numpy() for x in flat.flatten())
            for i, (numbers, tail) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                a = np.frombuffer(numbers, np.int32)
                of_tail = np.array([classes + open_class(w) for w in tail], np.int64)  # stays where no training text has the word
                c_tail, here = np.zeros(len(tail)), slice(edges[i], edges[i + 1])
                of_tail[j[here]], c_tail[j[here]] = k[here], c[here]
                size.append(len(a) + 1)
                known.append(int((kinds_of(a, np.ones(len(log_of)), c_tail) > 0).sum()) + (end_count > 0))
                emit.append(float(kinds_of(a, log_of, np.log10(c_tail + 1)).sum()) + log_end)
                all_kinds.append(kinds_of(a, kind_of, of_tail).astype(dtype).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(emit, pa.float64()), pa.array(all_kinds, pa.binary())], [id_col, "_held", "_size", "_known", "_emit", "_kinds"])

    rare = rows.select("_row", F.posexplode("_tail").alias("j", "word")).join(vocabulary, "word")
    rare = rare.groupBy("_row").agg(F.collect_list(F.struct("j", "c", "k")).alias("_found"))
    filled = rows.join(rare, "_row", "left").select(id_col, "_held", "_numbers", "_tail", "_found")
    return written(filled.mapInArrow(fill, f"`{id_col}` {kind}, _held boolean, _size long, _known long, _emit double, _kinds binary"), "lm-encoded")


def class_bigrams(rows: DataFrame, k: int) -> np.ndarray:
    """Counts of neighbouring classes over the column ``_kinds``; the end (the last) also starts."""
    dtype = np.min_scalar_type(k - 1)

    def run(batches):
        total = np.zeros(k * k, np.int64)
        for b in batches:
            for kinds in b.column(0).to_pylist():
                a = np.concatenate(([k - 1], np.frombuffer(kinds, dtype).astype(np.int64), [k - 1]))
                total += np.bincount(a[:-1] * k + a[1:], minlength=k * k)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    pairs = rows.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # at most k squared
    out = np.zeros(k * k)
    out[pairs["code"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.int64)
    return out.reshape(k, k)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = DEFAULT, held_mod: int = 7, held_at: int = 2) -> DataFrame:
    """Per row: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``."""
    model, _, _, rows = train(docs, id_col, text_col, settings, held_mod, held_at)
    log_step, k = model.log_step, model.classes + OPEN + 1
    dtype = np.min_scalar_type(k - 1)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            steps = []
            for kinds in b.column(5).to_pylist():
                a = np.concatenate(([k - 1], np.frombuffer(kinds, dtype).astype(np.int64), [k - 1]))
                steps.append(float(log_step[a[:-1], a[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(steps, pa.float64())], [id_col, "held_out", "n_tokens", "n_known", "_emit", "_step"])

    out = rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, _emit double, _step double")
    total = F.lit(math.log10(model.n + model.v + 1))
    out = out.select(
        id_col, "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("_emit") - F.col("n_tokens") * total).alias("base_score"), (F.col("_emit") + F.col("_step")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op7(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
