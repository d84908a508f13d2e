"""Token ids of texts in binary files: frequency-ranked ids, variable length, control bytes apart.

Documents are dealt to files by ranges of their id (ties by text hash and row), sorted, encoded and
written in one stage, so the files in order hold all documents in order.  Texts are encoded whole: they are
cut only where the tokenizer itself must cut (``cuts``), short pieces' ids are remembered, and
the library sees new pieces only, once each.

A file (little endian)::

    IDVB1\\n | u32 r | r x u32: the ids in use, most frequent first (ties: smaller id)
    blocks:  u32 n, u32 bytes | (n + 3) // 4 control bytes | data bytes
    u32 0, u32 0 | index: an Arrow stream of (document id, ids it has) | u64 index' place, u64 ids | IDVB1\\n

An id stands as its rank in 1 to 4 bytes; a control byte tells the lengths (less one) of four ranks in
two bits each, first rank lowest.  The 256 most frequent ids of a file take one byte.  Blocks are decoded in
numpy: a 256 x 4 table gives lengths by control byte, running sums the places, a table of masks
cuts four gathered bytes to length.  ``_manifest.json`` names the files in order with the number of ids before
each; it is written last, at commit, so files of failed attempts are never read.

What a task holds is bounded: one file's ids (``FILE_IDS``; a longer single text makes a longer file)
and ``SLOTS`` remembered pieces.

Defined results: a null text is empty (its end id alone); null document ids come first; rows with
equal ids stand by the hash of their text, equal rows side by side, each an entry of its own; the texts of special
tokens are ordinary text; an empty table gives a manifest without files; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type

from missaware.llm.common import parts_for, text_bytes, text_or_empty
from missaware.llm.grams import mix
from missaware.llm.warc import file_system
from missaware.session import scratch_path

MAGIC = b"IDVB1\n"
BLOCK, FILE_IDS, PART_BYTES = 1 << 18, 1 << 24, 64 << 20
#: Short pieces that a task remembers (a power of two) and their ids: some 60 MB; pieces looked up at once.
SLOTS, POOL, RUN = 1 << 21, 1 << 22, 1 << 17
#: Bytes of text encoded and ids passed on at once (about).
TOGETHER, BATCH_IDS = 1 << 22, 1 << 20

LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
EIGHT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


# ---- coding ----------------------------------------------------------------------------


def pack(ranks: np.ndarray) -> bytes:
    """A block: its sizes, control bytes and data bytes."""
    v = ranks.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = code
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return struct.pack("<II", len(v), len(data)) + control.tobytes() + data.tobytes()


def unpack(control: np.ndarray, data: bytes, n: int) -> np.ndarray:
    """The ranks of a block."""
    lengths = LENGTHS[control].ravel()[:n]
    at = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = np.ndarray((len(data),), "<u4", padded, strides=(1,))  # the four bytes from each place
    return words[at] & MASKS[lengths]


def ranked(counts: np.ndarray) -> np.ndarray:
    """The ids in use, most frequent first."""
    used = np.flatnonzero(counts)
    return used[np.lexsort((used, -counts[used]))].astype("<u4")


def small(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids


def together(docs: list[np.ndarray]):
    """Arrays of BLOCK ids or more, whole documents."""
    held, n = [], 0
    for d in docs:
        held.append(d)
        n += len(d)
        if n >= BLOCK:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def write_file(out, docs: list[np.ndarray], ids: pa.Array) -> int:
    """Writes a file of documents (arrays of ids); returns the number of ids."""
    counts = np.zeros(1, np.int64)
    for some in together(docs):
        c = np.bincount(some)
        counts, c = (counts, c) if len(counts) >= len(c) else (c, counts)
        counts[: len(c)] += c
    table = ranked(counts)
    rank = np.zeros(len(counts), np.uint32)
    rank[table] = np.arange(len(table))
    at = out.write(MAGIC + struct.pack("<I", len(table)) + table.tobytes())
    for some in together(docs):
        whole = rank[some]
        for k in range(0, len(whole), BLOCK):
            at += out.write(pack(whole[k : k + BLOCK]))
    at += out.write(struct.pack("<II", 0, 0))
    index = pa.RecordBatch.from_arrays([ids, pa.array([len(d) for d in docs], pa.int64())], ["id", "n"])
    with pa.ipc.new_stream(out, index.schema) as stream:
        stream.write_batch(index)
    total = int(counts.sum())
    out.write(struct.pack("<QQ", at, total) + MAGIC)
    return total


def read_file(file):
    """Yields (document id as an Arrow array of one, array of its ids) of a file in order."""
    size = file.size()
    file.seek(size - 16 - len(MAGIC))
    tail = file.read(16 + len(MAGIC))
    if tail[16:] != MAGIC:
        raise ValueError("not a file of token ids, or cut short")
    index_at, total = struct.unpack("<QQ", tail[:16])
    file.seek(index_at)
    with pa.ipc.open_stream(file.read(size - index_at - len(tail))) as stream:
        index = stream.read_next_batch()
    file.seek(len(MAGIC))
    table = np.frombuffer(file.read(4 * struct.unpack("<I", file.read(4))[0]), "<u4")

    def blocks():
        while True:
            n, n_data = struct.unpack("<II", file.read(8))
            if not n:
                return
            control = np.frombuffer(file.read(-(-n // 4)), np.uint8)
            yield table[unpack(control, file.read(n_data), n)]

    source, rest, seen = blocks(), np.zeros(0, "<u4"), 0
    for k, n in enumerate(index.column(1).to_pylist()):
        pieces, need = [], n
        while need:
            if not len(rest):
                rest = next(source)
            pieces.append(rest[:need])
            rest = rest[need:]
            need -= len(pieces[-1])
        seen += n
        yield index.column(0).slice(k, 1), np.concatenate(pieces) if pieces else rest[:0]
    if seen != total:
        raise ValueError(f"{total} ids expected, {seen} found")


# ---- Spark data source -----------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: tuple  # of (path, ids, documents)


class IdsWriter(DataSourceArrowWriter):
    """Takes (document id, text) in order and encodes the texts; a partition's files stand in its place."""

    def __init__(self, path: str, names: list[str], id_type: str, vocabulary: str, end_id: int | None):
        self.path, self.names, self.id_type, self.run = path, names, id_type, uuid.uuid4().hex
        self.vocabulary, self.end = vocabulary, np.array([] if end_id is None else [end_id], np.uint32)

    def write(self, iterator):
        fs, path = file_system(self.path)
        fs.create_dir(f"{path}/_attempts", recursive=True)
        files, docs, ids, held = [], [], [], 0
        encode = Encoder(self.vocabulary)

        def flush():
            name = f"{path}/_attempts/{self.run}-{uuid.uuid4().hex}.ids"
            with fs.open_output_stream(name, compression=None) as out:
                files.append((name, write_file(out, docs, pa.concat_arrays(ids)), len(docs)))

        def groups():
            """Ids and texts of about TOGETHER bytes at once."""
            for b in iterator:
                done = np.cumsum(pc.binary_length(b.column(1)).to_numpy())
                first = 0
                while first < b.num_rows:
                    here = int(np.searchsorted(done, (done[first - 1] if first else 0) + TOGETHER)) + 1
                    some = b.slice(first, here - first)
                    yield some.column(0), encode(some.column(1))
                    first += some.num_rows

        for names, (coded, n) in groups():
            first = 0
            for k, (end, size) in enumerate(zip(np.cumsum(n).tolist(), n.tolist(), strict=True)):
                docs.append(small(np.concatenate((coded[end - size : end], self.end))))
                held += len(docs[-1])
                if held >= FILE_IDS:
                    ids.append(names.slice(first, k + 1 - first))
                    flush()
                    first, docs, ids, held = k + 1, [], [], 0
            if first < len(names):
                ids.append(pa.concat_arrays([names.slice(first)]))  # a copy, so the batch can go
        if docs:
            flush()
        return Written(TaskContext.get().partitionId(), tuple(files))

    def commit(self, messages):
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        before, listed = 0, []
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            for k, (f, n_ids, n_docs) in enumerate(m.files):
                name = f"{m.part:08d}-{k:05d}.ids"
                fs.move(f, f"{path}/{name}")
                listed.append({"file": name, "start": before, "ids": n_ids, "documents": n_docs})
                before += n_ids
        with fs.open_output_stream(f"{path}/_manifest.json") as out:
            out.write(json.dumps({"id": self.names[0], "type": self.id_type, "files": listed}).encode())

    def abort(self, messages):
        fs, _ = file_system(self.path)
        for m in messages:
            for f, _, _ in m.files if m else ():
                if fs.get_file_info(f).type == pafs.FileType.File:
                    fs.delete_file(f)


def manifest(path: str) -> dict:
    fs, path = file_system(path)
    with fs.open_input_stream(f"{path}/_manifest.json") as f:
        return json.loads(f.read())


@dataclass
class Files(InputPartition):
    files: tuple


class IdsReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.names = path, schema.names
        self.id_type = to_arrow_type(schema[0].dataType)

    def partitions(self):
        out, held = [[]], 0
        for f in manifest(self.path)["files"]:
            if held + f["ids"] > FILE_IDS and out[-1]:
                out.append([])
                held = 0
            out[-1].append((f["file"], f["start"]))
            held += f["ids"]
        return [Files(tuple(x)) for x in out]

    def read(self, partition):
        fs, path = file_system(self.path)
        for name, start in partition.files:
            with fs.open_input_file(f"{path}/{name}") as file:
                rows, held = [], 0
                for i, ids in read_file(file):
                    rows.append((i, start, len(ids), ids.tobytes()))
                    start += len(ids)
                    held += len(ids)
                    if held >= BATCH_IDS:
                        yield self.batch(rows)
                        rows, held = [], 0
                if rows:
                    yield self.batch(rows)

    def batch(self, rows):
        i, start, n, ids = zip(*rows, strict=True)
        columns = [pa.concat_arrays(i).cast(self.id_type), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, self.names)


class IdsDataSource(DataSource):
    @classmethod
    def name(cls):
        return "tokenids"

    def schema(self):
        m = manifest(self.options["path"])
        return f"`{m['id']}` {m['type']}, start long, n_tokens long, ids binary"

    def reader(self, schema):
        return IdsReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        with open(self.options["tokenizer"], encoding="utf-8") as f:  # on the driver
            vocabulary = f.read()
        end_id = self.options.get("end_id")
        return IdsWriter(self.options["path"], schema.names, schema[0].dataType.simpleString(), vocabulary, None if end_id is None else int(end_id))


# ---- encoding --------------------------------------------------------------------------

SPACES, MARKS = b" \n", b".,;:!?"


def cuts_at_space(vocabulary: str) -> bool:
    """Whether ``cuts`` holds for a tokenizer file: byte level with its own pattern, nothing before it."""
    t = json.loads(vocabulary)
    pre = t.get("pre_tokenizer") or {}
    return not t.get("normalizer") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space")


def cuts(text: np.ndarray) -> np.ndarray:
    """The bytes before which a byte-level tokenizer surely cuts UTF-8 text, so that neither side's ids depend on the other:
    before a space or line end that follows a character which is no white space in any version of
    Unicode (ASCII marks, digits and letters, U+00C0 to U+023F), and before a mark that follows a letter of these."""
    lead = np.zeros(len(text), bool)  # of a character of two bytes, U+00C0 to U+023F
    lead[2:] = (text[:-2] >= 0xC3) & (text[:-2] <= 0xC8)
    signs = np.zeros(len(text), bool)  # after the times and division signs, which are no letters
    signs[2:] = (text[:-2] == 0xC3) & ((text[1:-1] == 0x97) | (text[1:-1] == 0xB7))
    before = np.zeros(len(text), np.uint8)
    before[1:] = text[:-1]
    solid = ((before > 0x20) & (before < 0x7F)) | lead
    letter = ((before | 0x20) >= 0x61) & ((before | 0x20) <= 0x7A) | (lead & ~signs)
    space, mark = np.zeros(256, bool), np.zeros(256, bool)
    space[list(SPACES)], mark[list(MARKS)] = True, True
    return space[text] & solid | mark[text] & letter


class Memory:
    """Ids of short pieces: ``SLOTS`` places, found by a hash of the piece's bytes; the last one stays.

    A piece of up to 15 bytes is two words: its bytes, padded, and its length; they are compared, so a
    hit is the same piece.  Ids stand in one array, which is emptied when it is full.
    """

    def __init__(self):
        self.first, self.second = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at, self.n = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.uint8)  # 15 bytes are 15 ids at most
        self.pool, self.used = np.zeros(POOL, np.uint32), 0

    def slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (mix(first ^ (second * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def put(self, first, second, slot, ids: np.ndarray, n: np.ndarray) -> None:
        if self.used + len(ids) > POOL:
            self.second[:], self.used = 0, 0  # no piece has length 0
        if len(ids) > POOL:
            return
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[slot], self.second[slot], self.n[slot] = first, second, n
        self.at[slot] = self.used + np.cumsum(n) - n
        self.used += len(ids)


class Encoder:
    """Columns of texts to arrays of ids and the number of ids per text; whole texts, no special tokens."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces = Tokenizer.from_str(vocabulary), cuts_at_space(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.memory = Memory() if self.pieces else None

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = array("I"), []
        for i in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False):
                own = e.ids
                ids.extend(own)
                n.append(len(own))
        return np.frombuffer(ids, np.uint32) if ids else np.zeros(0, np.uint32), np.array(n, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``texts`` is a string array without nulls."""
        if not self.pieces:
            return self.library(texts.to_pylist())
        edges = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))))
        raw = b"".join([*[x.as_buffer().to_pybytes() for x in texts.cast(pa.binary())], bytes(16)])
        text = np.frombuffer(raw, np.uint8)[: edges[-1]]
        starts = cuts(text)
        starts[edges[:-1][np.diff(edges) > 0]] = True  # every text starts a piece
        start = np.flatnonzero(starts)
        ids, n = [], []
        for i in range(0, len(start), RUN):
            own = start[i : i + RUN + 1] if i + RUN < len(start) else np.append(start[i:], edges[-1])
            some, counts = self.run(raw, own[:-1], np.diff(own))
            ids.append(some)
            n.append(counts)
        done = np.concatenate(([0], np.cumsum(np.concatenate(n)))) if n else np.zeros(1, np.int64)
        per_text = np.diff(done[np.searchsorted(start, edges)])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), per_text

    def run(self, raw: bytes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that follow each other, and how many each has."""
        m = self.memory
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place
        short = np.flatnonzero(length <= 15)
        at, size = start[short], length[short]
        first, second = words[at] & EIGHT[np.minimum(size, 8)], (words[at + 8] & EIGHT[np.maximum(size - 8, 0)]) | (size.astype(np.uint64) << np.uint64(56))
        slot = m.slot(first, second)
        hit = (m.first[slot] == first) & (m.second[slot] == second)
        place, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        place[short[hit]], n[short[hit]] = m.at[slot[hit]], m.n[slot[hit]]
        miss = short[~hit]
        _, one, back = np.unique(np.stack((first[~hit], second[~hit]), 1).view("u8,u8").ravel(), return_index=True, return_inverse=True)
        long = np.flatnonzero(length > 15)
        distinct: dict = {}
        long_of = np.fromiter((distinct.setdefault(raw[a : a + b], len(distinct)) for a, b in zip(start[long].tolist(), length[long].tolist(), strict=True)), np.int64, len(long))
        new = [raw[a : a + b].decode("utf-8", "replace") for a, b in zip(start[miss[one]].tolist(), length[miss[one]].tolist(), strict=True)]
        ids, counts = self.library(new + [x.decode("utf-8", "replace") for x in distinct])
        offset = np.cumsum(counts) - counts
        # the known pieces' ids first, then those of the new ones
        place[miss], n[miss] = POOL + offset[back], counts[back]
        place[long], n[long] = POOL + offset[len(new) + long_of], counts[len(new) + long_of]
        which = np.repeat(place - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = np.empty(len(which), np.uint32)
        fresh_ = which >= POOL
        out[~fresh_] = m.pool[which[~fresh_]]
        out[fresh_] = ids[which[fresh_] - POOL]
        kept = int(counts[: len(new)].sum())
        m.put(first[~hit][one], second[~hit][one], slot[~hit][one], ids[:kept], counts[: len(new)])
        return out, n


def write_ids(docs: DataFrame, path: str, vocabulary_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the files to ``path`` (shared by all executors).

    ``vocabulary_path`` is a tokenizer file of the tokenizers library that the driver can read; its
    text (megabytes) travels with the tasks.
    """
    rows = docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias("_text"))
    rows = rows.select(id_col, "_text", F.xxhash64("_text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    keys = [F.col(id_col), F.col("_hash"), F.col("_row")]
    rows = rows.repartitionByRange(parts_for(text_bytes(docs, text_col), PART_BYTES), *keys).sortWithinPartitions(*keys)
    docs.sparkSession.dataSource.register(IdsDataSource)
    writer = rows.select(id_col, F.col("_text").alias("text")).write.format("tokenids").option("tokenizer", vocabulary_path)
    (writer if end_id is None else writer.option("end_id", str(end_id))).mode("append").save(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``id, start, n_tokens, ids``: ids of all documents before it, its own number, bytes of u32."""
    spark.dataSource.register(IdsDataSource)
    return spark.read.format("tokenids").load(path)


def op12(spark, sf_dir):
    import public_tokenizers

    path = scratch_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
