import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpus_fixtures import no_docs, odd_docs  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from missaware.llm import tokenids
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def brute(rows):
    """[(id, start, n, crc)] in order; rows are (id, text)."""
    t, out, start = library(), [], 0
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1))))
@settings(max_examples=200, deadline=None)
def test_blocks_round_trip(values):
    v = np.array(values, np.uint32)
    raw = tokenids.pack(v)
    n, n_data = np.frombuffer(raw[:8], "<u4").tolist()
    cut = 8 + -(-n // 4)
    assert n == len(v) and len(raw) == cut + n_data
    assert n_data == sum(max(1, -(-int(x).bit_length() // 8)) for x in values)
    assert np.array_equal(tokenids.unpack(np.frombuffer(raw[8:cut], np.uint8), raw[cut:], n), v)


def test_files_round_trip_across_blocks_and_rank_by_frequency(monkeypatch):
    monkeypatch.setattr(tokenids, "BLOCK", 100)
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.3, n).clip(0, 60_000).astype("<u4") for n in (0, 1, 99, 100, 101, 5000, 0, 7)]
    sink = pa.BufferOutputStream()
    total = tokenids.write_file(sink, docs, pa.array([None, *range(7)], pa.int64()))
    raw = sink.getvalue()
    got = list(tokenids.read_file(pa.BufferReader(raw)))
    assert total == sum(map(len, docs)) and [i[0].as_py() for i, _ in got] == [None, *range(7)]
    assert all(np.array_equal(a, b) for a, (_, b) in zip(docs, got, strict=True))
    ids, counts = np.unique(np.concatenate(docs), return_counts=True)
    order = sorted(zip(ids.tolist(), counts.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    table = np.frombuffer(raw, "<u4", len(ids), len(tokenids.MAGIC) + 4).tolist()
    assert table == [i for i, _ in order]
    with pytest.raises(ValueError):
        list(tokenids.read_file(pa.BufferReader(bytes(raw)[:-1])))


TEXTS = [
    "", " ", "  a  b", "a b\n\n c\td\r\n e", "It's we'll don't  'tis ' s", "x <|endoftext|> y<|endoftext|>", "   x　 y \n z \u0085 q", "naïve café — déjà vu… “quoted”",
    "日本語の文 と 空白", "a\x0b b\x0c c\x1c d \x00 e", "😀 😀😀 ​ ﻿ x", "1234 56,789.10 a1 b2", "tail \n", "× ÷ ¿ ¡ ɏ ɐ ʼn", "a" * 5000, " " * 3000 + "b",
]


def by_text(encode, texts):
    ids, n = encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n).tolist()
    return [ids[e - x : e].tobytes() for e, x in zip(ends, n.tolist(), strict=True)]


def plain(t, texts):
    return [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    want = plain(library(), TEXTS)
    with open(VOCABULARY, encoding="utf-8") as f:
        vocabulary = f.read()
    assert tokenids.cuts_at_space(vocabulary)
    encode = tokenids.Encoder(vocabulary)
    assert by_text(encode, TEXTS) == want and by_text(encode, TEXTS) == want
    for name, value in (("SLOTS", 8), ("POOL", 16), ("RUN", 5)):  # pieces drive each other out
        monkeypatch.setattr(tokenids, name, value)
    encode = tokenids.Encoder(vocabulary)
    assert by_text(encode, TEXTS) == want and [by_text(encode, [x])[0] for x in TEXTS] == want


@given(st.lists(st.text(alphabet=st.sampled_from("ab'sté1.,!-  \n\t\r 　日😀×÷\0zZ"), max_size=60), max_size=8))
@settings(max_examples=300, deadline=None)
def test_pieces_of_random_texts(texts):
    t, encode = library_once(), encoder_once()
    assert by_text(encode, texts) == plain(t, texts)


def library_once(_made=[]):  # noqa: B006
    if not _made:
        _made.append(library())
    return _made[0]


def encoder_once(_made=[]):  # noqa: B006
    if not _made:
        with open(VOCABULARY, encoding="utf-8") as f:
            _made.append(tokenids.Encoder(f.read()))
    return _made[0]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    assert not tokenids.cuts_at_space(vocabulary)
    t = Tokenizer.from_file(path)
    assert by_text(tokenids.Encoder(vocabulary), TEXTS[:5]) == plain(t, TEXTS[:5])


def run(spark, docs, path, **options):
    tokenids.write_ids(docs, str(path), VOCABULARY, **options)
    return tokenids.read_ids(spark, str(path)).withColumn("crc", F.crc32("ids"))


def test_ids_of_many_documents_equal_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenids, "PART_BYTES", 20_000)
    rows = [(k * 7919 % 1009, f"doc {k} " + " ".join(f"w{(k * j) % 997}, é" for j in range(k % 90))) for k in range(400)]
    got = run(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7), tmp_path / "ids").collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["crc"]) for r in got) == brute(sorted(rows))
    assert len(tokenids.manifest(str(tmp_path / "ids"))["files"]) > 5


def test_long_runs_make_several_files(spark, tmp_path):
    rows = [(k, "word " * 700_000) for k in range(30)]
    docs = spark.createDataFrame([(k,) for k, _ in rows], "doc_id long").select("doc_id", F.repeat(F.lit("word "), 700_000).alias("text"))
    got = run(spark, docs, tmp_path / "ids").select("doc_id", "start", "n_tokens").collect()
    n = len(library().encode(rows[0][1], add_special_tokens=False).ids) + 1
    assert sorted(map(tuple, got)) == [(k, k * n, n) for k in range(30)]


def test_ids_of_odd_documents(spark, odd_docs, no_docs, tmp_path):
    rows = run(spark, odd_docs, tmp_path / "odd").collect()
    by_id = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        by_id.setdefault(r["doc_id"], []).append((r["n_tokens"], r["crc"]))
    assert len(rows) == 18 and len(by_id[None]) == 2 and sorted(by_id, key=lambda i: (i is not None, i)) == list(by_id)
    single = {}
    for r in odd_docs.collect():
        single.setdefault(r["doc_id"], []).append(brute([(0, r["text"])])[0][2:])
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in single.items()}
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    empty = run(spark, no_docs, tmp_path / "none")
    assert empty.count() == 0 and empty.columns[:4] == ["doc_id", "start", "n_tokens", "ids"]


def test_text_ids_and_no_end(spark, tmp_path):
    docs = spark.createDataFrame([("b", "x y"), ("a", "z"), (None, None)], "doc_id string, text string")
    got = sorted(run(spark, docs, tmp_path / "t", end_id=None).collect(), key=lambda r: (r["start"], r["doc_id"] or ""))
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(None, 0), ("a", 1), ("b", 2)]


def test_op12_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenids.op12(spark, sf).collect()) == brute(rows)
