import gzip

import duckdb
from missaware.llm import warc
from missaware.session import scratch_path
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, size long, digest string, payload string"


def pages(spark):
    long = "é" * 80
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, "http://a/3\r\nX: y", "short"), (4, "http://a/4", "short"), (5, None, None), (6, "u", ""), (7, "u", "x" * 300_000), (8, "u", "x" * 300_000), (None, "n", long), (0, "z", "q" * 99), (9, "z", "q" * 99), (9, "z", "q" * 99)]
    return spark.createDataFrame([(*r, 1, "d", "p") for r in rows], PAGES).repartition(3)


def test_round_trip_with_revisits(spark, tmp_path):
    pages(spark).coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op8(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    rel = con.execute(warc.OP8_SQL)
    cols = [d[0] for d in rel.description]
    clean = lambda v: "" if v is None else str(v).replace("\r", " ").replace("\n", " ").strip()
    assert sorted(tuple(clean(r[c]) for c in cols) for r in got) == sorted(tuple(map(clean, r)) for r in rel.fetchall())
    assert {r["page_id"]: r["refers_to"] for r in got if r["record_type"] == "revisit"} == {2: 1, None: 1, 8: 7}


def archive(spark, table):
    path = scratch_path(spark, "warc-test")
    warc.register(spark)
    warc.records(table).write.format("warc").mode("append").save(path)
    return path


def test_filters_are_pushed_and_payloads_skipped(spark, monkeypatch):
    path = archive(spark, pages(spark))
    df = warc.read_warc(spark, path).filter("record_type = 'revisit' and record_id in ('<urn:page:2>', '<urn:page:1>')")
    assert [r["record_id"] for r in df.collect()] == ["<urn:page:2>"]
    reader = warc.WarcReader(path, False)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_length",), 3)]))
    assert len(left) == 1 and reader.tests == [("warc-type", {"response"})]
    asked = []
    monkeypatch.setattr(warc.Member, "block", lambda self: asked.append(1) or b"")
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 9 and not asked and {r["payload"] for r in rows} == {None}


def test_every_member_is_plain_gzip(spark, tmp_path):
    row = {"record_type": "response", "record_id": "<urn:page:1>", "date": "d", "target_uri": "u", "payload_digest": None, "refers_to": None, "payload_length": None, "payload": b"abc" * 5000}
    data = warc.member(row) + warc.member({**row, "record_id": "<urn:page:2>"})
    raw = gzip.decompress(data)
    assert raw.count(b"WARC/1.1\r\n") == 2
    for name, content in (("own.warc.gz", data), ("other.warc.gz", b"".join(gzip.compress(raw[i : i + len(raw) // 2]) for i in (0, len(raw) // 2))), ("plain.warc", raw)):
        (tmp_path / name).write_bytes(content)
        got = warc.read_warc(spark, f"{tmp_path}/{name}").collect()
        assert [(r["record_id"], bytes(r["payload"])) for r in got] == [("<urn:page:1>", b"abc" * 5000), ("<urn:page:2>", b"abc" * 5000)], name
        bare = warc.read_warc(spark, f"{tmp_path}/{name}", payload=False).collect()
        assert [(r["record_id"], r["payload"]) for r in bare] == [("<urn:page:1>", None), ("<urn:page:2>", None)], name


def foreign(n, payload=b"abc" * 5000):
    """Plain records 1 to n."""
    row = {"record_type": "response", "date": "d", "target_uri": "u", "payload_digest": None, "refers_to": None, "payload_length": None, "payload": payload}
    return [gzip.decompress(warc.member({**row, "record_id": f"<urn:page:{i}>"})) for i in range(1, n + 1)]


def ids(spark, path, **options):
    return [r["record_id"] for r in warc.read_warc(spark, path, **options).collect()]


def test_a_gzip_member_of_many_records(spark, tmp_path):
    raw = foreign(5)
    for name, content in (("one", gzip.compress(b"".join(raw))), ("two", gzip.compress(b"".join(raw[:2])) + gzip.compress(b"".join(raw[2:]))), ("cut", gzip.compress(b"".join(raw))[:-9])):
        path = f"{tmp_path}/{name}.warc.gz"
        with open(path, "wb") as f:
            f.write(content)
        assert ids(spark, path) == [f"<urn:page:{i}>" for i in range(1, 6)], name
        assert ids(spark, path, payload=False) == [f"<urn:page:{i}>" for i in range(1, 6)], name
        assert {bytes(r["payload"]) for r in warc.read_warc(spark, path).collect()} == {b"abc" * 5000}


def test_broken_records_are_left_out_alone(spark, tmp_path):
    a, b, c, d = foreign(4)
    no_length = b"\r\n".join(x for x in b.split(b"\r\n") if not x.startswith(b"Content-Length: 1"))
    parts = {"garbage": (a, b"what is this?\r\n", b"\0" * 70_000 + b"\n", b, c, d), "length": (a, no_length, c, d), "headers": (a, b"WARC/1.1\r\nno end " + b"x" * 3_000_000 + b"\r\n", c, d), "tail": (a, c, d, b"WARC/1.1\r\nWARC-Type: resp"), "head": (b"\n\n junk\n", a, c, d)}
    for name, content in parts.items():
        for path, raw in ((f"{tmp_path}/{name}.warc", b"".join(content)), (f"{tmp_path}/{name}.warc.gz", gzip.compress(b"".join(content)))):
            with open(path, "wb") as f:
                f.write(raw)
            want = ["<urn:page:1>"] + ["<urn:page:2>"] * (name == "garbage") + ["<urn:page:3>", "<urn:page:4>"]
            assert ids(spark, path) == want and ids(spark, path, payload=False) == want, path


def test_batches_are_bounded_by_bytes(tmp_path, monkeypatch):
    (tmp_path / "a.warc").write_bytes(b"".join(foreign(9)))
    monkeypatch.setattr(warc, "ROW_BYTES", 20_000)
    reader = warc.WarcReader(str(tmp_path / "a.warc"), True)
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [2, 2, 2, 2, 1]


def test_no_pages(spark):
    path = archive(spark, pages(spark).limit(0))
    assert warc.read_warc(spark, path).count() == 0


def test_hidden_attempts_are_not_read(spark):
    path = archive(spark, pages(spark).filter(F.col("page_id") == 1))
    fs, at = warc.file_system(path)
    with fs.open_output_stream(f"{at}/_attempts/left.warc.gz", compression=None) as f:
        f.write(b"broken")
    assert warc.read_warc(spark, path).count() == 1
