import hashlib
import zlib

from pyspark.sql import functions as F

from tessera.llm import warc


def test_query_equals_sql(same_rows):
    same_rows(warc.query, warc.sql())


def test_payloads_come_back(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, None), (4, "http://d/", ""), (None, "http://e/", "same"), (5, "u", "ü" * 300_000), (6, "v", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))
    out = {r.page_id: r for r in warc.read_archives(warc.write_archives(warc.plan_revisits(df))).collect()}
    assert {k: v.record_type for k, v in out.items()} == {1: "revisit", 2: "response", 3: "revisit", 4: "response", None: "revisit", 5: "response", 6: "response"}
    assert out[1].refers_to == 2 and out[3].refers_to == 4 and out[2].refers_to is None
    for page, _, html in rows:
        payload = (html or "").encode()
        r = out[page]
        assert r.payload_bytes == len(payload) and r.payload_digest == warc.base32_sha1(payload) and r.digest_ok and r.error is None
        if r.record_type == "response":
            assert r.payload == payload
    assert warc.read_archives(warc.write_archives(warc.plan_revisits(df.limit(0)))).count() == 0


def test_small_payloads_are_never_revisits(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "long one"), (4, "u", "long one")], "page_id long, url string, html string")
    assert {r.page_id: r["first"] for r in warc.plan_revisits(df, min_bytes=3).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_parts_are_files_and_damage_is_told(spark, tmp_path):
    records = [warc._member(warc._record("response", i, "u", None, b"payload %d" % i)) for i in range(4)]
    bad = bytearray(records[1])
    bad[len(bad) // 2] ^= 255
    false = warc._record("response", 9, "u", None, b"payload").replace(b"\r\n\r\npayload", b"\r\n\r\npaYload")
    (tmp_path / "x.warc.gz").write_bytes(records[0] + bytes(bad) + records[2] + warc._member(false) + records[3][:-9])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = warc.read_archives(files).collect()
    assert [r.page_id for r in got if r.page_id is not None] == [0, 2, 9]
    assert [r.digest_ok for r in got if r.page_id is not None] == [True, True, False]
    assert sum(r.error is not None for r in got) >= 2


def test_members_are_plain_gzip():
    data = warc._member(b"abc" * 100_000)
    assert zlib.decompress(data, 31) == b"abc" * 100_000
    assert [m for m, _ in warc.members(data + data)] == [b"abc" * 100_000] * 2
    assert warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").digest()


def test_lengths_that_are_no_numbers_are_told(spark):
    records = []
    for said in (b"x", b"-", b"9" * 40, "²".encode(), b""):
        head, gap, body = warc._record("response", 1, "u", None, b"payload").partition(b"\r\n\r\n")
        http = b"HTTP/1.1 200 OK\r\nContent-Length: " + said + b"\r\n\r\npayload"
        lines = [b"Content-Length: %d" % len(http) if x.lower().startswith(b"content-length:") else x for x in head.split(b"\r\n") if b"igest" not in x]
        records.append(warc._member(b"\r\n".join(lines) + gap + http + b"\r\n\r\n"))
    got = warc.read_archives(spark.createDataFrame([(bytearray(b"".join(records)),)], "content binary")).collect()
    assert [r.error for r in got] == ["HTTP content length is no number"] * 5 and [r.payload_bytes for r in got] == [7] * 5
