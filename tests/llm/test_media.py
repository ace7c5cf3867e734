import gzip
import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import media


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def packed():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


FILES = {
    "image/png": png(),
    "image/gif": b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;",
    "image/jpeg": b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x12\xff\x00\x34\xff\xd9",
    "image/bmp": b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40,
    "audio/wav": media.to_wav(b"abc"),
    "application/gzip": gzip.compress(b"hello" * 50),
    "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF",
    "application/zip": packed(),
}
MAGIC = media.automaton()


def test_each_format_is_confirmed_and_cut_ones_are_not():
    for kind, blob in FILES.items():
        assert media.media_in(blob, MAGIC)[0] == (0, len(blob), kind)
        assert not any(at == 0 for at, _, _ in media.media_in(blob[:-2], MAGIC) if kind != "application/zip"), kind


def test_embedded_media_are_carved_and_types_corrected(spark):
    inside = b"some text BM RIFF PK\x03\x04 " + FILES["image/png"] + b"..." + FILES["image/gif"] + b"\x1f\x8b\x08 no gzip"
    rows = [(1, inside, "text/plain"), (2, FILES["image/png"], "image/jpeg"), (3, FILES["audio/wav"], "audio/wav"), (4, None, "image/png"), (5, b"", None), (6, media.to_wav(inside), None)]
    df = spark.createDataFrame(rows, "id long, blob binary, kind string").withColumn("detected", F.lit(1)).withColumn("embedded", F.lit(1))
    got = {r.key: r for r in media.sniff(df, "id", "blob", "kind").collect()}
    assert [(e.type, e.content) for e in got[1].embedded] == [("image/png", FILES["image/png"]), ("image/gif", FILES["image/gif"])]
    assert got[1].detected == media.UNKNOWN and got[2].detected == "image/png" and got[2].corrected and not got[3].corrected
    assert got[4].detected is None and got[5].detected == media.UNKNOWN
    assert [e.type for e in got[6].embedded] == ["image/png", "image/gif"]
    assert media.sniff(df.limit(0), "id", "blob", "kind").count() == 0


@settings(deadline=None, max_examples=80)
@given(st.binary(max_size=300))
def test_payload_round_trip(data):
    payload = media.padded(data)
    blob = media.to_wav(payload)
    assert payload.startswith(data) and len(payload) % 64 == 0 and payload
    assert media.media_in(blob, MAGIC)[0] == (0, len(blob), "audio/wav") and media.from_wav(blob) == payload


def test_query(spark, data):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = media.query(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        payload = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_odd_texts(odd, odd_texts, empty):
    got = media.read_stored(media.store_texts(odd)).collect()
    assert sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t in odd_texts)
    assert media.read_stored(media.store_texts(empty)).count() == 0


def test_files_of_several_parts_are_whole(spark):
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF\n"
    updated = pdf + b"2 0 obj\nendobj\nstartxref\n%d\n%%%%EOF\r\n" % len(pdf)
    outer = b"%PDF-1.4\n1 0 obj\nstream\n" + pdf + b"endstream\n"
    holder = outer + b"xref\n0 1\nstartxref\n%d\n%%%%EOF\n" % len(outer)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("in.zip", packed())
        z.writestr("b.txt", "there")
    several = gzip.compress(b"one" * 30) + gzip.compress(b"two" * 30) + gzip.compress(png(), 0)
    files = [("application/pdf", pdf), ("application/pdf", updated), ("application/pdf", holder), ("application/zip", out.getvalue()), ("application/gzip", several)]
    for kind, blob in files:
        assert media.media_in(blob, MAGIC) == [(0, len(blob), kind)]
        assert media.media_in(b"text " + blob + FILES["image/png"], MAGIC) == [(5, len(blob), kind), (5 + len(blob), len(png()), "image/png")]
    assert [n for _, n, _ in media.media_in(pdf + pdf + updated + pdf, MAGIC)] == [len(pdf), len(pdf), len(updated), len(pdf)]
    assert media.media_in(several + b"\x1f\x8b\x08 cut", MAGIC)[0] == (0, len(several), "application/gzip")
    df = spark.createDataFrame([(i, blob, kind) for i, (kind, blob) in enumerate(files)], "id long, blob binary, kind string")
    got = {r.key: r for r in media.sniff(df, "id", "blob", "kind").collect()}
    assert not any(r.corrected for r in got.values())
    assert [[e.type for e in got[i].embedded] for i in range(5)] == [[], [], ["application/pdf"], ["application/zip"], ["image/png"]]
    assert got[4].embedded[0].content == png()


@pytest.mark.parametrize("unit", [b"%PDF-", b"PK\x03\x04", b"%PDF-%%EOF", b"%PDF-startxref%%EOF", b"PK\x03\x04PK\x05\x06", b"BM", b"RIFF"])
def test_false_hits_take_no_longer_than_their_length(unit):
    began = time.time()
    media.media_in(unit * (1_000_000 // len(unit)), media.automaton())
    assert time.time() - began < 20


def test_stored_form_and_features_equal_loops(spark, data):
    """The stored file is what the standard library's writer makes, and features are sums over its samples."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in media.query(spark, data).collect()}
    assert set(rows) == set(texts)
    for d, text in texts.items():
        payload = (text or "").encode()
        payload += bytes(64 - len(payload) % 64 if len(payload) % 64 or not payload else 0)
        out = io.BytesIO()
        with wave.open(out, "wb") as file:
            file.setnchannels(1)
            file.setsampwidth(1)
            file.setframerate(media.RATE)
            file.writeframes(payload)
        stored, samples, r = out.getvalue(), list(payload), rows[d]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        steps = sum(abs(a - b) for a, b in zip(samples, samples[1:], strict=False))
        assert r.feature == f"n={len(samples)};sum={sum(samples)};energy={sum(x * x for x in samples)};min={min(samples)};max={max(samples)};steps={steps};levels={len(set(samples))}"
