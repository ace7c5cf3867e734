"""Operator 1, media columns: what a binary column really holds, and what is embedded in it.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over
a value. A validator per format then walks the structure from there: lengths, chunk
checksums, end marks. A hit that no validator confirms is dropped, so magic bytes
within ordinary text do no harm. A confirmed hit at offset 0 that spans the value is
its type, whatever was declared; confirmed hits further in are embedded media.

Defined results: null content has type null and nothing embedded; empty or unknown
content has type application/octet-stream; of hits that overlap, the first in the
value wins, and at one offset the longest. Rows are kept as they are, repeats too.
Only the key, the content and the declared type are read, so other columns may have
any name. Rows never meet each other: one pass, no shuffle.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read, text_of

UNKNOWN = "application/octet-stream"
PAD = 64
RATE = 8000


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    i = at + 8
    while i + 12 <= len(b):
        n = int.from_bytes(b[i : i + 4], "big")
        if i + 12 + n > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return None
        if i == at + 8 and b[i + 4 : i + 8] != b"IHDR":
            return None
        if b[i + 4 : i + 8] == b"IEND":
            return "image/png", i + 12 - at
        i += 12 + n
    return None


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 14 > len(b):
        return None

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while i < len(b):
        if b[i] == 0x3B:
            return "image/gif", i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            i = blocks(i + 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF and 0xC0 <= b[i + 1] != 0xFF:
        n = int.from_bytes(b[i + 2 : i + 4], "big")
        if n < 2:
            return None
        scan = b[i + 1] == 0xDA
        i += 2 + n
        while scan and i + 1 < len(b):  # entropy-coded bytes, up to the next marker that isn't stuffing or a restart
            i = b.find(b"\xff", i)
            if i < 0 or i + 1 >= len(b):
                return None
            if b[i + 1] == 0xD9:
                return "image/jpeg", i + 2 - at
            if b[i + 1] and not 0xD0 <= b[i + 1] <= 0xD7:
                break
            i += 2
    return None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 26 > len(b):
        return None
    size, zero, begin, head = struct.unpack_from("<IIII", b, at + 2)
    if zero or head not in (12, 40, 52, 56, 64, 108, 124) or not 14 + head <= begin <= size <= len(b) - at:
        return None
    return "image/bmp", size


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(b[at + 8 : at + 12])
    size = int.from_bytes(b[at + 4 : at + 8], "little") + 8
    if not kind or size > len(b) - at or size < 20:
        return None
    i = at + 12
    while i + 8 <= at + size:
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        i += 8 + n + (n & 1)
    return (kind, size) if i == at + size else None


def members(b: bytes, at: int) -> list[int]:
    """Where each of the adjacent gzip members from `at` ends; those behind the first that is cut or damaged don't count."""
    ends, step = [], 1 << 16
    while b.startswith(b"\x1f\x8b\x08", at):
        member, rest = zlib.decompressobj(31), at
        try:
            while not member.eof and rest < len(b):
                member.decompress(b[rest : rest + step])
                rest += step
        except zlib.error:
            break
        if not member.eof:
            break
        at = min(rest, len(b)) - len(member.unused_data)
        ends.append(at)
    return ends


def _gzip(b: bytes, at: int) -> tuple[str, int] | None:
    ends = members(b, at)
    return ("application/gzip", ends[-1] - at) if ends else None


class Blob(bytes):
    """Bytes with tables of their end marks, made once each, so that false hits don't search to the end."""

    @functools.cached_property
    def headers(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"%PDF-", self)]

    @functools.cached_property
    def pdf_ends(self) -> tuple[list[int], list[int], list[int], dict[int, int]]:
        """End marks that have a cross-reference offset behind the mark before: where they and the offsets are, where the mark before ends; and the last of these for each offset."""
        ends, refs, befores, last, before = [], [], [], {}, 0
        for m in re.finditer(rb"%%EOF", self):
            ref = self.rfind(b"startxref", before, m.start())
            if ref >= 0:
                if to := re.fullmatch(rb"\s*(\d{1,15})\s*", self[ref + 9 : min(m.start(), ref + 64)]):
                    last[int(to[1])] = len(ends)
                ends.append(m.start())
                refs.append(ref)
                befores.append(before)
            before = m.end()
        return ends, refs, befores, last

    @functools.cached_property
    def zip_ends(self) -> dict[int, int]:
        """For each start that an end of a directory fits, the end of the first such archive."""
        found: dict[int, int] = {}
        for m in re.finditer(rb"PK\x05\x06", self):
            end = m.start()
            if end <= len(self) - 22:
                size, begin, note = struct.unpack_from("<IIH", self, end + 12)
                if end + 22 + note <= len(self):
                    found.setdefault(end - begin - size, end + 22 + note)
        return found


_XREF = re.compile(rb"xref|\d+\s+\d+\s+obj")


def _pdf(b: Blob, at: int) -> tuple[str, int] | None:
    """Up to the last end mark of this file: each update has its own, with a cross-reference offset before it.

    Behind the next header, only marks count whose offset, from this file's start, leads to a
    cross-reference behind that header: that is a file within this one, not a file after it.
    """
    i = bisect.bisect_right(b.headers, at)
    header = b.headers[i] if i < len(b.headers) else len(b)
    ends, refs, befores, offsets = b.pdf_ends
    first, beyond = bisect.bisect_left(refs, at), bisect.bisect_left(ends, header)
    last = ends[beyond - 1] + 5 if beyond > first else ends[first] + 5 if first < len(ends) and befores[first] <= at else 0
    for to, k in offsets.items():
        if k >= first and ends[k] >= last and header < ends[k] and header < at + to < refs[k] and _XREF.match(b, at + to):
            last = ends[k] + 5
    if not last:
        return None
    last += 2 if b.startswith(b"\r\n", last) else b[last : last + 1] in (b"\n", b"\r")
    return "application/pdf", last - at


def _zip(b: Blob, at: int) -> tuple[str, int] | None:
    """The first end of a directory whose offsets fit this start: those of archives stored within don't."""
    end = b.zip_ends.get(at)
    return ("application/zip", end - at) if end is not None else None


#: Magic bytes and who confirms them.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
    b"RIFF": _riff,
    b"\x1f\x8b\x08": _gzip,
    b"%PDF-": _pdf,
    b"PK\x03\x04": _zip,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in MAGIC:  # the library takes text: one character a byte
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def media_in(blob: bytes, magic: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of confirmed media, in order, none within another."""
    blob, found = Blob(blob), []
    free = 0
    for last, word in magic.iter(blob.decode("latin-1")):
        at = last + 1 - len(word)
        if at >= free and (hit := MAGIC[word](blob, at)):
            found.append((at, hit[1], hit[0]))
            free = at + hit[1]
    return found


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM: each byte is a sample. RIFF lengths are of 32 bits, so a payload has less than 4 GiB."""
    odd = len(payload) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * odd


def from_wav(blob: bytes) -> bytes:
    """The samples in a file that a validator has confirmed."""
    i = 12
    while i + 8 <= len(blob):
        n = int.from_bytes(blob[i + 4 : i + 8], "little")
        if blob[i : i + 4] == b"data":
            return blob[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % PAD or (0 if text else PAD))


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared and media: each text as a WAV file, declared as plain bytes."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([UNKNOWN] * len(texts)), pa.array([to_wav(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return text_of(df, key, text).mapInArrow(store, "doc_id long, n_bytes long, declared string, media binary")


def sniff(df: DataFrame, key: str, content: str, declared: str) -> DataFrame:
    """key, declared, detected, corrected (boolean) and embedded (offset, length, type and bytes of each)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())]))
        for batch in batches:
            types, inner = [], []
            for blob in batch.column(2).to_pylist():
                found = media_in(blob, magic) if blob else []
                whole = found and found[0][:2] == (0, len(blob))
                types.append(None if blob is None else found[0][2] if whole else UNKNOWN)
                if whole:  # look within it (of gzip, each member), behind its own magic bytes
                    ends = members(blob, 0) if types[-1] == "application/gzip" else [len(blob)]
                    found = [(start + 4 + at, n, t) for start, end in zip([0, *ends], ends) for at, n, t in media_in(blob[start + 4 : end], magic)]
                inner.append([{"offset": at, "length": n, "type": t, "content": blob[at : at + n]} for at, n, t in found])
            said = batch.column(1)
            changed = [t is not None and t != d for t, d in zip(types, said.to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), said, pa.array(types, pa.string()), pa.array(changed), pa.array(inner, kind)], ["key", "declared", "detected", "corrected", "embedded"])

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{declared}`").cast("string").alias("declared"), F.col(f"`{content}`").cast("binary").alias("content")).mapInArrow(
        look, f"key {df.schema[key].dataType.simpleString()}, declared string, detected string, corrected boolean, embedded array<struct<offset: bigint, length: bigint, type: string, content: binary>>"
    )


def feature_of(samples: np.ndarray) -> str:
    """Whole numbers only, so that equal samples give equal strings everywhere."""
    wide = samples.astype(np.int64)
    return f"n={len(wide)};sum={wide.sum()};energy={int((wide * wide).sum())};min={wide.min(initial=255)};max={wide.max(initial=0)};steps={int(np.abs(np.diff(wide)).sum())};levels={len(np.unique(samples))}"


def read_stored(df: DataFrame) -> DataFrame:
    """Sniffs each stored file, reads its samples back and describes them.

    A file that isn't confirmed as a whole WAV file fails the job: it was damaged.
    """

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        for batch in batches:
            out = []
            for doc, n, said, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = media_in(blob, magic)
                if found[:1] != [(0, len(blob), "audio/wav")]:
                    raise ValueError(f"the medium of document {doc} is damaged")
                payload = from_wav(blob)
                inner = len(media_in(payload, magic))
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(blob), hashlib.sha256(blob).hexdigest(), feature_of(np.frombuffer(payload, np.uint8)), found[0][2], said != found[0][2], inner))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(KINDS), KINDS.values(), strict=True)], list(KINDS))

    return df.mapInArrow(back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, n_embedded long")


KINDS = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(),
    "feature": pa.string(), "media_type": pa.string(), "corrected": pa.bool_(), "n_embedded": pa.int64(),
}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stored(store_texts(read(spark, sf_dir, "documents")))
