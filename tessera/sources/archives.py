"""Tar archives in a binary column: an index of their entries, and the entries' bytes. Archives of any size, as files: tar_source.

An archive is one value and is read in one task; the archives of a repository are
spread over tasks. Headers are walked in place, so listing reads no entry's bytes.

An archive that is too large for a value comes in pieces: rows of a path whose contents,
put together in order of the columns `piece`, are the archive, cut between entries (an
entry's long name or extended header is in its piece). Each piece is read by itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 512
#: Entries of a batch, and bytes of an Arrow batch of contents, unless the session says how many.
BATCH, BATCH_BYTES = 4096, 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Type flags that ustar defines.
TYPES = {"0": "file", "1": "hard link", "2": "symbolic link", "3": "character device", "4": "block device", "5": "directory", "6": "fifo"}


def _number(field: bytes) -> int:
    """Octal digits, or base 256 where the first bit is set, as for sizes of 8 GB and more."""
    if field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    digits = field.split(b"\0")[0].strip()
    return int(digits, 8) if digits and all(c in b"01234567" for c in digits) else 0


def _records(data: bytes) -> dict[str, str]:
    """Keys and values of an extended header: lines of length, key and value."""
    found, at = {}, 0
    while (space := data.find(b" ", at)) > 0 and data[at:space].isdigit():
        end = at + int(data[at:space])
        key, _, value = data[space + 1 : end - 1].partition(b"=")
        found[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        at = max(end, space + 1)
    return found


def walk(read: Callable[[int, int], bytes], end: int) -> Iterator[tuple[int, str, str, int, int, int]]:
    """(index, name, type, size, mtime, offset of the bytes) up to the end mark or a header that is cut, by read(offset, bytes); no entry's bytes are read.

    Long names and extended headers are no entries of their own: they give name and size of the next one.
    """
    at, index, given = 0, 0, {}
    while at + BLOCK <= end and (head := read(at, BLOCK))[0] != 0:
        size, kind, at = int(given.get("size", _number(head[124:136]))), chr(head[156]), at + BLOCK
        if kind in "LKxg":
            data = read(at, min(size, end - at))
            if kind in "Lx":
                given |= {"path": data.split(b"\0")[0].decode("utf-8", "replace")} if kind == "L" else _records(data)
        else:
            name = head[:100].split(b"\0")[0].decode("utf-8", "replace")
            prefix = head[345:500].split(b"\0")[0].decode("utf-8", "replace") if head[257:263] == b"ustar\0" else ""
            yield index, given.get("path", f"{prefix}/{name}" if prefix else name), TYPES.get(kind, "unknown"), size, _number(head[136:148]), at
            index, given = index + 1, {}
        at += -(-size // BLOCK) * BLOCK


def entries(data: bytes) -> Iterator[tuple[int, str, str, int, int, int]]:
    """The walk of an archive in memory."""
    return walk(lambda at, n: data[at : at + n], len(data))


_KIND = {"index": pa.int32(), "name": pa.string(), "type": pa.string(), "size": pa.int64(), "mtime": pa.int64(), "offset": pa.int64()}


def index(files: DataFrame, path: str = "path", content: str = "content", piece: Sequence[str] = ()) -> DataFrame:
    """path, index, name, type, size, mtime, offset: a row per entry."""
    found = _read(files, path, content, False, piece)
    return _placed(found, files, path, content, piece) if piece else found


def extract(files: DataFrame, path: str = "path", content: str = "content", piece: Sequence[str] = ()) -> DataFrame:
    """The index and each entry's bytes. Of archives in pieces, index and offset count from the piece, whose columns come too."""
    return _read(files, path, content, True, piece)


def _placed(found: DataFrame, files: DataFrame, path: str, content: str, piece: Sequence[str]) -> DataFrame:
    """Index and offset in the whole archive: those in the piece, plus entries and bytes of the pieces before; of each piece only these two numbers are sorted by archive."""
    own = [F.col(p).alias(f"_{p}") for p in piece]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [(sum(1 for _ in entries(blob or b"")), len(blob or b"")) for blob in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in zip(*sizes, strict=True))] if sizes else [*batch.columns[:-1], *[pa.array([], pa.int64())] * 2], [*batch.schema.names[:-1], "_n", "_bytes"])

    wanted = files.select(F.col(path).cast("string").alias("_path"), *own, F.col(content))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    before = W.partitionBy("_path").orderBy(*(f"_{p}" for p in piece)).rowsBetween(W.unboundedPreceding, -1)
    sums = (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_bytes"))
    starts = wanted.mapInArrow(count, f"{kinds}, _n long, _bytes long").select("_path", *(f"_{p}" for p in piece), *sums)
    same = F.col("path").eqNullSafe(F.col("_path"))
    for p in piece:
        same = same & F.col(p).eqNullSafe(F.col(f"_{p}"))
    return found.join(starts, same).select("path", (F.col("index") + F.col("_n_before")).cast("int").alias("index"), "name", "type", "size", "mtime", (F.col("offset") + F.col("_bytes_before")).alias("offset"))


def _read(files: DataFrame, path: str, content: str, data: bool, piece: Sequence[str] = ()) -> DataFrame:
    if not files.sparkSession._jsparkSession.sessionState().conf().contains(_SETTING):
        files.sparkSession.conf.set(_SETTING, str(BATCH_BYTES))
    kinds = {**_KIND, **({"data": pa.binary()} if data else {})}
    whose = files.select(F.col(path).cast("string").alias("path"), *piece, F.col(content))
    n = 1 + len(piece)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blob = batch.column(n)[i].as_py() or b""
                walked = entries(blob)
                while rows := [(*e, *([blob[e[5] : e[5] + e[3]]] if data else [])) for e in itertools.islice(walked, BATCH)]:
                    own = [pa.repeat(batch.column(k)[i], len(rows)) for k in range(n)]
                    yield pa.record_batch([*own, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True))], [*batch.schema.names[:n], *kinds])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whose.schema.fields[:n])
    return whose.mapInArrow(look, f"{own}, index int, name string, type string, size long, mtime long, offset long" + (", data binary" if data else ""))


def find(entries: DataFrame, name: str, any_extension: bool = False) -> DataFrame:
    """The first entry of that name in each archive."""
    stem = F.regexp_replace("name", r"\.[^./]*$", "") if any_extension else F.col("name")
    wanted = F.regexp_replace(F.lit(name), r"\.[^./]*$", "") if any_extension else F.lit(name)
    first = F.min(F.struct("index", *[c for c in entries.columns if c not in ("path", "index")])).alias("e")
    return entries.where(stem == wanted).groupBy("path").agg(first).select("path", "e.*")
