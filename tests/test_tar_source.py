"""Archives as a data source, against the standard library's."""

import io
import os
import tarfile

import pytest

from tessera.sources import archives, tar_source

BODIES = {"a.txt": b"one", "dir/b.jpg": b"x" * 5000, "empty": b"", "long/" + "n" * 150 + ".jpg": b"far", "ü.txt": "ß".encode() * 700}


def pack(path, form=tarfile.GNU_FORMAT, bodies=BODIES):
    with tarfile.open(path, "w", format=form) as tar:
        for name, data in bodies.items():
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), 77
            tar.addfile(info, io.BytesIO(data))


@pytest.fixture
def source(spark):
    tar_source.register(spark)
    return lambda path, **options: spark.read.format(tar_source.NAME).options(**options).load(str(path))


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
@pytest.mark.parametrize("size", [1, 4000, 1 << 20])
def test_entries_equal_the_standard_librarys(source, tmp_path, form, size):
    pack(tmp_path / "a.tar", form)
    pack(tmp_path / "b.tar", form, {"only": b"here"})
    got = source(tmp_path, bytes=size).collect()
    assert {(os.path.basename(r.path), r.name): bytes(r.data) for r in got} == {("a.tar", n): d for n, d in BODIES.items()} | {("b.tar", "only"): b"here"}
    with tarfile.open(tmp_path / "a.tar") as tar:
        wanted = [(m.name, m.size, m.mtime, m.offset_data) for m in tar.getmembers()]
    assert [(r.name, r.size, r.mtime, r.offset) for r in sorted((r for r in got if r.path.endswith("a.tar")), key=lambda r: r["index"])] == wanted
    assert {r.type for r in got} == {"file"}


def test_an_archive_is_read_by_several_tasks(source, tmp_path):
    pack(tmp_path / "a.tar", bodies={f"f{i}": bytes([i]) * 3000 for i in range(40)})
    df = source(tmp_path / "a.tar", bytes=10_000)
    assert df.rdd.getNumPartitions() == 14 and df.count() == 40
    assert all(bytes(r.data) == bytes([int(r.name[1:])]) * 3000 for r in df.collect())


def test_archive_of_three_gigabytes_is_listed_by_its_headers(source, tmp_path, monkeypatch):
    """A sparse file: entries of 1 GB and of 9 GB, which needs a size in base 256, of which only headers exist."""
    path, at = tmp_path / "large.tar", 0
    with open(path, "wb") as out:
        for name, size in (("one", 1 << 30), ("two", 9 << 30), ("three", 1 << 30), ("four", 5)):
            info = tarfile.TarInfo(name)
            info.size = size
            out.seek(at)
            out.write(info.tobuf(tarfile.GNU_FORMAT))
            at += 512 + -(-size // 512) * 512
        out.seek(at - 512)
        out.write(b"12345" + b"\0" * 1531)
    listed = source(path, bodies="false").collect()
    assert [(r.name, r.size, r.data) for r in listed] == [("one", 1 << 30, None), ("two", 9 << 30, None), ("three", 1 << 30, None), ("four", 5, None)]
    read = []
    with open(path, "rb") as file:
        def at_most(at, n):
            read.append(n)
            file.seek(at)
            return file.read(n)

        assert len(list(archives.walk(at_most, os.path.getsize(path)))) == 4
    assert sum(read) <= 5 * 512
    df = source(path)
    assert df.rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="more than a value holds"):
        df.where("name = 'two'").collect()


def test_empty_folders_and_cut_archives(source, tmp_path):
    assert source(tmp_path).count() == 0
    pack(tmp_path / "a.tar", bodies={"a": b"x" * 600, "b": b"y" * 600})
    data = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "a.tar").write_bytes(data[:1800])  # the second header is cut
    assert [r.name for r in source(tmp_path).collect()] == ["a"]
