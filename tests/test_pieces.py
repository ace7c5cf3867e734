"""Files in pieces: pieces put together are the file, however many there are, and a task holds one piece."""

import io
import tarfile

import pytest

from tessera.plans import chain
from tessera.sources import models


def test_pieces_of_model_files_are_the_files(spark, data, same_rows, monkeypatch):
    monkeypatch.setattr(chain, "PIECE", 3)
    files = {}
    for r in sorted(chain._model_pieces(spark, data).collect()):
        assert len(list(models.parse_components(r.text, head=r.piece == 0))) <= 3
        files[r["class"]] = files.get(r["class"], "") + r.text
    wanted = {r["class"]: r.n for r in chain._components(spark, data, "true").groupBy("class").agg({"component": "count"}).toDF("class", "n").collect()}
    read = {name: models.parse_model(text) for name, text in files.items()}
    assert {name: len(m.components) for name, m in read.items()} == wanted and max(wanted.values()) > 3
    assert all(models.format_model(m) == files[name] and m.parameters == {"cell": "8"} for name, m in read.items())
    same_rows(chain.model_files, chain.oracle_sql()["model_files"])


@pytest.mark.parametrize("name", ["tar_find", "tar_index", "tar_extract"])
def test_pieces_of_archives_are_the_archives(name, spark, data, same_rows, monkeypatch):
    monkeypatch.setattr(chain, "KEYS", 60)
    monkeypatch.setattr(chain, "PIECE_BYTES", 3000)
    whole, pieces = {}, sorted(chain._archives(spark, data).collect())
    for r in pieces:
        assert len(r.content) <= 4096
        whole[r.path] = whole.get(r.path, b"") + bytes(r.content)
    assert len(pieces) > 3 * len(whole)
    wanted = spark.read.parquet(f"{data}/part.parquet").orderBy("p_partkey").collect()
    for path, content in whole.items():
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            read = [(m.name, m.mtime, tar.extractfile(m).read().decode(), m.offset_data) for m in tar.getmembers()]
        assert [r[:3] for r in read] == [(f"part_{p.p_partkey}.txt", p.p_partkey, p.p_name) for p in wanted if p.p_brand == path]
    same_rows(chain.queries()[name], chain.oracle_sql()[name])
