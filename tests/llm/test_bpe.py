import random

import pytest

from tessera.llm import bpe
from tests.llm.conftest import sha

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())


def test_query_equals_library(spark, data, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in bpe.query(spark, data).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(library, texts[r.doc_id])


def test_odd_texts(odd, odd_texts, library, empty):
    got = sorted((tuple(r)[:4] for r in bpe.encoded(odd, bpe.default_path()).collect()), key=repr)
    assert got == sorted(((d, *wanted(library, t)) for d, t in odd_texts), key=repr)
    assert bpe.encoded(empty, bpe.default_path()).count() == 0


def test_random_words_and_characters(library):
    rng = random.Random(7)
    vocabulary = [t.replace("</w>", "") for t in library.get_vocab()]
    texts = ["I'm <|endoftext|>x<|startoftext|>", "ΑΣ ΟΔΟΣ. İ ﬁ Å \x1c\x85 y", "a" * 5000, "<|endoftext|>" * 3]
    texts += ["".join(rng.choice("abeinorst") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts += ["".join(rng.choice(vocabulary) for _ in range(6)) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x3000, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(40)) for _ in range(200)]
    encoder = bpe.Encoder(bpe.vocabulary(bpe.default_path()))
    for text, ids in zip(texts, encoder.run(texts), strict=True):
        decoded = encoder.decode(ids)
        assert (len(ids.split()), sha(ids.encode()), sha(decoded.encode())) == wanted(library, text), text


def test_generations_of_known_words(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 500)
    encoder = bpe.Encoder(bpe.vocabulary(bpe.default_path()))
    for text in ("red blue green", "red one two three", "red blue four five six " + " ".join(f"w{i}" for i in range(40)), "red w1 blue,", ""):
        (ids,) = encoder.run([text])
        assert ids == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_long_texts_come_in_segments(monkeypatch, spark, library):
    monkeypatch.setattr(bpe, "RUN_CHARS", 50)
    texts = ["one two  three " * 40, "x" * 300, "", " ", "<|endoftext|> a" * 30, "Σα é\u0301 " * 20, "a" * 60 + " " + "b" * 60]
    parts: dict = {}
    for rows, cut in bpe.segments(texts):
        for row, part in zip(rows, cut, strict=True):
            parts.setdefault(row, []).append(part)
    assert ["".join(parts[i]) for i in range(len(texts))] == texts
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encoded(df, bpe.default_path()).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, library.decode(ids, skip_special_tokens=False))
        assert tuple(r)[1:4] == wanted(library, texts[r.doc_id])


def test_fits_are_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "FITS", 3)
    v = bpe.Vocabulary(bpe.default_path())
    text = "unbelievable antidisestablishmentarianism xqzvk"
    assert bpe.Encoder(v).run([text]) == [" ".join(map(str, library.encode(text, add_special_tokens=False).ids))]
    assert len(v.fits) <= 3
