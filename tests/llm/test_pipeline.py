from tests.llm import brute
from tests.llm.conftest import sha

import corpus_pipeline
from tessera.llm import bpe, quality
from tessera.llm.shared import read


def test_run_equals_brute_force(spark, data):
    docs = read(spark, data, "documents")
    kept = {r.doc_id for r in quality.classify(docs, read(spark, data, "labels")).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    first = {d for d, _, _, stays in brute.near_duplicates(rows, 80) if stays}
    rows = [r for r in rows if r[0] in first]
    rows = [(d, cut if gone else t) for (d, t), (_, _, gone, cut) in zip(rows, brute.repeats(rows), strict=True)]
    items = [(r.item_id, r.text) for r in read(spark, data, "benchmark").collect()]
    dirty = {r[0] for r in brute.contamination(rows, items) if r[5]}
    encoder = bpe.Encoder(bpe.vocabulary(bpe.default_path()))
    wanted = {}
    for d, t in rows:
        if d not in dirty:
            (ids,) = encoder.run([t or ""])
            wanted[d] = (len(ids.split()), sha(ids.encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, data).collect()}
    assert got == wanted


def test_stages_keep_columns_and_take_odd_rows(spark, data, odd, empty):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near-dedup", "substring dedup", "decontamination", "encoding"]
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, data)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == docs.count()
