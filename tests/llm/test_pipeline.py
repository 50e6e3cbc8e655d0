"""The pipeline's stages against plain versions of the decisions they make."""

import public_tokenizers as P

import corpus_pipeline
from vectorscape.llm import bpe, decontaminate, neardup, pii, toxicity
from vectorscape.llm.shared import materialise, table


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, sf))
        steps.append((name, docs, out))
        docs = out
    by = {n: (a, b) for n, a, b in steps}
    assert all(by[n][1].columns == names for n in list(by)[:-1])

    before, after = by["toxicity"]
    model = toxicity.learn(before, toxicity.learning_rows(table(spark, sf, "labels")))
    bad = {r.doc_id for r in toxicity.score(before, model).collect() if r.score >= 0.5}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad

    before, after = by["near_duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.class_id for r in neardup.near_join(before).collect()})

    before, after = by["decontamination"]
    clean = {r.doc_id for r in decontaminate.contamination(before, table(spark, sf, "benchmark")).collect() if not r.contaminated}
    assert {r.doc_id for r in after.collect()} == clean

    before, after = by["pii"]
    texts = {r.doc_id: r.text for r in after.collect()}
    assert len(texts) == before.count() and not any(pii.base_spans(t) for t in texts.values())

    enc = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {r.doc_id: r.ids for r in by["bpe"][1].collect()} == {k: enc.encode_ordinary(t) for k, t in texts.items()}
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {r.doc_id: r.ids for r in by["bpe"][1].collect()}
