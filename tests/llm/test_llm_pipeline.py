"""The pipeline on small tables against plain models of its decisions."""

import corpus_pipeline
from palimpsest.llm import packing, simhash
from palimpsest.llm.shared import table, written

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        rows = docs.collect()
        kept[name] = {r.doc_id for r in rows}
        assert all(before[r.doc_id].text == r.text for r in rows)
    toxic = {r.doc_id for r in table(spark, FOLDER, "labels").where("toxic = 1").collect()}
    assert len(toxic - kept["toxicity"]) >= 0.6 * len(toxic) and len(before) - len(kept["toxicity"]) <= 3 * len(toxic) + 5
    fps = {d: simhash.fingerprint((before[d].text or "").encode()) for d in kept["toxicity"]}
    one = kept["simhash_near_dedup"]
    for d in kept["toxicity"] - one:
        assert any((fps[d] ^ fps[e]).bit_count() <= 4 for e in fps if e != d)
    for d in one:
        assert not any((fps[d] ^ fps[e]).bit_count() <= 4 for e in one if e != d)
    items = [r.text for r in table(spark, FOLDER, "benchmark").collect()]
    clean = kept["benchmark_decontamination"]
    assert not any(item in before[d].text for d in clean for item in items)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    mixed = docs.count()
    assert packing.unpack(packed).select("doc_number").distinct().count() == mixed
