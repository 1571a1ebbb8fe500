import corpus_pipeline
from plumbline.llm.op8_ngram_jaccard_join import shingles

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    documents = docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    items = [(r["item_id"], set(shingles(r["text"]).tolist())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        if name != "packing":
            assert sorted(docs.columns) == sorted(documents.columns)
            assert docs.exceptAll(before).count() == 0
            kept[name] = [(r["doc_id"], set(shingles(r["text"]).tolist())) for r in docs.select("doc_id", "text").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    known = good & {i for i, _ in kept["language"]}
    assert len(known & {i for i, _ in kept["quality"]}) >= 0.9 * len(known)
    # brute force over the stages that are exact
    link = lambda a, b: 100 * len(a & b) >= 75 * len(a | b) and a and b
    similar = kept["similar"]
    assert not any(link(similar[i][1], similar[j][1]) for i in range(len(similar)) for j in range(i))
    held = lambda s: any(100 * len(i & s) >= 75 * len(i) for _, i in items)
    assert {i for i, _ in kept["benchmark"]} == {i for i, s in similar if not held(s)}
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in kept["benchmark"]}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
