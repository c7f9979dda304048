"""The pipeline's stages against what each of them promises, on the smallest table."""

import corpus_pipeline
from skywindow.llm import decontaminate, near_dup, quality_knn, secret_scan


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "mixture":
            assert docs.columns == columns
    labels, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("labels", "benchmark"))
    before, after = seen["quality"]
    scores = quality_knn.quality_scores(before, labels)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    before, after = seen["near_duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.class_id for r in near_dup.classes(before).select("class_id").distinct().collect())
    before, after = seen["leaks"]
    hit = {r.doc_id for r in decontaminate.leaks(before, bench).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - hit
    before, after = seen["secrets"]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        found = secret_scan.scan(texts[r.doc_id])
        assert r.text == secret_scan.redact(texts[r.doc_id], found) and r.n_chars == len(r.text)
    before, after = seen["mixture"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()} and after.count() > before.count() // 2
