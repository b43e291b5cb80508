"""The pipeline's stages keep what they should, and the whole is the stages in turn."""

import corpus_pipeline
from sitestance.llm import line_frequency, packing, simhash


def test_stages(spark, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "secret_scan", "source_mix", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows, counts = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, rows = rows, stage(spark, rows, sf_dir).cache()
        counts.append(rows.count())
        assert i == 4 or rows.columns == columns
        if i == 0:
            kept = {r.doc_id for r in line_frequency.digest(before).where("kept").collect()}
            assert {r.doc_id for r in rows.collect()} == kept
        elif i == 1:
            groups = {r.component_id for r in simhash.digest(before).collect()}
            assert sorted(r.doc_id for r in rows.collect()) == sorted(groups)
        elif i == 2:
            assert counts[2] == counts[1] and rows.where("text like '%AKIA________________%'").count() == 0
        elif i == 4:
            tokens = packing.pack(before).agg({"length": "sum"}).first()[0]
            assert rows.agg({"length": "sum"}).first()[0] == tokens
    whole = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, rows.select(key).collect()))
