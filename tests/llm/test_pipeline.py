"""The pipeline's stages hold to their operators, and its rows are whole."""

from __future__ import annotations

import corpus_pipeline as cp
from folianta.llm import decontam, mixing, neardup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        ids = lambda df: sorted(r["doc_id"] for r in df.collect())
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids(out) == ids(toxicity.score_documents(docs, model).filter("predicted = 0"))
        elif name == "near_dedup":
            assert ids(out) == ids(neardup.near_duplicates(docs).filter("kept"))
        elif name == "decontamination":
            assert ids(out) == ids(decontam.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("NOT contaminated"))
        elif name == "mixing":
            assert ids(out) == sorted(r["doc_id"] for r in mixing.mix(docs).collect() for _ in range(r["copies"]))
        else:
            assert ids(out) == ids(docs)
            continue
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert cp.run(spark, SF).count() == docs.count()
