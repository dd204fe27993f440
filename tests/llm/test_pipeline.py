"""The pipeline's stages, each against what its operator says of the same rows."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    from litweave.llm.common import cut, table
    from litweave.llm.minhash import near_duplicates
    from litweave.llm.mixing import mix
    from litweave.llm.secrets import scan
    from litweave.llm.toxicity import toxicity

    docs = table(spark, sf, "documents")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("toxicity", "near_dedup", "secrets", "mixing", "packing")
    clean = cut(stages[0](spark, docs, sf))
    bad = {r["doc_id"] for r in toxicity(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    single = cut(stages[1](spark, clean, sf))
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in near_duplicates(clean).where("kept").collect()}
    safe = cut(stages[2](spark, single, sf))
    assert safe.count() == single.count() and not any(scan([r["text"] for r in safe.collect()]))
    mixed = cut(stages[3](spark, safe, sf))
    assert sum(len(r["text"].split()) for r in mixed.collect()) == mix(safe).agg({"taken": "sum"}).first()[0]
    assert all(x.columns == docs.columns for x in (clean, single, safe, mixed))
    packed = stages[4](spark, mixed, sf)
    assert packed.where("piece = 0").count() == mixed.count()
