import corpus_pipeline
from scholia.llm import decontamination, quality_classifier, simhash, toxicity


def test_stages(spark):
    """Each stage keeps what its own operator says of the stage's input, and the last packs every document left."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf).persist())
    assert all(df.columns == docs.columns for df in steps[:-1])
    good = quality_classifier.scored(docs, quality_classifier.train(docs, labels))
    assert ids(steps[1]) == ids(good.where("score >= 0.3"))
    mild = toxicity.scored(steps[1], toxicity.train(steps[1], labels))
    assert ids(steps[2]) == ids(mild.where("score < 0.5"))
    parts = simhash.near_duplicates(steps[2])
    assert ids(steps[3]) == sorted({r.component_id for r in parts.collect()})
    leaks = {r.doc_id for r in decontamination.contaminated(steps[3], bench).collect()}
    assert ids(steps[4]) == [d for d in ids(steps[3]) if d not in leaks]
    assert sorted({r.doc_id for r in steps[5].collect()}) == ids(steps[4])
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.drop("ids", "sequence_id", "offset").groupBy("doc_id").sum("length").collect())) == sorted(map(tuple, steps[5].groupBy("doc_id").sum("length").collect()))
