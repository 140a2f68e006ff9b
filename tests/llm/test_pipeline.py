"""The pipeline against its operators, one stage after another, on the smallest test tables."""

import corpus_pipeline
from auditlake.llm import bpe, decontaminate, near_dedup, quality, toxicity
from auditlake.llm.shared import table

SF_DIR = "/root/testdata/sf0.001"


def test_stages_are_what_their_operators_decide(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_dedup", "decontamination", "tokens"]
    labels, benchmark = table(spark, SF_DIR, "labels"), table(spark, SF_DIR, "benchmark")
    documents = table(spark, SF_DIR, "documents")

    def rejected(name, docs):
        if name == "toxicity":
            return {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
        if name == "quality":
            return {r.doc_id for r in quality.quality(docs, labels).collect() if not r.predicted}
        if name == "near_dedup":
            return {r.doc_id for r in near_dedup.near_duplicates(docs).collect() if not r.kept}
        return {r.doc_id for r in decontaminate.contaminated(docs, benchmark).collect()}

    docs, dropped = documents, 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = str(tmp_path / name)
        stage(spark, docs, SF_DIR).write.parquet(out)
        kept = spark.read.parquet(out)
        assert kept.columns == documents.columns
        gone = rejected(name, docs)
        before = {r.doc_id: r for r in docs.collect()}
        assert {r.doc_id: r for r in kept.collect()} == {i: r for i, r in before.items() if i not in gone}
        docs, dropped = kept, dropped + len(gone)
    assert dropped > 0
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    path = bpe.vocabulary("byte_bpe_50k.json")
    assert sorted(final.collect()) == sorted(bpe.round_trip(docs, path).collect())
    assert sorted(corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(final.collect())
