"""The pipeline's stages against brute-force versions, each on what the one before kept."""

import corpus_pipeline
from millrace.llm import packing, pipeline_stages, toxicity
from millrace.llm.shared import documents, stage
from tests.llm.test_operators import brute_components, brute_lines
from tests.llm.test_resemblance import alike, shingles


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = stage(pipeline_stages.drop_toxic(spark, docs, sf_dir), "clean")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored if not r.predicted}
    assert clean.columns == docs.columns

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    lines = stage(pipeline_stages.drop_repeated_lines(spark, clean, sf_dir), "lines")
    import hashlib

    digest = {d: h for d, _, _, h in brute_lines(rows)}
    kept = lines.collect()
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in kept} == digest
    assert all(r.n_chars == len(r.text) for r in kept) and lines.columns == docs.columns

    sets = {r.doc_id: shingles(r.text) for r in kept}
    roots = brute_components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    single = stage(pipeline_stages.drop_near_copies(spark, lines, sf_dir), "single")
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(roots.values())) and single.columns == docs.columns

    packed = pipeline_stages.pack(spark, single, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(roots.values())
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count() and packing.SHARD_DOCS > 0
