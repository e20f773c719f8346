"""The pipeline: each stage's decisions take effect on what its predecessor kept."""

from cohorta.llm import decontamination, language_id, near_dup, quality_rules
from tests.llm.conftest import SF


def test_stages_follow_their_operators(spark, docs, vocab):
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["quality_rules", "language_id", "near_dedup", "decontamination", "best_fit_packing"]
    kept = [docs]
    for _, stage in P.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    ids = [{r.doc_id for r in df.select("doc_id").distinct().collect()} for df in kept]
    assert all(df.columns == docs.columns for df in kept[:-1])
    assert ids[1] == {r.doc_id for r in quality_rules.quality_rules(docs).collect() if r.kept}
    named = language_id.predict(kept[1], *language_id.learn(kept[1], vocab("piece_bpe_32k.model")), vocab("piece_bpe_32k.model"))
    assert ids[2] == {r.doc.doc_id for r in named.collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert ids[3] == {r.class_id for r in near_dup.classes(kept[2]).collect()}
    leaks = {r.doc_id for r in decontamination.contaminated(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids[4] == ids[3] - leaks and ids[5] == ids[4]
    assert {tuple(r) for r in P.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()} == {
        tuple(r) for r in kept[5].select("doc_id", "piece", "length", "ids_crc32").collect()}


def test_every_operator_is_registered(spark):
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
