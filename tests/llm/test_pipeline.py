import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, docs, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "encode_pieces"]
    for start in (docs, none):
        at = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, "")
            if k < 4:
                assert out.columns == at.columns, name
            at = out.cache()
        if start is docs:
            assert at.count() > 0 and at.where(F.size("ids") != F.col("n_ids")).count() == 0
            assert at.where("doc_id IN (101, 201, 311, 312, 300)").count() == 0
        else:
            assert at.count() == 0


def test_fragments_go_and_whole_documents_stay(spark):
    """Brute force of the stage: equal lines after their first go, and with them texts that keep lines but fewer than 50 words."""
    rng = random.Random(1)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared, own = [line(40) for _ in range(3)], [line(60) for _ in range(3)]
    rows = [(1, "\n".join(shared)), (2, "\n".join([*shared, line(5)])), (3, "\n".join([shared[0], own[0]])), (4, line(10)), (5, "\n".join(shared)), (6, None), (7, own[1]), (None, own[2])]
    table = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, table, "").collect()}
    want = {1: rows[0][1], 3: own[0], 4: rows[3][1], 6: None, 7: own[1], None: own[2]}
    assert {k: t for k, (t, _) in got.items()} == want and all(n == (len(t) if t is not None else None) for t, n in got.values())


def test_run_is_the_stages_one_after_another(spark, docs, tmp_path):
    """run() over a table equals each stage's own definition, worked out in plain Python where it is simple: which doc_ids survive."""
    from gleanery.llm import mixing, neardup, quality

    docs.where("doc_id IS NOT NULL").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = table.join(quality.quality_verdicts(table).where("kept").select("doc_id").distinct(), "doc_id", "left_semi")
    lines = corpus_pipeline.line_dedup(spark, kept, "").cache()
    alone = lines.join(neardup.near_duplicates(lines).where("kept").select("doc_id").distinct(), "doc_id", "left_semi").cache()
    taken = {r.doc_id for r in mixing.mix_shares(alone).where("taken > 0").collect()}
    assert set(out.doc_id) == taken and out.n_ids.gt(0).all()
