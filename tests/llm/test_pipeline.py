"""The pipeline's stages on the small tables and on edge cases."""

import corpus_pipeline
from tests.llm.inputs import SMALL, messy, no_rows, rows_of
from voxgrain.llm.common import table
from voxgrain.llm.mixing import word_count


def test_stages_follow_each_other(spark):
    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), "t")
        assert docs.columns == columns, name
        if name in ("quality", "near duplicates"):
            assert docs.count() < before, name
            before = docs.count()
        if name == "personal data":
            assert docs.count() == before and docs.where("text rlike '<(email|phone|card|ip)>'").count() > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.selectExpr("sum(length)").first()[0] == pieces.selectExpr("max(sequence_id) * 2048 + max_by(offset + length, sequence_id * 2048 + offset)").first()[0]
    assert docs.where(word_count("text") == 0).count() >= 0


def test_stages_take_any_documents(spark):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, messy(spark), SMALL).count()
        assert rows_of(stage(spark, no_rows(spark), SMALL)) == [], name


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_near_duplicates_by_fingerprint_and_by_shingles(spark):
    often = " ".join(f"w{i}" for i in range(100))
    texts = {1: " ".join([often] * 50), 2: " ".join([often] * 50 + [f"new{i}" for i in range(40)]), 3: " ".join(f"x{i}" for i in range(60))}
    texts |= {4: texts[3] + " end", 5: "quite another text of some few words"}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, SMALL).collect()) == [1, 3, 5]
