from pyspark.sql import functions as F

import corpus_pipeline
from cuemill.llm import jaccard, pii
from cuemill.llm._common import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages_filter_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), f"test-{name}")
        assert out.schema.names == docs.schema.names
        before, after = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        assert after <= before
        if name == "ngram_jaccard_join":
            found = jaccard.near_duplicates(out)
            assert found.where("doc_id != component_id").count() == 0
            groups = jaccard.near_duplicates(docs)
            assert len(after) == groups.select("component_id").distinct().count()
        if name == "pii":
            assert after == before
            assert pii.find_pii(out).selectExpr("sum(size(filter(base, s -> s.rank < 2)))").first()[0] == 0
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]


def test_odd_rows_pass_through_all_stages(spark, make_docs):
    """Null, empty and repeated rows, null ids and extra columns with clashing names; then no rows at all."""
    rows = [(1, None), (2, ""), (3, "mail me at a@b.cd or not"), (3, "mail me at a@b.cd or not"), (None, "a text of its own without an id"), (None, None), (4, "one two three four five six seven")]
    docs = make_docs(rows).withColumn("root", F.lit(5)).withColumn("score", F.lit("s")).withColumn("row", F.lit(None).cast("string"))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"odd-{name}")
        empty = materialize(stage(spark, empty, SF), f"none-{name}")
        assert docs.columns == empty.columns and empty.count() == 0
    got = sorted(((r["doc_id"], r["text"], r["root"]) for r in docs.collect()), key=str)
    assert got == [(1, None, 5), (2, "", 5), (3, "mail me at [EMAIL] or not", 5), (4, rows[-1][1], 5), (None, "a text of its own without an id", 5), (None, None, 5)]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.collect()} == {1, 2, 3, 4, None}
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
