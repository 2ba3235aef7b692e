import os

import pytest

import corpus_pipeline
from tensorloom.llm import decontam, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, [docs.count()]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == names, name
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids
        ids = left
        kept.append(docs.count())
        if name.startswith("SimHash"):
            found = simhash.near_duplicates(docs).collect()
            assert all(r.component_id == r.doc_id for r in found)
        if name.startswith("benchmark"):
            assert decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert kept[-1] > 0.5 * kept[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, whole)) and {r.doc_id for r in last} == ids


def test_nulls_ties_and_other_columns(spark, tmp_path):
    text = " ".join(f"the word number{i} of this text" for i in range(30))
    rows = [(k, f"{text} {k} " + "and so on " * (k % 3), "en", "s") for k in range(40)]
    rows += [(50, None, "en", "s"), (51, "", None, "s"), (None, text, "en", None), (3, rows[3][1], "en", "s"), (52, "12 34", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS score", "'x' AS fp", "2 AS item_id", "3 AS ids", "4 AS key")
    spark.createDataFrame([(1, None), (2, ""), (3, " ".join(f"item{i}" for i in range(40)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= some.count(), name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).count() == len(rows) and last(spark, docs.limit(0), str(tmp_path)).count() == 0
