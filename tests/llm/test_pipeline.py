import corpus_pipeline
from histlab.llm.common import materialize
from histlab.llm.queries import queries

from ..conftest import DATA


def test_stages(spark):
    docs = spark.read.parquet(DATA + "/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns and docs.count() <= before, name
        before = docs.count()
        assert docs.where("n_chars <> length(text)").count() == 0 or name == "quality"
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, DATA).count() == last.count()


def test_stages_with_odd_rows(spark, odd):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), f"odd-{name}")
        empty = stage(spark, odd.select(*corpus_pipeline.COLUMNS).limit(0), DATA)
        assert empty.count() == 0


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
