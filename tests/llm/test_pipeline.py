import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, seen = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        seen.append(docs.select("doc_id").distinct().count())
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0


def test_empty_and_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the cat and the dog", "en", None, 19), (2, "the cat and the dog", "en", None, 19)]
    for name, given in (("odd", rows), ("none", [])):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, "").write.parquet(str(tmp_path / name / str(n)))
            docs = spark.read.parquet(str(tmp_path / name / str(n)))
        # null and empty texts go; two equal rows are one class, of which one stays, taken up to twice
        assert docs.count() in (1, 2) if name == "odd" else docs.count() == 0
