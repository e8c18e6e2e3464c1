"""Training order: positions of the mix, and places in the last stage of the pipeline."""

import corpus_pipeline
from pyspark.sql import functions as F
from subtide.llm import mixing, registry
from subtide.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def by_force(rows):
    """(position, doc_id) of each copy, from (doc_id, place, size, source_size, target) in the order of the streams."""
    out, begin = [], {}
    for d, place, size, whole, target in rows:
        at = begin.get(place, 0)
        begin[place] = at + size
        schedule = mixing.CURRICULUM[place % 3]
        for c in (at, at + whole):
            if c + size / 2 > target:
                continue
            low, high = 0.0, 1.0  # bisection
            for _ in range(60):
                t, done = (low + high) / 2, 0.0
                for (a, w), (b, v) in zip(schedule, schedule[1:], strict=False):
                    x = min(max(t - a, 0.0), b - a)
                    done += w * x + (v - w) / (b - a) * x * x / 2
                low, high = (t, high) if done < c / target * mixing.integral(schedule) else (low, t)
            out.append((low, d))
    return sorted(out)


def test_positions_of_the_mix(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    made = mixing.streams(docs, "doc_id", "source", "size").select("doc_id", "source", "size", "source_size", "target", mixing.hash_order(F.col("doc_id")).alias("o")).collect()
    names = sorted({r["source"] for r in made}, key=lambda s: (s is None, s))
    rows = sorted(made, key=lambda r: (r["o"], r["doc_id"], r["size"]))
    want = by_force([(r["doc_id"], names.index(r["source"]), r["size"], r["source_size"], r["target"]) for r in rows])
    got = [(r["position"], r["doc_id"]) for r in registry.queries()["op7_mix_order"](spark, FOLDER).collect()]
    assert got == sorted(got) and len(got) == len(want) > 0
    assert all(abs(a - b) < 1e-6 for (a, _), (b, _) in zip(got, want, strict=True))
    assert sorted(d for _, d in got) == sorted(d for _, d in want)


def test_last_stage_keeps_the_order(spark, tmp_path):
    docs = table(spark, FOLDER, "documents").select(*corpus_pipeline.COLUMNS)
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    want = [r["doc_id"] for r in mixing.mix(sized, "doc_id", "source", "size").select("doc_id").collect()]
    corpus_pipeline.mixture(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), "").write.parquet(str(tmp_path / "tokens"))
    got = spark.read.parquet(str(tmp_path / "tokens")).collect()
    assert len({(r["part"], r["row"]) for r in got}) == len(got)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["part"], r["row"]))] == want
