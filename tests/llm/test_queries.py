"""Queries with SQL equal it; the others are held against brute force on whole small tables."""

import hashlib

import numpy as np
import pytest
from oracle import check

from subtide.llm import ann, bpe, langid, registry, repeats, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    check(registry.queries()[name](spark, FOLDER), registry.oracle_sql()[name], FOLDER)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in bpe.op3_bpe(spark, FOLDER).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def removed(docs: list[tuple[int, bytes]]) -> dict[int, bytearray]:
    out, first = {}, {}
    for doc, data in sorted(docs):
        marks = bytearray(len(data))
        for a in range(len(data) - 49):
            if first.setdefault(data[a : a + 50], doc) < doc:
                marks[a : a + 50] = b"\1" * 50
        out[doc] = marks
    return out


def test_repeats_equal_brute_force(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want, data = removed(docs), dict(docs)
    for r in repeats.op8_repeats(spark, FOLDER).collect():
        marks, raw = want[r["doc_id"]], data[r["doc_id"]]
        runs = sum(m and not (n and marks[n - 1]) for n, m in enumerate(marks))
        kept = bytes(c for c, m in zip(raw, marks, strict=True) if not m)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), sum(marks), runs)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_ann_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got: dict[int, list[int]] = {}
    for r in ann.op6_ann(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = total = 0
    for n in np.flatnonzero(ids % 50 == 0):
        s = x @ x[n]
        s[n] = -2
        best = ids[np.lexsort((ids, -s))[:5]]
        hits, total = hits + len(set(best) & set(got[ids[n]])), total + 5
        assert len(got[ids[n]]) == 5
    assert hits / total >= 0.9


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows = toxicity.op2_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    right = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert right / (rows.toxic == 1).sum() >= 0.85 and right / (rows.predicted == 1).sum() >= 0.85
    assert rows.score.between(0, 1).all()


def test_language_of_pages(spark):
    rows = langid.op10_langid(spark, "/root/testdata/sf0.01").toPandas()
    assert (rows.lang == rows.declared).mean() >= 0.97
