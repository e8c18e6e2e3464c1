"""Rows of single stages of the pipeline against brute force."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from subtide.llm import bpe
from subtide.llm.common import table
from test_queries import removed

FOLDER = "/root/testdata/sf0.001"


def some(spark):
    return table(spark, FOLDER, "documents").filter("text IS NOT NULL").select(*corpus_pipeline.COLUMNS)


def test_repeated_passages(spark):
    rows = some(spark).collect()
    marks, want = removed([(r["doc_id"], r["text"].encode()) for r in rows]), Counter()
    for r in rows:
        kept = bytes(c for c, m in zip(r["text"].encode(), marks[r["doc_id"]], strict=True) if not m).decode("utf-8", "ignore")
        want[r["doc_id"], kept, r["lang"], r["source"], len(kept)] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.repeated_passages(spark, some(spark), FOLDER).collect()) == want


def test_tokens(spark):
    from tokenizers import Tokenizer

    lib, want = Tokenizer.from_file(bpe.vocabulary()), Counter()
    for r in some(spark).collect():
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], r["lang"], r["source"], np.array(ids, "<u4").tobytes(), len(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = corpus_pipeline.tokens(spark, some(spark), FOLDER).select("doc_id", "lang", "source", "ids", "n_tokens", F.col("decoded_sha256"))
    assert Counter((r[0], r[1], r[2], bytes(r[3]), r[4], r[5]) for r in got.collect()) == want
