"""Rows that share a doc_id or have none, through near duplicates and their stage of the pipeline."""

from collections import Counter

import corpus_pipeline
from subtide.llm import neardup


def text(name, last=""):
    return " ".join([f"{name}{n}" for n in range(60)] + [last] * bool(last))


ROWS = [(3, text("a")), (5, text("a")), (5, text("b")), (7, text("c")), (7, text("c", "x")), (7, text("c", "y")), (None, text("d")), (None, text("d")), (None, text("d", "x")),
        (None, text("a", "x")), (8, text("e")), (None, text("f")), (None, text("g")), (9, ""), (9, ""), (10, None), (11, text("h")), (11, text("h")), (12, text("g", "x"))]


def test_classes_of_rows_without_key(spark):
    got = neardup.classes(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    want = Counter()
    for d, t in ROWS:
        like = [k for k, u in ROWS if t and u and t[:2] == u[:2]]
        known = [k for k in like if k is not None]
        want[d, min(known) if known else d, max(0, len(like) - 1)] += 1
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want


def test_one_row_of_each_class_stays(spark):
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"][:2] if r["text"] else r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == Counter([(3, "a0"), (5, "b0"), (7, "c0"), (None, "d0"), (8, "e0"), (None, "f0"), (12, "g0"), (9, ""), (9, ""), (10, None), (11, "h0")])
