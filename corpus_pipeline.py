"""From raw documents to tokens: language, near duplicates, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and, but for the last, returns
the columns of documents. Null and empty texts have no language, so the first stage drops them. An empty table goes
through all stages. Rows that share a doc_id, or have none, are known by their texts too; equal rows are one class of
near duplicates. Columns other than those of documents are dropped.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm import bpe, langid, mixing, neardup, repeats
from subtide.llm.common import stage, table, tune, without, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _tagged(docs: DataFrame) -> DataFrame:
    """With a hash of the text: rows may share a doc_id."""
    return docs.select(*COLUMNS).withColumn("tag", F.xxhash64("text"))


def _stage(f):
    """A stage whose helper tables go when the next one begins."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage(spark, docs):
            return f(spark, docs, sf_dir)

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is in no language of the model; the source is the host, lang the declared language."""
    tune(spark)
    model = langid.fit(docs, "doc_id", "text", "lang")
    tagged = _tagged(docs)
    found = langid.fuse(langid.text_evidence(tagged, "text", ["doc_id", "tag", "lang", "source"], model), model[0], "lang", ["source"])
    return without(tagged, found.filter("rejected"), ["doc_id", "tag"]).select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, that with the smallest doc_id and, under one doc_id, text hash; null is the greatest."""
    tagged = _tagged(docs)
    found = neardup.classes(docs, tagged=True)
    kept = without(tagged, found.filter(~F.col("first")), ["doc_id", "tag"])
    again = tagged.groupBy("doc_id", "tag").count().filter("count > 1").limit(1).count()
    if again:  # a text without words is a class of its own
        worded = F.coalesce(F.col("text").rlike(mixing.WORDS), F.lit(False))
        kept = kept.filter(worded).dropDuplicates(["doc_id", "tag"]).unionByName(kept.filter(~worded))
    return kept.select(*COLUMNS)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that a document with a smaller doc_id holds too."""
    left = repeats.remove_repeats(docs.select(*COLUMNS), keep=["doc_id", "lang", "source"], as_text=True)
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the curriculum takes them, each as often as it takes it, in training order."""
    sized = docs.select(*COLUMNS).withColumn("size", mixing.word_count(F.col("text")))
    return mixing.mix(sized, "doc_id", "source", "size").select(*COLUMNS)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed documents, with a digest of what they decode to and their places in training order.

    The mixture is written range-sorted, so the order is that of part and, within it, row; null if docs is in no files.
    """
    path = bpe.vocabulary()
    place = [F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("row")]
    if docs.inputFiles():
        place = [F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("int").alias("part"), F.col("_metadata.row_index").alias("row")]
    placed = docs.select("doc_id", "text", "lang", "source", *place)
    both = bpe.round_trip(placed, path, keep=["doc_id", "lang", "source", "part", "row"])
    return both.select("doc_id", "lang", "source", "part", "row", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mixture),
    ("BPE encoding", tokens),
]

#: Hashes, trained models and tokenizers are not SQL; tests hold the stages but the first against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs)
    return docs
