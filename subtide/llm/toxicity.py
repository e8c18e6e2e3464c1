"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words' features (the word and
its beginnings), and a document's is their noisy-or with a leak: 1 - (1 - leak) * product(1 - score). Weights are
trained from document labels alone, through the noisy-or, so they also tell which sentences offend.

The model is fitted on a bounded sample: the TRAIN_ROWS labelled rows with the smallest key hashes. Their texts are
read in parallel; the descent, on the telling features of their sentences alone, is one small task. Every row is
scored on its whole text; scoring needs no shuffle.

Null and empty texts score the leak. Of rows that share a key, the one with the least text trains. Labels that are null don't train; without any positive label the score is
the smoothed share of positives. Repeated rows get equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.llm.common import dropped, smallest, table, trimmed, tune, written

#: Bound of the training sample, in labelled rows.
TRAIN_ROWS = 8000
#: Lengths of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
#: A feature is kept if so many positive rows have it and it is surely so much likelier in them.
LEAST_ROWS, LEAST_LIFT, DOUBT = 2, 3.0, 1.5
#: Steps and rate of the descent, its first bias; how firmly weights keep to the features' own odds.
STEPS, RATE, START, HOLD = 150, 0.05, -4.0, 0.3
CACHE_WORDS = 400_000
#: Sentences from this score on are reported.
OFFENDS = 0.5

_WORD, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[str]:
    return [word + "$", *[word[:n] for n in BEGINNINGS if len(word) >= n]]


def telling(word: str, sure: dict[str, float]) -> str | None:
    """The most telling of a word's features."""
    got = [f for f in word_features(word) if f in sure]
    return max(got, key=lambda f: (sure[f], f)) if got else None


def held_out(key: str):
    """The fixed quarter of the keys that never trains."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2


def found_words(text: str) -> list[list[str]]:
    """The distinct words of each sentence, in order."""
    return [sorted(set(_WORD.findall(part))) for part in _SENTENCE.findall(text.lower())]


def kept_features(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """Features that tell, from (feature, positive rows, negative rows): log odds, less a doubt that shrinks with the rows."""
    sure = {f: math.log(p / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1)) - DOUBT / p**0.5 for f, p, n in counts if p >= LEAST_ROWS}
    return {f: sure[f] for f in sorted(sure) if sure[f] >= math.log(LEAST_LIFT)}


def told(sentences: list[list[str]], sure: dict[str, float]) -> list[list[str]]:
    """The telling features of the sentences that have some."""
    got = [sorted({f for w in words if (f := telling(w, sure))}) for words in sentences]
    return [x for x in got if x]


def descend(bags: list[list[list[str]]], labels: list[int], sure: dict[str, float], steps: int = STEPS) -> dict:
    """Weights of the features, bias and leak from bags of sentences and their labels, by noisy-or likelihood.

    It begins at the features' own odds, which also hold the weights: words that come together in positive rows would
    otherwise explain one another away.
    """
    n_pos = sum(labels)
    leak = (n_pos * 0.02 + 0.01) / (len(labels) + 1) if n_pos else 0.5 / (len(labels) + 1)
    index = {f: n for n, f in enumerate(sure)}
    feature, sentence, bag = [], [], []
    for n, sentences in enumerate(bags):
        for got in sentences:
            feature += [index[f] for f in got]
            sentence += [len(bag)] * len(got)
            bag.append(n)
    if not bag:
        return {"weights": {}, "sure": {}, "bias": 0.0, "leak": leak}
    feature, sentence, bag, label = np.array(feature), np.array(sentence), np.array(bag), np.array(labels, float)
    start = np.array(list(sure.values()))
    w, b, m, v = start.copy(), START, np.zeros(len(start) + 1), np.zeros(len(start) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(sentence, w[feature], len(bag)) + b
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        q = (1 - leak) * np.exp(np.bincount(bag, np.log1p(-np.minimum(s, 1 - 1e-12)), len(label)))
        pull = np.where(label == 1, -q / np.maximum(1 - q, 1e-9), 1.0)
        dz = s * pull[bag]
        g = np.append(np.bincount(feature, dz[sentence], len(w)) + HOLD * (w - start), dz.sum() + HOLD * (b - START))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return {"weights": {f: float(x) for f, x in zip(sure, w, strict=True)}, "sure": sure, "bias": float(b), "leak": leak}


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, steps: int = STEPS) -> bytes:
    """The pickled model, from the sample's rows; it is as small as the sample's telling features.

    Texts are read where they lie: tasks count features, and send on only the telling features of each sentence.
    """
    tune(docs.sparkSession)
    known = labels.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    known = known.select(F.col(f"`{key}`").alias("key"), (F.col(f"`{label}`") > 0).cast("int").alias("y"), F.xxhash64(F.col(f"`{key}`")).alias("h"))
    cut = smallest(known.select("h"), "h", TRAIN_ROWS)
    if cut is None:
        return pickle.dumps(descend([], [], {}, steps))
    chosen = F.broadcast(known.filter(F.col("h") <= cut).dropDuplicates(["key"]).drop("h"))
    sample = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(chosen, "key")
    # rows that share a key are one row of the sample
    sample = written(sample.groupBy("key").agg(F.min("text").alias("text"), F.min("y").alias("y")))

    def count(batches):
        counts, rows = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(t.as_py().lower()))
                rows[y] += 1
                counts.update({(f, y) for w in words for f in word_features(w)})
        got = [("", y, n) for y, n in rows.items()] + [(f, y, n) for (f, y), n in counts.items()]
        for a in range(0, len(got), 1 << 16):
            f, y, n = zip(*got[a : a + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(y, pa.int32()), pa.array(n, pa.int64())], ["f", "y", "n"])

    counted = sample.select("text", "y").mapInArrow(trimmed(count), "f string, y int, n long").groupBy("f")
    counted = counted.agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n"))
    rows = [tuple(r.values()) for r in counted.filter(f"f = '' OR p >= {LEAST_ROWS}").toArrow().to_pylist()]
    n_pos, n_neg = next(((p, n) for f, p, n in rows if not f), (0, 0))
    sure = kept_features([r for r in rows if r[0]], n_pos, n_neg)

    def bags(batches):
        for b in batches:
            got = [json.dumps(told(found_words(t.as_py()), sure)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string()), b.column(2)], ["key", "bag", "y"])

    def learn(batches):
        made, ys = [], []
        for b in batches:
            made += map(json.loads, b.column(0).to_pylist())
            ys += b.column(1).to_pylist()
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(descend(made, ys, sure, steps))]})

    sent = sample.select(F.col("key").cast("string").alias("key"), "text", "y").mapInArrow(trimmed(bags), "key string, bag string, y int")
    model = sent.repartition(1).sortWithinPartitions("key", "bag").select("bag", "y").mapInArrow(learn, "model binary").first()[0]
    dropped(sample)
    return model


class Scorer:
    def __init__(self, model: bytes) -> None:
        got = pickle.loads(model)
        self.weights, self.sure, self.bias, self.leak = got["weights"], got["sure"], got["bias"], got["leak"]
        self.cold: set[str] = set()
        self.hot: dict[str, str] = {}

    def _warm(self, words: set[str]) -> bool:
        """Whether a word has a feature of the model; the others are remembered."""
        for w in words - self.cold:
            if w not in self.hot:
                if f := telling(w, self.sure):
                    self.hot[w] = f
                else:
                    self.cold.add(w)
        found = not words.isdisjoint(self.hot)
        if len(self.cold) + len(self.hot) > CACHE_WORDS:
            self.cold.clear()
        return found

    def __call__(self, text: str | None) -> tuple[float, list[dict]]:
        """The score, and the offending sentences as spans of code points."""
        low = (text or "").lower()
        if text and len(low) != len(text):  # a letter whose lower case is longer; spans are of the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        rest, spans = 1 - self.leak, []
        if self._warm(set(_WORD.findall(low))):
            for part in _SENTENCE.finditer(low):
                got = {self.hot[w] for w in set(_WORD.findall(part[0])) if w in self.hot}
                if got:
                    z = sum(self.weights[f] for f in sorted(got)) + self.bias
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                    rest *= 1 - p
                    if p >= OFFENDS:
                        spans.append({"start": part.start(), "end": part.end(), "score": p})
        return 1 - rest, spans


SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("score", "double"))


def score(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns, score (0 to 1) and offending (spans of sentences)."""
    spark = tune(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "score", "offending")]
    shared = spark.sparkContext.broadcast(model)
    plain = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = plain.drop("__text").schema.add("score", "double").add("offending", SPANS)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [scorer(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s for s, _ in got], pa.float64()), pa.array([x for _, x in got], spans_type)], schema.fieldNames())

    return plain.mapInArrow(run, schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of rows that are not held out train the model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    found = score(docs, fit(docs, labels, "doc_id", "text", "toxic"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))
