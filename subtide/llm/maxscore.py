"""Exact top-k search by MaxScore over integer vectors.

The terms of a query are its components that are not 0. Rows are dealt by a hash into shards of blocks; a block keeps,
for each term, the least and greatest component. A term's posting in a document is what it adds above the least that
it can add in the block; its bound is the greatest such posting. With a k-th best score known, terms are split by
their bounds: the non-essential ones are those of the smallest bounds that together can't lift a document to that
score. The postings of the essential terms are traversed for all documents of the block; the others are probed, the
largest bounds first, only for documents that are still competitive, and those that fall behind drop out. What stays
is scored exactly. The k-th best score is carried from block to block and, in a task, from shard to shard. A shard
returns its best of each query and the shards' lists merge by score, then smaller key.

Queries come in blocks to every shard, so no task holds all rows or all queries at once. Vectors that are null, empty
or hold a component that is null or, scaled, not finite take no part; a query meets the vectors of its own length
only. Arithmetic is exact: in doubles while sums stay below 2^53, else in whole numbers of any size; a score beyond 64
bits is given as the greatest or least that they hold. A row is never its own candidate; other rows with its key are.
Repeated rows are queries and candidates each. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subtide.llm.common import table, trimmed, tune, written

#: About so many rows, and components, are a block, at most, and one block a shard; so many queries a block; terms that
#: are probed at once.
BLOCK_ROWS, BLOCK_VALUES, BLOCK_QUERIES, PROBED = 8192, 1 << 19, 512, 8
#: Queries whose k-th best score a task keeps from shard to shard; only saves time.
KEPT_FLOORS = 200_000
#: Sums of whole numbers below this are exact in doubles; bounds of a 64-bit score.
EXACT, MOST, LEAST = float(1 << 53), (1 << 63) - 1, -(1 << 63)


def valid(vector: str, scale: float = 1.0) -> Column:
    """Not null, not empty, every component a number that is finite when scaled."""
    v = F.col(f"`{vector}`")
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))


def floored(vector: str, scale: int) -> Column:
    """Components as whole numbers, in doubles: floor(scale * x)."""
    # a double of 2^53 or more is whole
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    return F.transform(F.col(f"`{vector}`"), lambda x: whole(x.cast("double") * float(scale)))


def numbered(rows: DataFrame, asked: Column) -> DataFrame:
    """rows with rid, a number of the row, and asked, as a table: so the numbers stay."""
    return written(rows.withColumns({"asked": F.coalesce(asked, F.lit(False)), "rid": F.monotonically_increasing_id()}))


def _blocks(rows: DataFrame, parts: int, block: int, kind: int) -> DataFrame:
    """(shard, kind, block, rids, keys, data, width): rows (rid, key, v) of a part as packed matrices of up to block rows."""
    flat = rows.select(F.pmod(F.xxhash64("rid", F.lit(kind)), F.lit(parts)).cast("int").alias("part"), F.size("v").alias("width"), "rid", "key", "v")
    schema = "shard int, kind int, block int, rids binary, keys binary, data binary, width int"

    def pack(batches):
        open_, n, count = None, 0, 0
        rids, keys, vals = [], [], []

        def out():
            nonlocal n
            n += 1
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([open_[0]], pa.int32()), "kind": pa.array([kind], pa.int32()), "block": pa.array([n], pa.int32()),
                "rids": [np.concatenate(rids).astype("<i8").tobytes()], "keys": [np.concatenate(keys).astype("<i8").tobytes()], "data": [np.concatenate(vals).astype("<f8").tobytes()],
                "width": pa.array([open_[1]], pa.int32()),
            })

        for b in batches:
            part, width, rid, key = (b.column(i).to_numpy() for i in range(4))
            values = b.column(4).flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(width)])
            i = 0
            while i < len(part):
                if open_ != (part[i], width[i]) or count >= block:
                    if count:
                        yield out()
                    open_, rids, keys, vals, count = (part[i], width[i]), [], [], [], 0
                same = (part[i:] == open_[0]) & (width[i:] == open_[1])
                m = min(len(same) if same.all() else int(same.argmin()), block - count)
                rids.append(rid[i : i + m])
                keys.append(key[i : i + m])
                vals.append(values[at[i] : at[i + m]])
                count += m
                i += m
        if count:
            yield out()

    return flat.repartition(parts, "part").sortWithinPartitions("part", "width", "key", "rid").mapInArrow(trimmed(pack), schema)


class Block:
    """Documents of one length, as terms by documents, with the bounds of each term."""

    def __init__(self, rids: np.ndarray, keys: np.ndarray, data: np.ndarray) -> None:
        self.rids, self.keys, self.docs = rids, keys, np.ascontiguousarray(data.T)
        self.low, self.high = self.docs.min(1), self.docs.max(1)
        self.size = np.maximum(np.abs(self.low), np.abs(self.high))

    def best(self, query: np.ndarray, own: int, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, float | None]:
        """Scores and places of up to k documents that may be among the k best, and the k-th best score known now."""
        terms = np.flatnonzero(query)
        weight = query[terms]
        alive = np.flatnonzero(self.rids != own)
        if not len(alive):
            return np.zeros(0, object), alive, floor
        if float(np.abs(weight) @ self.size[terms]) >= EXACT:
            return self._plainly(terms, weight, alive, k, floor)
        least = np.minimum(weight * self.low[terms], weight * self.high[terms])
        bound = np.abs(weight) * (self.high[terms] - self.low[terms])
        order = np.argsort(-bound, kind="stable")
        terms, weight, bound = terms[order], weight[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)  # what the terms from a place on can add
        base = float(least.sum())
        # essential: the terms before the first place from which on nothing can lift a document to the floor
        split = len(terms) if floor is None else int(np.searchsorted(-rest, -(floor - base), side="right"))
        split = min(max(split, 1), len(terms)) if len(terms) else 0
        got = weight[:split] @ self.docs[terms[:split]]
        got = got[alive]
        rest_low = np.append(np.cumsum(least[order][::-1])[::-1], 0.0)
        n = split
        while True:
            sure = got + rest_low[n]
            if len(alive) > k:
                known = float(np.partition(sure, len(sure) - k)[len(sure) - k])
                floor = known if floor is None else max(floor, known)
            if floor is not None:
                stay = sure + rest[n] >= floor  # equal ones stay: ties go by key
                if not stay.all():
                    alive, got = alive[stay], got[stay]
            if n >= len(terms) or not len(alive):
                break
            to = min(len(terms), n + PROBED)
            got = got + weight[n:to] @ self.docs[np.ix_(terms[n:to], alive)]
            n = to
        return got, alive, floor

    def _plainly(self, terms, weight, alive, k, floor):
        """The same without bounds, for numbers that doubles don't hold."""
        whole = [int(w) for w in weight]
        got = np.array([sum(w * int(x) for w, x in zip(whole, self.docs[terms, d], strict=True)) for d in alive], object)
        return got, alive, floor


def first_k(scores: np.ndarray, keys: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller key, then row."""
    return np.array(sorted(range(len(scores)), key=lambda n: (-scores[n], keys[n], rids[n]))[:k], np.int64) if scores.dtype == object else np.lexsort((rids, keys, -scores))[:k]


def search(rows: DataFrame, key: str, vector: str, asked: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, key, score): the k greatest inner products of the floored vector of each row that is asked."""
    tune(rows.sparkSession)
    c = F.col(f"`{key}`")
    base = numbered(rows.filter(valid(vector, float(scale)) & c.isNotNull()).select(c.cast("long").alias("key"), floored(vector, scale).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")), F.col("asked"))
    n, m, width = base.agg(F.count("*"), F.count(F.when(F.col("asked"), 1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    block = max(64, min(BLOCK_ROWS, BLOCK_VALUES // width))
    shards, packs = max(1, -(-n // block)), max(1, -(-m // BLOCK_QUERIES))
    names = ["shard", "kind", "block", "rids", "keys", "data", "width"]
    question = _blocks(base.filter("asked"), packs, BLOCK_QUERIES, 1).drop("shard")
    question = question.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = _blocks(base, shards, block, 0).select(*names).unionByName(question.select(*names))

    def run(batches):
        shard, held, floors = None, [], {}
        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != shard:
                    shard, held = r["shard"], []
                rids, keys = np.frombuffer(r["rids"], "<i8"), np.frombuffer(r["keys"], "<i8")
                data = np.frombuffer(r["data"], "<f8").reshape(len(keys), r["width"])
                if r["kind"] == 0:
                    held.append((r["width"], Block(rids, keys, data)))
                    continue
                out: list[tuple] = []
                for rid, own, q in zip(rids.tolist(), keys.tolist(), data, strict=True):
                    floor, found = floors.get(rid), []
                    for width, block in held:
                        if width == len(q):
                            got, places, floor = block.best(q, rid, k, floor)
                            found.append((got, block.keys[places], block.rids[places]))
                    if not found:
                        continue
                    scores, of, at = (np.concatenate(x) for x in zip(*found, strict=True))
                    best = first_k(scores, of, at, k)
                    if len(best) == k and scores.dtype != object:
                        floor = float(scores[best[-1]]) if floor is None else max(floor, float(scores[best[-1]]))
                    if floor is not None:
                        if len(floors) >= KEPT_FLOORS:
                            floors.clear()
                        floors[rid] = floor
                    listed = [min(max(int(x), LEAST), MOST) for x in scores[best].tolist()]
                    out += zip([rid] * len(best), [own] * len(best), of[best].tolist(), at[best].tolist(), listed, strict=True)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query", "query_id", "key", "rid", "score"])

    dealt = both.repartition(max(1, min(shards, 4096)), "shard").sortWithinPartitions("shard", "kind", "block")
    lists = dealt.mapInArrow(trimmed(run), "query long, query_id long, key long, rid long, score long")
    w = W.partitionBy("query").orderBy(F.col("score").desc(), "key", "rid")
    return lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")


def op9_maxscore(spark, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 50 against all embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, "vec_id", "embedding", F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, q.rid AS q, d.rid, d.vec_id, list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * d.v[i]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.rid <> d.rid AND len(q.v) = len(d.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, rid)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
