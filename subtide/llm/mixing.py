"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

Each source follows a weight schedule: straight lines between (time, weight) knots over training time 0 to 1.
The schedule's integral is the source's weight; weights share the budget, a source that would repeat more than
allowed stops there, and the rest is shared by weight again. A source's documents form a stream in the order of
a hash of their key, repeated up to the limit; a copy is taken if its middle word lies before the target. The
copy that begins after c of the source's words is due when the integral of its schedule has reached c/target of
its whole, which a closed form per line inverts. The copies are range-sorted by that position.

A stream's running sums come in two steps, within ranges of the hash and over the ranges' sums, so that no task
holds a source: a source with a third of all rows is dealt over as many ranges as it has rows in thousands. Places in
an order over all rows (sources by code point, copies by position) are read off a range-sorted table: the rows of the
files before, and the row's place in its file. The budget's level is found by rounds of sums over all sources.

Null sources are one source, the last. Rows of size null or 0 take no words. Repeated rows are separate
documents. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subtide.llm.common import table, tune, written

WORDS = r"[^\x20\x09-\x0D]+"
#: About so many documents lie in one range of the hash; a source's ranges are bounded.
RANGE_ROWS, MOST_RANGES = 4096, 1 << 16
#: A table of sources up to this length is broadcast; a longer one is joined by a shuffle.
BROADCAST_SOURCES = 100_000

Schedule = list[tuple[float, float]]
#: Weights 3, 1, 2 as curricula: the first and third fade out, the second grows.
CURRICULUM: list[Schedule] = [[(0.0, 4.5), (1.0, 1.5)], [(0.0, 0.5), (0.5, 0.75), (1.0, 2.0)], [(0.0, 3.0), (1.0, 1.0)]]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    marks = F.regexp_replace(text, WORDS, "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def integral(schedule: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))


def due(schedule: Schedule, part: Column) -> Column:
    """The time at which the schedule's integral has reached a part (0 to 1) of its whole."""
    whole, done, out = integral(schedule), 0.0, F.lit(float(schedule[-1][0]))
    steps = []
    for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False):
        rest, slope = part * whole - F.lit(done), (v - w) / (u - t)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + rest * (2 * slope)))
        done += (u - t) * (w + v) / 2
        steps.append((done / whole, F.lit(float(t)) + F.try_divide(rest * 2, root + w)))
    for end, at in reversed(steps):
        out = F.when(part <= end, F.coalesce(at, F.lit(float(schedule[0][0])))).otherwise(out)
    return out


def ranked(rows: DataFrame, order: list[Column], to: str) -> DataFrame:
    """rows with their places, from 0, in an order over all of them, by a range-sorted table."""
    laid = written(rows.orderBy(*order))
    name = F.col("_metadata.file_name")
    files = laid.groupBy(name.alias("__name")).agg(F.count("*").alias("__n"))
    # a row a file: as many as a shuffle has partitions
    by_part = W.orderBy(F.regexp_extract("__name", r"^part-(\d+)", 1).cast("long"), "__name")
    files = files.withColumn("__before", F.coalesce(F.sum("__n").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    placed = laid.select("*", name.alias("__file"), F.col("_metadata.row_index").alias("__row")).join(F.broadcast(files), F.col("__file") == F.col("__name"))
    return placed.withColumn(to, F.col("__before") + F.col("__row")).drop("__file", "__row", "__name", "__before")


def targets(sizes: DataFrame, weights: list[float], share: float, repeats: float) -> DataFrame:
    """sizes: (source, source_size). Adds each source's place in code-point order and its target."""
    placed = ranked(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = written(placed.withColumns({"weight": weight, "cap": F.col("source_size") * float(repeats)}))
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    # sources over the level stay open; each round shares out what those below it leave, so the level only rises
    level, closed = 0.0, -1
    while True:
        shut = F.col("cap") / F.col("weight") <= level
        got = rows.agg(F.sum(F.when(shut, F.col("cap"))), F.sum(F.when(~shut, F.col("weight"))), F.count(F.when(shut, 1))).first()
        if got[2] == closed:
            break
        if got[1] is None:  # all sources stop
            level = None
            break
        closed, level = got[2], (budget - (got[0] or 0.0)) / got[1]
    limit = F.lit(level).cast("double")
    target = F.when(limit.isNull() | (F.col("cap") / F.col("weight") <= limit), F.col("cap")).otherwise(limit * F.col("weight"))
    return rows.select("source", "source_size", "place", target.alias("target"))


def hash_order(key: Column) -> Column:
    """60 bits of a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def streams(docs: DataFrame, key: str, source: str, size: str, schedules: list[Schedule] | None = None, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """docs with source_size, target, copies and positions (one for each copy taken).

    share: words of the mix as a part of all words; repeats: how often a document may come at most.
    """
    spark = tune(docs.sparkSession)
    schedules = schedules or CURRICULUM
    # columns of the result replace those of the same names
    docs = docs.drop(*[c for c in ("source_size", "target", "copies", "positions", "position", "place") if c not in (key, source, size)])
    base = docs.withColumns({"__size": F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0).cast("long")), "__order": hash_order(F.col(f"`{key}`"))})
    light = base.select(F.col(f"`{source}`").alias("source"), "__size", "__order")
    ranges, n = 1, docs.count()
    while ranges * RANGE_ROWS < n and ranges < MOST_RANGES:
        ranges *= 2
    part = F.floor(F.col("__order") / ((1 << 60) // ranges)).cast("long")
    sums = written(light.groupBy("source", part.alias("__range")).agg(F.sum("__size").alias("__sum")))
    per_source = sums.groupBy("source").agg(F.sum("__sum").alias("source_size"))
    made = targets(per_source, [integral(s) for s in schedules], share, repeats)
    if made.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        made = F.broadcast(made)
    starts = sums.select(
        F.col("source").alias("__of"), "__range",
        F.coalesce(F.sum("__sum").over(W.partitionBy("source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"),
    )
    made = made.select(F.col("source").alias("__source"), "source_size", "place", "target")
    out = base.withColumn("__range", part).join(made, F.col(f"`{source}`").eqNullSafe(F.col("__source")), "inner").drop("__source")
    out = out.join(starts.withColumnRenamed("__range", "__r"), F.col(f"`{source}`").eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__r"))).drop("__of", "__r")
    within = W.partitionBy(F.col(f"`{source}`"), "__range").orderBy("__order", F.col(f"`{key}`"), "__size").rowsBetween(W.unboundedPreceding, -1)
    begin = F.col("__start") + F.coalesce(F.sum("__size").over(within), F.lit(0))
    out = out.withColumn("__begin", begin)
    starts_at = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda n: n * F.col("source_size") + F.col("__begin"))
    taken = F.filter(starts_at, lambda c: c + F.col("__size") / 2 <= F.col("target"))

    def position(c: Column) -> Column:
        done = F.coalesce(F.try_divide(c, F.col("target")), F.lit(0.0))
        at = F.lit(None).cast("double")
        for n, s in enumerate(schedules):
            at = F.when(F.col("place") % len(schedules) == n, due(s, done)).otherwise(at)
        return at

    out = out.withColumn("positions", F.transform(taken, position)).withColumn("copies", F.size("positions"))
    return out.drop("__size", "__order", "__range", "__start", "__begin", "place")


def mix(docs: DataFrame, key: str, source: str, size: str, schedules: list[Schedule] | None = None, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The mix: a row for each copy with its training position, range-sorted by it."""
    made = streams(docs, key, source, size, schedules, share, repeats)
    rows = made.withColumn("position", F.explode("positions")).drop("positions", "copies")
    return rows.orderBy("position", F.col(f"`{key}`"))


def order_of_mix(made: DataFrame, key: str, size: str) -> DataFrame:
    """streams() with position and place (from 0) of each document's first copy in the whole mix; null if none is taken."""
    copies = made.withColumn("__copies", F.when(F.size("positions") > 0, F.col("positions")).otherwise(F.array(F.lit(None).cast("double"))))
    copies = copies.select("*", F.posexplode("__copies").alias("__nth", "position")).drop("__copies")
    laid = ranked(copies, [F.col("position").asc_nulls_last(), F.col(f"`{key}`"), F.col(f"`{size}`"), F.col("__nth")], "mix_place")
    return laid.filter(F.col("__nth") == 0).withColumn("mix_place", F.when(F.col("position").isNotNull(), F.col("mix_place"))).drop("__nth")


def _sized(spark, sf_dir: str) -> DataFrame:
    """Documents without their texts; words are counted once."""
    docs = table(spark, sf_dir, "documents")
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))


def op7_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document of documents, and where its first copy comes."""
    tune(spark)
    made = order_of_mix(streams(_sized(spark, sf_dir), "doc_id", "source", "size"), "doc_id", "size")
    first = F.floor(F.col("position") * 1e6).cast("long")
    return made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), first.alias("position_ppm"), "mix_place")


def op7_mix_order(spark, sf_dir: str) -> DataFrame:
    """The mix of documents in training order: a row for each copy, with its position."""
    return mix(_sized(spark, sf_dir), "doc_id", "source", "size").select("doc_id", "source", "size", "position")


def _due_sql(schedule: Schedule, part: str) -> str:
    """due() in SQL."""
    whole, done, steps = integral(schedule), 0.0, []
    number = lambda x: f"{float(x)!r}::DOUBLE"
    for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False):
        rest, slope = f"({part} * {number(whole)} - {number(done)})", (v - w) / (u - t)
        root = f"sqrt(greatest(0::DOUBLE, {number(w * w)} + {rest} * {number(2 * slope)}))"
        done += (u - t) * (w + v) / 2
        steps.append(f"WHEN {part} <= {number(done / whole)} THEN {number(t)} + {rest} * 2 / ({root} + {number(w)})")
    return f"CASE {' '.join(steps)} ELSE {number(schedule[-1][0])} END"


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, source_size * 2.0::DOUBLE AS cap, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
  row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY cap / w, place) AS nth FROM k),
o AS (SELECT *, arg_min(level, nth) FILTER (WHERE level < cap / w) OVER () AS open FROM l),
t AS (SELECT source, source_size, place, CASE WHEN open IS NULL OR cap / w <= open THEN cap ELSE open * w END AS target FROM o),
r AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d),
j AS (SELECT r.*, t.source_size, t.target, t.place FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, unnest([0, 1]) AS nth FROM j), y AS (SELECT *, nth * source_size + b AS w0, nth * source_size + b + size / 2.0::DOUBLE <= target AS used FROM c),
x AS (SELECT *, coalesce(CASE WHEN target > 0 THEN w0 / target END, 0.0::DOUBLE) AS part FROM y WHERE used),
q AS (SELECT *, CASE (place - 1) % 3 """ + " ".join(f"WHEN {n} THEN {_due_sql(s, 'part')}" for n, s in enumerate(CURRICULUM)) + r""" END AS position FROM x),
z AS (SELECT *, row_number() OVER (ORDER BY position, doc_id, size, nth) - 1 AS mix_place FROM q)
SELECT j.doc_id, j.size, j.source_size, j.target,
  (j.size * ((j.b + j.size / 2.0::DOUBLE <= j.target)::INT + (j.source_size + j.b + j.size / 2.0::DOUBLE <= j.target)::INT))::BIGINT AS taken,
  floor(z.position * 1e6::DOUBLE)::BIGINT AS position_ppm, z.mix_place::BIGINT AS mix_place
FROM j LEFT JOIN z ON z.nth = 0 AND z.doc_id IS NOT DISTINCT FROM j.doc_id AND z.source IS NOT DISTINCT FROM j.source AND z.size = j.size AND z.b = j.b
"""
