"""Language ranges on a time line: parsing lists, overlap, normalising, tiling; speech intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subtide.functions.text import LINE_BREAK, strip
from subtide.functions.timecode import range_time
from subtide.operators.folds import fold

# Language codes; the least length of a piece, padding and gaps of speech, seconds; samples a second.
LANGUAGES = ["auto", "mixed", "ko", "ja", "vi", "zh", "en"]
LEAST, PADDING, RATE = 0.35, 0.4, 16000
# Gaps over which speech is joined, the second if one side is short; what is short; the longest stretch.
JOIN_GAP, SHORT_GAP, SHORT_SPEECH, MOST_SPEECH = 0.65, 1.2, 1.2, 30.0
CODE = r"(?i)^([\s\S]+?)\s+(auto|mixed|ko|ja|vi|zh|en)$"


def _sides(text: Column) -> Column:
    """The two sides of a range: by an arrow, a tilde or a word for "to", or the first hyphen."""
    arrows = F.split(text, r"(?U)\s*-->\s*")
    full = F.filter(F.transform(arrows, strip), lambda x: x != "")
    pair = lambda p: F.array(strip(F.regexp_extract(text, p, 1)), strip(F.regexp_extract(text, p, 2)))
    word, dash = r"(?U)^(.+?)\s*(?:~|到|至)\s*(.+)$", r"(?U)^(.+?)\s*-\s*(.+)$"
    return F.when((F.size(arrows) == 2) & (F.size(full) == 2), full).when(F.size(arrows) > 2, F.lit(None)).when(text.rlike(word), pair(word)).when(text.rlike(dash), pair(dash))


def parse_ranges(docs: DataFrame, raw: str = "raw", custom: bool = False, default: str = "") -> DataFrame:
    """(doc_id, line_no, start_s, end_s, lang, error): one row an item of a list; a bad item has an error.

    custom: each item ends with its language, or has the default one, if that is given.
    """
    tag = default.strip().lower()
    if tag and (tag not in LANGUAGES or not custom):
        raise ValueError("the default language must be a known code and needs custom languages")
    items = F.split(F.col(f"`{raw}`"), LINE_BREAK if custom else r"(?U)[\n;]+|,\s+")
    rows = docs.select("doc_id", F.posexplode(F.transform(items, strip)).alias("n", "item")).filter("item != ''")
    coded = F.col("item").rlike(CODE)
    if custom and not tag:
        body, lang = strip(F.regexp_extract("item", CODE, 1)), F.lower(F.regexp_extract("item", CODE, 2))
        fault = F.when(~coded, "language code missing")
    else:
        body, lang = F.col("item"), F.lit(tag or "mixed")
        fault = F.when(coded, "language code not expected")
    rows = rows.withColumns({"sides": _sides(body), "lang": lang, "fault": fault})
    rows = rows.withColumns({"start_s": range_time(F.col("sides")[0]), "end_s": range_time(F.col("sides")[1])})
    error = F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("sides").isNull(), "no range").when(F.col("start_s").isNull() | F.col("end_s").isNull(), "invalid time value").when(F.col("end_s") <= F.col("start_s"), "end is not after start")
    return rows.select("doc_id", (F.col("n") + 1).alias("line_no"), "start_s", "end_s", "lang", error.alias("error"))


def overlapping(ranges: DataFrame) -> DataFrame:
    """(doc_id, overlaps): whether a range starts before the one before it, by start, has ended."""
    w = W.partitionBy("doc_id").orderBy("start_s", "line_no")
    hit = F.coalesce(F.col("start_s") < F.lag("end_s").over(w), F.lit(False))
    return ranges.withColumn("hit", hit).groupBy("doc_id").agg(F.bool_or("hit").alias("overlaps"))


def normalized(ranges: DataFrame, total: str = "total_s") -> DataFrame:
    """Ranges (with total_s) within [0, total], at least LEAST long, neighbours of one language that touch or overlap joined.

    (doc_id, start_s, end_s, lang, total_s), by windows: within a stretch of one language a range is joined if it
    starts no later than the greatest end before it.
    """
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(total)))
    rows = ranges.select("doc_id", "line_no", inside("start_s").alias("start_s"), inside("end_s").alias("end_s"), "lang", F.col(total).alias("total_s"))
    rows = rows.filter(F.col("end_s") - F.col("start_s") >= LEAST)
    w = W.partitionBy("doc_id").orderBy("start_s", "line_no")
    rows = rows.withColumn("stretch", F.sum(F.coalesce(F.col("lang") != F.lag("lang").over(w), F.lit(True)).cast("int")).over(w))
    before = W.partitionBy("doc_id", "stretch").orderBy("start_s", "line_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("new", F.coalesce(F.col("start_s") > F.max("end_s").over(before), F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w))
    return rows.groupBy("doc_id", "run").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.first("lang").alias("lang"), F.first("total_s").alias("total_s"))


def tiled(ranges: DataFrame, default: str | Column) -> DataFrame:
    """(doc_id, start_s, end_s, lang): a document's whole time line; gaps have the default language. ranges: of normalized().

    default: of all documents, or the column that has each one's own.
    """
    w = W.partitionBy("doc_id").orderBy("run")
    rows = ranges.withColumns({"before": F.lag("end_s", 1, 0.0).over(w), "last": F.lead("start_s").over(w).isNull()})
    gap = default if isinstance(default, Column) else F.lit(default)
    piece = lambda a, z, lang, when: F.when(when, F.struct(a.alias("start_s"), z.alias("end_s"), lang.alias("lang")))
    pieces = F.array_compact(F.array(
        piece(F.col("before"), F.col("start_s"), gap, F.col("start_s") > F.col("before")),
        piece(F.col("start_s"), F.col("end_s"), F.col("lang"), F.lit(True)),
        piece(F.col("end_s"), F.col("total_s"), gap, F.col("last") & (F.col("end_s") < F.col("total_s"))),
    ))
    return rows.select("doc_id", "run", F.posexplode(pieces).alias("nth", "p")).select("doc_id", "p.*", "run", "nth")


def speech_end(start: np.ndarray, end: np.ndarray) -> int:
    """How many intervals, from the first on, are one stretch of speech; all of them if none breaks off."""
    reach = np.maximum.accumulate(end)
    gap, own, new = (start[1:] - reach[:-1]) / RATE, (reach[:-1] - start[0]) / RATE, (end[1:] - start[1:]) / RATE
    close = (gap <= JOIN_GAP) | ((gap <= SHORT_GAP) & (np.minimum(own, new) < SHORT_SPEECH))
    breaks = np.flatnonzero(~(close & ((end[1:] - start[0]) / RATE <= MOST_SPEECH)))
    return int(breaks[0]) + 1 if len(breaks) else len(start)


def merge_speech(speech: DataFrame, key: str = "doc_id") -> DataFrame:
    """Speech intervals (key, pos, start_smp, end_smp) joined over short gaps, up to MOST_SPEECH: a fold, since that bound depends on what was joined."""

    def run(table: pa.Table) -> dict:
        start, end = (table.column(c).to_numpy() for c in ("start_smp", "end_smp"))
        start, end = start[end > start], end[end > start]
        firsts, lasts, at = [], [], 0
        while at < len(start):
            # looks at some intervals, at more if the stretch goes on behind them
            width, size = 16, 0
            while size == 0:
                here = slice(at, at + width)
                got = speech_end(start[here], end[here])
                size = got if got < width or at + width >= len(start) else 0
                width *= 4
            firsts.append(int(start[at]))
            lasts.append(int(end[at : at + size].max()))
            at += size
        return {"pos": range(len(firsts)), "start_smp": firsts, "end_smp": lasts}

    kind = speech.schema[key].dataType.simpleString()
    return fold(speech.select(key, "pos", "start_smp", "end_smp"), key, ["pos"], run, f"{key} {kind}, pos long, start_smp long, end_smp long")


def padded(speech: DataFrame, samples: str = "n_samples") -> DataFrame:
    """Speech intervals with context on both sides, within the audio; too short windows are dropped."""
    pad = int(PADDING * RATE)
    rows = speech.filter("end_smp > start_smp").withColumns({"from_smp": F.greatest(F.lit(0), F.col("start_smp") - pad), "to_smp": F.least(F.col(samples), F.col("end_smp") + pad)})
    return rows.filter((F.col("to_smp") - F.col("from_smp")) / RATE >= LEAST)


def sliced(rows: DataFrame, samples: str = "n_samples") -> DataFrame:
    """Sample bounds of a piece of audio given in seconds."""
    at = lambda c: (F.col(c) * RATE).cast("long")
    return rows.withColumns({"from_smp": F.greatest(F.lit(0).cast("long"), at("start_s")), "to_smp": F.least(F.col(samples), at("end_s"))})
