"""SRT text to cues and back, row by row: no shuffle, errors are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions.text import LINE_BREAK, SPACE, strip, unified
from subtide.functions.timecode import format_time, lenient_time, strict_time

CUE = "struct<idx:int,start_s:double,end_s:double,text:string>"
WIDE_DIGITS = "０１２３４５６７８９"


def _blocks(text: Column) -> Column:
    return F.split(text, rf"(?U)\n{SPACE}*\n")


def _lines(block: Column) -> Column:
    return F.filter(F.split(block, LINE_BREAK), lambda x: strip(x) != "")


def _after(lines: Column, at: Column) -> Column:
    """Text of the lines behind place at (from 1)."""
    return strip(F.array_join(F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))), "\n"))


def _time_line(lines: Column) -> Column:
    return F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("-->"))), True).cast("int")


def cue_errors(cues: Column) -> Column:
    """First structural fault of a list of cues: none at all, numbering, times, empty text; null if it has none."""
    numbered = F.forall(F.transform(cues, lambda c, n: c["idx"] == n + 1), lambda x: x)
    fault = F.transform(cues, lambda c: F.when(c["start_s"] >= c["end_s"], F.format_string("Block %d start time must be before end time", c["idx"])).when(strip(c["text"]) == "", F.format_string("Block %d is empty", c["idx"])))
    return F.when(F.size(cues) == 0, "SRT has no subtitle blocks").when(~numbered, "SRT indices are not consecutive").otherwise(F.try_element_at(F.array_compact(fault), F.lit(1)))


def parse(docs: DataFrame, text: str = "srt_text", strict: bool = True) -> DataFrame:
    """Adds cues (array) and parse_error. A document with an error has no cues.

    Lines between a block's number and its time line are dropped. Without strict, blocks without a time line are
    passed over and a missing number is the block's place; a bad time is an error either way.
    """
    norm = strip(unified(F.col(f"`{text}`")))
    # Every step works on the one before it through one reference, so that no expression is worked out twice.
    step = F.transform(_blocks(norm), lambda raw, n: F.struct((n + 1).cast("int").alias("place"), F.transform(_lines(raw), lambda x: strip(F.regexp_replace(x, "^\ufeff+|\ufeff+$", ""))).alias("lines")))
    step = F.filter(step, lambda b: F.size(b["lines"]) > 0)
    step = F.transform(step, lambda b: F.struct(b["place"].alias("place"), b["lines"].alias("lines"), _time_line(b["lines"]).alias("at"), F.translate(b["lines"][0], WIDE_DIGITS, "0123456789").alias("first")))
    step = F.transform(step, lambda b: F.struct(
        b["place"].alias("place"), b["at"].alias("at"),
        F.when((b["at"] > 1) & b["first"].rlike("^[0-9]+$"), b["first"].try_cast("int")).alias("number"),
        F.try_element_at(b["lines"], F.greatest(b["at"], F.lit(1))).alias("line"), _after(b["lines"], b["at"]).alias("text"),
    ))
    step = F.transform(step, lambda b: F.struct(*[b[k].alias(k) for k in ("place", "at", "number", "text")], strip(F.substring_index(b["line"], "-->", 1)).alias("left"), strip(F.regexp_replace(b["line"], "^[\\s\\S]*?-->", "")).alias("right")))
    step = F.transform(step, lambda b: F.struct(*[b[k].alias(k) for k in ("place", "at", "number", "text", "left", "right")], strict_time(b["left"]).alias("start"), strict_time(b["right"]).alias("end")))

    def judged(b: Column) -> Column:
        no_line, no_number = (F.format_string(f"Block %d has no {what}", b["place"]) for what in ("time line", "numeric index"))
        bad = F.when(b["start"].isNull(), F.concat(F.lit("Invalid SRT time: "), b["left"])).when(b["end"].isNull(), F.concat(F.lit("Invalid SRT time: "), b["right"]))
        error = F.when(b["at"] == 0, no_line if strict else F.lit(None)).when(b["number"].isNull() & F.lit(strict), no_number).otherwise(bad)
        cue = F.struct(F.coalesce(b["number"], b["place"]).alias("idx"), b["start"].alias("start_s"), b["end"].alias("end_s"), b["text"].alias("text"))
        return F.struct(b["at"].alias("at"), error.alias("error"), cue.alias("cue"))

    out = docs.withColumn("__parse_b", F.transform(step, judged))
    out = out.withColumn("__parse_e", F.try_element_at(F.array_compact(F.transform("__parse_b", lambda b: b["error"])), F.lit(1)))
    out = out.withColumn("__parse_c", F.transform(F.filter("__parse_b", lambda b: b["at"] > 0), lambda b: b["cue"]))
    error = F.when(F.coalesce(norm, F.lit("")) == "", "SRT text is empty").when(F.col("__parse_e").isNotNull(), F.col("__parse_e")).otherwise(cue_errors(F.col("__parse_c")))
    out = out.withColumn("parse_error", error)
    return out.withColumn("cues", F.when(F.col("parse_error").isNull(), F.col("__parse_c"))).drop("__parse_b", "__parse_e", "__parse_c")


def parse_lenient(docs: DataFrame, text: str = "srt_text") -> DataFrame:
    """Adds cues without numbers; whatever is not a cue with text and a positive length is passed over."""

    step = F.transform(_blocks(strip(F.coalesce(F.col(f"`{text}`"), F.lit("")))), lambda raw: F.struct(F.transform(_lines(raw), strip).alias("lines")))
    step = F.transform(step, lambda b: F.struct(b["lines"].alias("lines"), _time_line(b["lines"]).alias("at")))
    step = F.transform(step, lambda b: F.struct((b["at"] > 0).alias("timed"), F.try_element_at(b["lines"], F.greatest(b["at"], F.lit(1))).alias("line"), _after(b["lines"], b["at"]).alias("text")))
    step = F.transform(step, lambda b: F.struct(b["timed"].alias("timed"), b["text"].alias("text"), strip(F.substring_index(b["line"], "-->", 1)).alias("left"), strip(F.regexp_replace(b["line"], "^[\\s\\S]*?-->", "")).alias("right")))
    found = F.transform(step, lambda b: F.struct(b["timed"].alias("timed"), lenient_time(b["left"]).alias("start_s"), lenient_time(b["right"]).alias("end_s"), b["text"].alias("text")))
    good = F.filter(found, lambda c: c["timed"] & (c["text"] != "") & F.coalesce(c["end_s"] > c["start_s"], F.lit(False)))
    return docs.withColumn("cues", F.transform(good, lambda c: F.struct(F.lit(None).cast("int").alias("idx"), c["start_s"].alias("start_s"), c["end_s"].alias("end_s"), c["text"].alias("text"))))


def _written(number: Column, cue: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), format_time(cue["start_s"]), F.lit(" --> "), format_time(cue["end_s"]), F.lit("\n"), strip(cue["text"]))


def _document(blocks: Column) -> Column:
    return F.when(F.size(blocks) > 0, F.concat(F.array_join(blocks, "\n\n"), F.lit("\n"))).otherwise("")


def serialize(cues: Column) -> Column:
    """SRT text, numbered from 1."""
    return _document(F.transform(cues, lambda c, n: _written(n + 1, c)))


def serialize_error(cues: Column) -> Column:
    """Why cues can't be written: an empty text or a time that ends before it starts."""
    fault = F.transform(cues, lambda c, n: F.when(strip(c["text"]) == "", F.format_string("Block %d is empty", (n + 1).cast("int"))).when(c["start_s"] >= c["end_s"], F.format_string("Block %d start time must be before end time", (n + 1).cast("int"))))
    return F.try_element_at(F.array_compact(fault), F.lit(1))


def serialize_timed(cues: Column) -> Column:
    """SRT text of the timing pipeline: empty cues are left out but use up their number."""
    blocks = F.transform(cues, lambda c, n: F.when(strip(c["text"]) != "", _written(n + 1, c)))
    return _document(F.array_compact(blocks))


def collected(cues: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """Cue rows as one array a document."""
    row = F.struct(order, F.col("idx").cast("int").alias("idx"), "start_s", "end_s", "text")
    made = cues.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("r"))
    return made.select(key, F.transform("r", lambda r: F.struct(r["idx"].alias("idx"), r["start_s"].alias("start_s"), r["end_s"].alias("end_s"), r["text"].alias("text"))).alias("cues"))


def exploded(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a cue. The outer form adds no filter that would be pushed below, and work out, the whole parse again."""
    return docs.select(key, F.posexplode_outer("cues").alias("pos", "cue")).filter("pos is not null").select(key, "pos", "cue.*")


def _or_column(value: float | str | None) -> Column:
    """Seconds, or the column that has each row's own."""
    return (F.col(f"`{value}`") if isinstance(value, str) else F.lit(value)).cast("double")


def _clamped(at: Column, offset: float | str, min_start: float | str | None, max_end: float | str | None) -> Column:
    """A time of the model's, at least 0, moved by the offset and into the bounds that are not null."""
    moved = F.greatest(F.coalesce(at.cast("double"), F.lit(0.0)), F.lit(0.0)) + _or_column(offset)
    return F.least(F.greatest(moved, _or_column(min_start)), _or_column(max_end))


def segments_to_cues(segments: DataFrame, offset: float | str = 0.0, min_start: float | str | None = None, max_end: float | str | None = None, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Recognised segments (doc_id, order columns, start_s, end_s, text) as cues, clamped, numbered over those with text.

    offset, min_start, max_end: seconds, or the column that has each segment's own.
    """
    from pyspark.sql import Window as W

    low, high = _or_column(min_start), _or_column(max_end)
    at = lambda name: _clamped(F.col(name), offset, min_start, max_end).alias(name)
    out = segments.select("doc_id", *order, at("start_s"), at("end_s"), strip(F.coalesce("text", F.lit(""))).alias("text"), high.alias("most"), (low.isNotNull() & high.isNotNull()).alias("both")).filter("text != ''")
    out = out.filter("NOT both OR end_s > start_s OR start_s < most")
    end = F.when(F.col("both"), F.least(F.col("start_s") + 0.2, F.col("most"))).otherwise(F.col("start_s") + 0.2)
    out = out.withColumn("end_s", F.when(F.col("end_s") <= F.col("start_s"), end).otherwise(F.col("end_s")))
    return out.withColumn("idx", F.row_number().over(W.partitionBy("doc_id").orderBy(*order))).select("doc_id", *order, "idx", "start_s", "end_s", "text")


def words_of(segments: DataFrame, offset: float | str = 0.0, min_start: float | str | None = None, max_end: float | str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, pos, start_s, end_s, text, is_word, keep columns): a document's words, or its segments if none of them has a word.

    segments: doc_id, pos, start_s, end_s, text, words (array of start_s, end_s, word); null times are 0.
    """
    from pyspark.sql import Window as W

    at = lambda c, name: _clamped(F.col(c), offset, min_start, max_end).alias(name)
    whole = segments.select("doc_id", "pos", *keep, F.lit(-1).alias("sub"), at("start_s", "start_s"), at("end_s", "end_s"), F.col("text"))
    parts = segments.select("*", F.posexplode("words").alias("sub", "w")).select("doc_id", "pos", *keep, "sub", at("w.start_s", "start_s"), at("w.end_s", "end_s"), F.col("w.word").alias("text"))
    both = whole.unionByName(parts).withColumn("text", strip(F.coalesce("text", F.lit("")))).filter("text != '' AND end_s > start_s")
    has = F.max(F.col("sub") >= 0).over(W.partitionBy("doc_id"))
    both = both.withColumn("is_word", F.col("sub") >= 0).withColumn("has", has).filter(F.col("has") == F.col("is_word"))
    return both.withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "sub")) - 1).drop("sub", "has")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """SRT files of a folder: (path, srt_text), one row a file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.srt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("srt_text"))


def write_directory(docs: DataFrame, path: str, name: str = "name", text: str = "srt_text") -> None:
    """One folder a document under path, with its text."""
    docs.select(F.col(f"`{name}`").alias("name"), F.col(f"`{text}`").alias("value")).write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)
