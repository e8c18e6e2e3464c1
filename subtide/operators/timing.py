"""Timing operators over cue rows (doc_id, pos, start_s, end_s, text): folds of one document each."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subtide.functions.kernels import Cleaner, Phrases, merged, optimized, retimed, segmented, split, standard
from subtide.functions.text import cps_limit, reading_chars
from subtide.operators.folds import fold, rows_of
from subtide.sources.srt import parse_lenient, serialize_timed

CUES = "pos long, start_s double, end_s double, text string"


def _by_document(rows: DataFrame, step, more: tuple[str, ...] = ()) -> DataFrame:
    """step(cues of a document, the document's value of each column named by more)."""

    def run(table: pa.Table) -> dict:
        got = step([(a, z, t or "") for a, z, t in rows_of(table, "start_s", "end_s", "text")], *[table.column(c)[0].as_py() for c in more])
        columns = zip(*got, strict=True) if got else ([], [], [])
        return {"pos": range(len(got))} | dict(zip(("start_s", "end_s", "text"), columns, strict=True))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return fold(rows.select("doc_id", "pos", "start_s", "end_s", "text", *more), "doc_id", ["pos"], run, f"doc_id {kind}, {CUES}")


class _Cleaners(dict):
    """Cleaners by language, made when first asked for."""

    def __missing__(self, language: str | None) -> Cleaner:
        got = self[language] = Cleaner(language)
        return got


def fix_timings(cues: DataFrame) -> DataFrame:
    return _by_document(cues, retimed)


def merge_short(cues: DataFrame) -> DataFrame:
    return _by_document(cues, merged)


def split_long(cues: DataFrame) -> DataFrame:
    phrases = Phrases()
    return _by_document(cues, lambda rows: [p for cue in rows for p in split(cue, phrases)])


def industry_standard(cues: DataFrame, language: str = "auto") -> DataFrame:
    clean = Cleaner(language)
    return _by_document(cues, lambda rows: standard(rows, clean))


def segment_words(words: DataFrame, language: str = "auto") -> DataFrame:
    """words: doc_id, pos, start_s, end_s, text, and perhaps lang, which is each document's own language."""
    cleaners = _Cleaners()
    if "lang" in words.columns:
        return _by_document(words, lambda rows, lang: segmented(rows, cleaners[lang]), ("lang",))
    return _by_document(words, lambda rows: segmented(rows, cleaners[language]))


def target_ends(cues: DataFrame) -> DataFrame:
    """(doc_id, pos, start_s, target_end): the end that reading speed asks for, before the next start; windows only, texts already clean."""
    w = W.partitionBy("doc_id").orderBy("start_s", "pos")
    a = F.greatest(F.col("start_s"), F.lit(0.0))
    rows = cues.withColumn("limit", F.lead("start_s").over(w) - 0.084).filter(reading_chars(F.coalesce("text", F.lit(""))) > 0)
    rows = rows.withColumn("a", a).withColumn("z", F.greatest("end_s", F.col("a") + 0.2))
    want = F.col("a") + F.least(F.greatest(F.col("z") - F.col("a"), F.lit(1.0), reading_chars(F.col("text")) / cps_limit(F.col("text"))), F.lit(7.0))
    rows = rows.withColumn("want", want)
    end = F.when(F.col("limit").isNull() | (F.col("want") <= F.col("limit")), F.col("want")).when(F.col("limit") > F.col("a") + 0.5, F.col("limit")).otherwise(F.greatest("z", F.col("a") + 0.2))
    return rows.select("doc_id", "pos", F.col("a").alias("start_s"), end.alias("target_end"))


def wrap_texts(rows: DataFrame, text: str = "text", to: str = "wrapped") -> DataFrame:
    phrases = Phrases()

    @F.udf("string", useArrow=True)
    def wrapped(value: str) -> str:
        return None if value is None else phrases.wrapped(value)

    return rows.withColumn(to, wrapped(F.col(f"`{text}`")))


def optimize_documents(docs: DataFrame, text: str = "srt_text", language: str | Column = "auto", to: str = "optimized") -> DataFrame:
    """Documents with their optimised text; one without a cue stays as it is. Row by row, no shuffle.

    language: of all documents, or the column that has each one's own.
    """
    cleaners, phrases = _Cleaners(), Phrases()
    parsed = parse_lenient(docs.withColumn("__l", language if isinstance(language, Column) else F.lit(language)), text)
    kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("text", pa.string())]))

    @F.arrow_udf("array<struct<start_s:double,end_s:double,text:string>>")
    def better(cues: pa.Array, languages: pa.Array) -> pa.Array:
        flat, counts = cues.flatten(), pc.list_value_length(cues).to_pylist()
        rows = zip(*(flat.field(c).to_pylist() for c in ("start_s", "end_s", "text")), strict=True)
        made = [optimized([next(rows) for _ in range(n or 0)], cleaners[lang], phrases) for n, lang in zip(counts, languages.to_pylist(), strict=True)]
        ends = [0, *accumulate(map(len, made))]
        columns = list(zip(*[c for cues_ in made for c in cues_], strict=True)) or [(), (), ()]
        parts = [pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.string()), strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind.value_type)))

    out = parsed.withColumn("__o", better("cues", "__l"))
    return out.withColumn(to, F.when(F.size("cues") == 0, F.col(f"`{text}`")).otherwise(serialize_timed(F.col("__o")))).drop("__o", "__l", "cues")
